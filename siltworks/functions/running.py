"""Running sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.sources.work import stored


def running_sum(df: DataFrame, group: str, order: list[Column], amount: Column) -> DataFrame:
    """The frame with `running`, the sum of `amount` in each group up to and with the row, in order. Rows are dealt by ranges, so a
    group of any size is summed by many tasks; only the ranges' own sums, a row for each range, are added up in order."""
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    dealt = df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()).withColumn("_amount", amount)
    dealt = stored(dealt, "ranges")
    of_range = dealt.groupBy(group, "_range").agg(F.sum("_amount").alias("_sum"))
    before = of_range.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_range").orderBy(*keys.values()).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_within", F.sum("_amount").over(within)).join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("running", F.col("_before") + F.col("_within")).drop("_range", "_amount", "_within", "_group", "_r", "_before")
