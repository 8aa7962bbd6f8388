"""Tables behind the charts of a dashboard: each is one aggregate or projection over cleaned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions import values as v

from .gold import Exclusion

#: How many filters a dashboard has, how many values a list offers, and how many columns a detail table has.
MAX_FILTERS = 5
MAX_LIST_VALUES = 50
MAX_DETAIL_COLUMNS = 10
#: Fixed value: the values that a dimension may have to split a chart.
MAX_SPLIT_VALUES = 5

SCATTER_BINS = 20


def month_split(df: DataFrame, measure: Column, temporal: str, split: str, exclusion: Exclusion, most: int = MAX_SPLIT_VALUES) -> DataFrame:
    """(month, split, total): the measure's monthly course, split by a dimension; null months are left out. No row where the dimension
    has more than `most` values, null not counted: such a split is no chart."""
    month = F.trunc(F.to_date(temporal), "month")
    few = df.agg((F.count_distinct(split) <= most).alias("_few"))
    out = df.where(exclusion.keeps() & F.col(temporal).isNotNull()).groupBy(month.alias("month"), F.col(split).alias("split")).agg(v.money_total(measure).alias("total"))
    return out.join(F.broadcast(few), F.lit(True)).where("_few").drop("_few")


def matrix(df: DataFrame, measure: Column, rows: str, columns: str, exclusion: Exclusion) -> DataFrame:
    """(row, column, total): the measure by two dimensions."""
    return df.where(exclusion.keeps()).groupBy(F.col(rows).alias("row"), F.col(columns).alias("column")).agg(v.money_total(measure).alias("total"))


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = SCATTER_BINS) -> DataFrame:
    """(x_bin, y_bin, n): rows in a grid of equal steps between the least and greatest value of two measures, from 0; the greatest
    value lies in the last bin, and a measure of one value has bin 0. So a chart draws bins * bins points at most."""
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ends = known.agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    bin_of = lambda c: F.least(F.coalesce(F.floor(F.try_divide((F.col(c) - F.col(f"{c}_low")) * bins, F.col(f"{c}_high") - F.col(f"{c}_low"))), F.lit(0)), F.lit(bins - 1)).cast("int")
    return known.join(F.broadcast(ends), F.lit(True)).groupBy(bin_of("x").alias("x_bin"), bin_of("y").alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def filters(df: DataFrame, temporal: str | None, dimensions: list[str], most: int = MAX_LIST_VALUES) -> DataFrame:
    """(column, type, low, high, n_values, options): the date range of the temporal column, and the values as text, in order, of each
    dimension that has at most `most`; a dimension of more values is no filter. The first `MAX_FILTERS` in the given order."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(dimensions)])).alias("t")).select("t.*").where("value IS NOT NULL").distinct()
    counts = values.groupBy("place", "column").agg(F.count(F.lit(1)).alias("n_values")).where(F.col("n_values") <= most)
    # one row for each dimension
    chosen = counts.withColumn("_nth", F.row_number().over(Window.orderBy("place"))).where(F.col("_nth") <= MAX_FILTERS - bool(temporal))
    lists = values.join(F.broadcast(chosen.select("column", "n_values")), "column").groupBy("column", "n_values").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("options"))
    none = F.lit(None).cast("string")
    out = lists.select("column", F.lit("list").alias("type"), none.alias("low"), none.alias("high"), "n_values", "options")
    if temporal is None:
        return out
    day = F.to_date(temporal)
    span = df.agg(F.min(day).cast("string").alias("low"), F.max(day).cast("string").alias("high"))
    return span.select(F.lit(temporal).alias("column"), F.lit("date_range").alias("type"), "low", "high", F.lit(None).cast("long").alias("n_values"), none.alias("options")).unionByName(out)


def detail(df: DataFrame, identifiers: list[str], temporal: list[str], dimensions: list[str], measures: list[str]) -> DataFrame:
    """The rows behind the charts: identifiers, dates, dimensions and measures in this order, `MAX_DETAIL_COLUMNS` columns at most."""
    return df.select(*[*identifiers, *temporal, *dimensions, *measures][:MAX_DETAIL_COLUMNS])
