"""Facts, dimensions and aggregates from the cleaned rows, and the checks that they add up."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions import values as v


@dataclass(frozen=True)
class Metric:
    """operation: SUM, AVG or COUNT of a column. Money sums are added in decimals."""

    name: str
    operation: str
    column: str

    def over(self) -> Column:
        c = F.col(self.column)
        if self.operation == "SUM":
            return v.money_total(c)
        if self.operation == "AVG":
            return F.round(F.avg(c), 6)
        if self.operation == "COUNT":
            return F.count(c)
        raise ValueError(f"no operation {self.operation}")


@dataclass(frozen=True)
class Exclusion:
    """Rows that no aggregate counts: those whose `column` has one of `values`. Null rows count."""

    column: str
    values: tuple[str, ...]

    def keeps(self) -> Column:
        return v.not_in(F.col(self.column), self.values)


def fact(silver: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row for each source row, excluded ones too."""
    return silver.select(*columns)


def dimension(silver: DataFrame, key: str, attributes: Iterable[str], order_by: Iterable[str]) -> DataFrame:
    """One row for each key, null being one: the attributes of its first row by `order_by`, as one aggregate, not a sort of all rows."""
    attributes = list(attributes)
    if not attributes:
        return silver.select(key).distinct()
    first = F.min_by(F.struct(*attributes), F.struct(*order_by))
    return silver.groupBy(key).agg(first.alias("_first")).select(key, *[F.col(f"_first.{a}").alias(a) for a in attributes])


def date_dimension(silver: DataFrame, column: str) -> DataFrame:
    """The days that occur, with their parts."""
    days = silver.select(F.to_date(column).alias("date")).where("date IS NOT NULL").distinct()
    return days.select("date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"))


def aggregate(silver: DataFrame, by: Iterable[str], metrics: Iterable[Metric], exclusion: Exclusion | None = None) -> DataFrame:
    """Metrics for each group, a null group too; one row for all if `by` is empty."""
    by, metrics = list(by), list(metrics)
    missing = [c for c in [*by, *[m.column for m in metrics]] if c not in silver.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    rows = silver.where(exclusion.keeps()) if exclusion else silver
    return rows.groupBy(*by).agg(*[m.over().alias(m.name) for m in metrics])


def grouping_sets(silver: DataFrame, sets: list[list[str]], metrics: Iterable[Metric], exclusion: Exclusion | None = None) -> DataFrame:
    """Several aggregates from one scan; `grouping_id` tells the sets apart."""
    rows = silver.where(exclusion.keeps()) if exclusion else silver
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets(sets, *columns).agg(F.grouping_id().cast("long").alias("grouping_id"), *[m.over().alias(m.name) for m in metrics])


def totals(silver: DataFrame, columns: Iterable[str], exclusion: Exclusion | None = None) -> DataFrame:
    """(metric, total) of each column."""
    columns = list(columns)
    rows = silver.where(exclusion.keeps()) if exclusion else silver
    one = rows.agg(*[v.money_total(F.col(c)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("total")) for c in columns])).alias("t")).select("t.*")


def verify_totals(expected: DataFrame, tables: dict[str, DataFrame], metrics: dict[str, str], tolerance: float = 1e-6) -> DataFrame:
    """(table_name, metric, expected, actual, ok): each table's sum of a metric against the total of its source column,
    within a tolerance relative to the total."""
    actual = None
    for name, frame in tables.items():
        sums = frame.agg(*[v.money_total(F.col(m)).alias(m) for m in metrics])
        rows = sums.select(F.lit(name).alias("table_name"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(s).alias("source"), F.col(m).alias("actual")) for m, s in metrics.items()])).alias("t")).select("table_name", "t.*")
        actual = rows if actual is None else actual.unionByName(rows)
    both = actual.join(expected.select(F.col("metric").alias("source"), F.col("total").alias("expected")), "source")
    ok = F.abs(F.col("actual") - F.col("expected")) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs("expected"))
    return both.select("table_name", "metric", "expected", "actual", ok.alias("ok"))


def verify_counts(expected: dict[str, DataFrame], written: dict[str, DataFrame]) -> DataFrame:
    """(table_name, expected, actual, ok) row counts."""
    out = None
    for name, frame in expected.items():
        row = frame.agg(F.count(F.lit(1)).alias("expected")).join(written[name].agg(F.count(F.lit(1)).alias("actual")), F.lit(True))
        row = row.select(F.lit(name).alias("table_name"), "expected", "actual", (F.col("expected") == F.col("actual")).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def verify_not_null(silver: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, nulls, ok) of columns that must be known."""
    columns = list(columns)
    one = silver.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("t")).select("t.*")
    return rows.withColumn("ok", F.col("nulls") == 0)


def top_per_group(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
