"""KPIs as structured specs, compiled to aggregate columns; all KPIs of a table share one scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import values as v

from .gold import Exclusion


@dataclass(frozen=True)
class Kpi:
    """op: sum, product (sum of a * b), avg, rows, distinct (null being a value), or ratio (of two KPIs, null for 0).

    `by` groups by a column; `by_month` by the month of one.
    """

    name: str
    op: str
    args: tuple = ()
    exclusion: Exclusion | None = None
    by: str | None = None
    by_month: str | None = None

    def column(self) -> Column:
        keep = self.exclusion.keeps() if self.exclusion else F.lit(True)
        only = lambda c: F.when(keep, c)
        if self.op == "sum":
            return v.money_total(only(F.col(self.args[0])))
        if self.op == "product":
            return v.money_total(only(F.col(self.args[0]) * F.col(self.args[1])))
        if self.op == "avg":
            return F.avg(only(F.col(self.args[0])))
        if self.op == "rows":
            return F.count_if(keep)
        if self.op == "distinct":
            c = F.col(self.args[0])
            return F.count_distinct(only(c)) + F.coalesce(F.max((keep & c.isNull()).cast("int")), F.lit(0))
        if self.op == "ratio":
            a, b = (Kpi(k.name, k.op, k.args, k.exclusion or self.exclusion) for k in self.args)
            return F.try_divide(a.column().cast("double"), b.column().cast("double"))
        raise ValueError(f"no operation {self.op}")


def evaluate(df: DataFrame, kpis: Iterable[Kpi]) -> DataFrame:
    """(kpi, value) of KPIs without a dimension, from one scan."""
    kpis = list(kpis)
    one = df.agg(*[k.column().cast("double").alias(f"k{i}") for i, k in enumerate(kpis)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k.name).alias("kpi"), F.round(F.col(f"k{i}"), 6).alias("value")) for i, k in enumerate(kpis)])).alias("t")).select("t.*")


def evaluate_by(df: DataFrame, kpi: Kpi) -> DataFrame:
    """(group, value) of a KPI with a dimension: the column's values, or first days of months."""
    rows = df.where(kpi.exclusion.keeps()) if kpi.exclusion else df
    group = F.date_trunc("month", F.col(kpi.by_month)).cast("date") if kpi.by_month else F.col(kpi.by)
    return rows.groupBy(group.alias("group")).agg(F.round(kpi.column().cast("double"), 6).alias("value"))
