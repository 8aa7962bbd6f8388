"""Cleaning steps: names, text, types, nulls, repeated rows, contract rules, derived and enriched columns.

A step is a small spec; `apply_steps` applies a list of them to a frame and counts rows before and
after each by Observation, so the report costs no job of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions import values as v

UNKNOWN = "UNKNOWN"


def rename(df: DataFrame) -> DataFrame:
    """snake_case names; two names that become one are refused."""
    mapping = {c: v.plain_name(c) for c in df.columns}
    twice = [n for n, k in Counter(mapping.values()).items() if k > 1]
    if twice:
        raise ValueError(f"several columns would be named {', '.join(twice)}")
    return df.withColumnsRenamed(mapping)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def trim(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.withColumns({c: v.strip(F.col(c)) for c in (columns or text_columns(df))})


def normalize(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.upper(v.strip(F.col(c))) for c in columns})


def cast_column(c: Column, kind: str) -> Column:
    """datetime, integer or decimal; null where the value is lost."""
    if kind == "datetime":
        return v.to_datetime(c)
    number = v.to_number(c)
    return F.when(number % 1 == 0, number.cast("long")) if kind == "integer" else number


def lossy(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, kind, lost): known values that a cast would lose, from one scan."""
    counts = [F.count_if(F.col(c).isNotNull() & cast_column(F.col(c), k).isNull()).alias(c) for c, k in kinds.items()]
    rows = df.agg(*counts).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(c).alias("lost")) for c, k in kinds.items()])).alias("r"))
    return rows.select("r.*")


def cast(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Casts the columns, or refuses if any value would be lost."""
    lost = [r for r in lossy(df, kinds).collect() if r.lost]
    if lost:
        raise ValueError("; ".join(f"{r.lost} values of {r.column} are no {r.kind}" for r in lost))
    return df.withColumns({c: cast_column(F.col(c), k) for c, k in kinds.items()})


def fill_unknown(df: DataFrame, columns: Iterable[str], value: str = UNKNOWN) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def drop_null_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def deduplicate(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def derive_amount(df: DataFrame, quantity: str, price: str, target: str = "line_amount") -> DataFrame:
    """Not rounded."""
    return df.withColumn(target, F.col(quantity) * F.col(price))


def derive_date_parts(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("year", F.year(column)).withColumn("month", F.month(column))


def violations(rules: dict[str, dict]) -> Column:
    """The names of the row rules that fail, one scan and no shuffle; uniqueness is checked by `check_rows`."""
    found = []
    for c, rule in rules.items():
        if rule.get("nullable") is False:
            found.append(F.when(F.col(c).isNull(), F.lit(f"{c}:null")))
        if rule.get("min") is not None:
            found.append(F.when(F.col(c) < F.lit(rule["min"]), F.lit(f"{c}:min")))
        if rule.get("max") is not None:
            found.append(F.when((F.col(c) > F.lit(rule["max"])) & ~F.isnan(F.col(c).cast("double")), F.lit(f"{c}:max")))
    return F.array_compact(F.array(*found)) if found else F.expr("cast(array() as array<string>)")


def check_rows(df: DataFrame, rules: dict[str, dict], order_by: Iterable[str] | None = None) -> DataFrame:
    """The rows with `_violations`. Of rows with one key that is to be unique, the first by `order_by` (all columns, if not given) passes.

    Rows without the key are left out of the window, so that nulls do not meet in one task.
    """
    out = df.withColumn("_violations", violations(rules))
    order = [F.col(c) for c in (order_by or df.columns)]
    for c, rule in rules.items():
        if rule.get("unique"):
            first = F.row_number().over(Window.partitionBy(c).orderBy(*order))
            known = out.where(F.col(c).isNotNull()).withColumn("_nth", first)
            known = known.withColumn("_violations", F.when(F.col("_nth") > 1, F.array_append("_violations", F.lit(f"{c}:unique"))).otherwise(F.col("_violations"))).drop("_nth")
            out = known.unionByName(out.where(F.col(c).isNull()))
    return out


def enrich(df: DataFrame, operations: Iterable[dict]) -> DataFrame:
    """Adds columns. kind: add, subtract, multiply, divide (of left, right); concat (of columns, by separator); date_part
    (part of column); constant (value). The target must be new and the sources there."""
    for op in operations:
        kind, target = op["kind"], op["target"]
        sources = [op[k] for k in ("left", "right", "column") if k in op] + list(op.get("columns", []))
        if target in df.columns:
            raise ValueError(f"{target} is there already")
        if missing := [s for s in sources if s not in df.columns]:
            raise ValueError(f"no column {', '.join(missing)}")
        if kind in ("add", "subtract", "multiply", "divide"):
            a, b = F.col(op["left"]), F.col(op["right"])
            new = {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": F.try_divide(a, b)}[kind]
        elif kind == "concat":
            new = v.join_text(op.get("separator", " "), *map(F.col, op["columns"]))
        elif kind == "date_part":
            new = {"year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter, "weekday": F.weekday}[op["part"]](op["column"])
        elif kind == "constant":
            new = F.lit(op["value"])
        else:
            raise ValueError(f"no enrichment {kind}")
        df = df.withColumn(target, new)
    return df


@dataclass(frozen=True)
class Step:
    """kind is one of STEPS; a destructive step runs only where it is approved."""

    id: str
    kind: str
    options: dict = field(default_factory=dict)
    destructive: bool = False


STEPS = {
    "rename": lambda df, **o: rename(df),
    "trim": trim,
    "cast": cast,
    "normalize": normalize,
    "impute": fill_unknown,
    "filter": drop_null_keys,
    "deduplicate": lambda df, **o: deduplicate(df),
    "amount": derive_amount,
    "date_parts": derive_date_parts,
    "enrich": enrich,
    "keep_nulls": lambda df, **o: df,
}


@dataclass
class Cleaned:
    """passed and quarantined share one plan; `report` may be read after either was written."""

    passed: DataFrame
    quarantined: DataFrame
    counts: list[tuple[str, str, Observation | None, Observation | None]]

    def report(self) -> list[tuple[str, str, int | None, int | None]]:
        """(step, outcome, rows before, rows after) of each step, from what the write has observed."""
        read = lambda o: o.get["rows"] if o is not None else None
        return [(step, outcome, read(a), read(b)) for step, outcome, a, b in self.counts]


def apply_steps(df: DataFrame, steps: Iterable[Step], approved: bool = True, rules: dict[str, dict] | None = None) -> Cleaned:
    """Applies the steps in order, then the row rules. Unapproved destructive steps are skipped and reported so."""
    counts = []

    def watched(frame: DataFrame, name: str) -> tuple[DataFrame, Observation]:
        seen = Observation(name)
        return frame.observe(seen, F.count(F.lit(1)).alias("rows")), seen

    df, before = watched(df, "input")
    for step in steps:
        if step.destructive and not approved:
            counts.append((step.id, "SKIPPED_NOT_APPROVED", before, before))
            continue
        df, after = watched(STEPS[step.kind](df, **step.options), step.id)
        counts.append((step.id, "APPLIED", before, after))
        before = after
    flagged = check_rows(df, rules or {})
    ok = F.size("_violations") == 0
    return Cleaned(flagged.where(ok).drop("_violations"), flagged.where(~ok), counts)
