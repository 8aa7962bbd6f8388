"""A profile of every column of a table: one row for each column.

Counts, types and bounds of all columns come from one scan; exact distinct counts from the long form
(column, value), whose rows are made distinct in each task before they are shuffled. Where only the flags matter, a
sketch of each column comes with the scan, and values are shuffled of those columns alone whose estimate is near a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions import values as v
from siltworks.sources.work import stored

CATEGORICAL_VALUES, CATEGORICAL_RATIO = 50, 0.5
IDENTIFIER_ROWS = 10
#: Standard deviation of a sketch's estimate, as a share, and how many of them an estimate keeps from a limit that it decides.
SKETCH_ERROR, SKETCH_DEVIATIONS = 0.02, 5
DATE_RATIO = 0.9
SAMPLES = 5
#: Words of names that hint at an identifier anywhere, at the end, and at the beginning.
ID_TOKENS = ("id", "uuid", "guid")
ID_ENDS = ("key", "code", "ref", "number", "num", "no")
ID_STARTS = ("numero", "num", "no", "code", "ref", "reference", "identifiant")


def plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, NaN as null, so that every value can be compared."""
    nested = {f.name: F.to_json(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    return v.fold_nan(df.withColumns(nested) if nested else df)


def table_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)).cast("long"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each; nulls are equal."""
    rows = plain(df)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def _kind(f: T.StructField) -> str:
    t = f.dataType
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "number"
    return "string"


def _facts(f: T.StructField) -> Column:
    """What one scan says of a column."""
    c, kind = F.col(f.name), _kind(f)
    known = F.count(c)
    number = isinstance(f.dataType, T.NumericType)
    as_date = v.to_datetime(c) if kind == "string" else c if kind == "datetime" else F.lit(None).cast("timestamp_ntz")
    if kind == "number":
        inferred = F.when(F.coalesce(F.bool_and(c % 1 == 0), F.lit(False)), "integer").otherwise("decimal")
    elif kind == "string":
        dates = (F.count_if(c.rlike(v.DATE_PATTERN)) >= DATE_RATIO * known) & (F.count(as_date) >= DATE_RATIO * known)
        inferred = F.when(dates, "datetime").otherwise("string")
    else:
        inferred = F.lit(kind)
    return F.struct(
        F.lit(f.name).alias("column"),
        F.lit(f.dataType.simpleString()).alias("dtype"),
        F.when(known == 0, "empty").otherwise(inferred).alias("inferred_type"),
        (F.count(F.lit(1)) - known).alias("null_count"),
        F.min(c).try_cast("double").alias("min_number") if number else F.lit(None).cast("double").alias("min_number"),
        F.max(c).try_cast("double").alias("max_number") if number else F.lit(None).cast("double").alias("max_number"),
        F.min(as_date).cast("timestamp_ntz").alias("min_date"),
        F.max(as_date).cast("timestamp_ntz").alias("max_date"),
        F.coalesce(F.bool_or(F.date_trunc("day", as_date) != as_date), F.lit(False)).alias("has_time"),
        (F.coalesce(F.bool_or(F.trim(c).contains(" ")), F.lit(False)) if kind == "string" else F.lit(False)).alias("has_blank"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """(column, null_count, row_count) from one scan that looks at nothing but nulls; NaN counts as null."""
    rows = v.fold_nan(df)
    one = rows.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(rows.columns)])
    known = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"k{i}").alias("known")) for i, c in enumerate(rows.columns)])
    return one.select("row_count", F.explode(known).alias("k")).select("k.column", (F.col("row_count") - F.col("k.known")).alias("null_count"), "row_count")


def facts(df: DataFrame, sketches: bool = False) -> DataFrame:
    """(column, dtype, inferred_type, null_count, bounds, has_time, has_blank, row_count, position) from one scan; with `sketches`,
    `distinct_estimate` besides."""
    rows = plain(df)
    more = [F.approx_count_distinct(c, SKETCH_ERROR).alias("distinct_estimate") for c in rows.columns] if sketches else None
    of = lambda i, f: F.struct(_facts(f).alias("f"), more[i]) if sketches else F.struct(_facts(f).alias("f"))
    one = rows.agg(F.count(F.lit(1)).alias("row_count"), *[of(i, f).alias(f"f{i}") for i, f in enumerate(rows.schema)])
    long = one.select("row_count", F.posexplode(F.array(*[F.col(f"f{i}") for i in range(len(rows.columns))])).alias("position", "x")).select("position", "row_count", "x.*").select("position", "row_count", "f.*", *(["distinct_estimate"] if sketches else []))
    dates = F.col("inferred_type") == "datetime"
    return long.withColumns({c: F.when(dates, F.col(c)) for c in ("min_date", "max_date")}).withColumn("has_time", dates & F.col("has_time"))


def _long(df: DataFrame) -> DataFrame:
    rows = plain(df)
    return rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in rows.columns])).alias("r")).select("r.*").where("value IS NOT NULL")


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column, distinct_count), nulls left out, exactly: the values of all columns are shuffled."""
    return _long(df).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))


def near_a_limit(base: DataFrame) -> list[str]:
    """Of rows of `facts` with sketches, the columns whose estimate lies within SKETCH_DEVIATIONS standard deviations of a limit: few
    values, half as many values as rows, or as many as rows. An estimate below the first limit is always counted: it is cheap. The
    driver gets a row for each column."""
    reach = SKETCH_ERROR * SKETCH_DEVIATIONS
    estimate, known = F.col("distinct_estimate"), F.col("row_count") - F.col("null_count")
    near = lambda limit: estimate.between(limit * (1 - reach), limit * (1 + reach))
    whole = (F.col("null_count") == 0) & (estimate >= F.col("row_count") * (1 - reach))
    return [r.column for r in base.where((estimate <= CATEGORICAL_VALUES * (1 + reach)) | near(known * CATEGORICAL_RATIO) | whole).select("column").collect()]


def decided_counts(df: DataFrame, base: DataFrame) -> DataFrame:
    """(column, distinct_count, distinct_exact): exact for the columns that `near_a_limit` names, else the estimate of `base`, rows of
    `facts` with sketches. An estimate is off by more than SKETCH_ERROR in a third of cases, and by SKETCH_DEVIATIONS times that in
    fewer than one in a million, so the flags that depend on a limit are those of exact counts; ratios are off by the same share."""
    near = near_a_limit(base)
    estimates = base.where(~F.col("column").isin(near)).select("column", F.col("distinct_estimate").alias("distinct_count"), F.lit(False).alias("distinct_exact"))
    if not near:
        return estimates
    return distinct_counts(df.select(*[F.col(f"`{c}`") for c in near])).withColumn("distinct_exact", F.lit(True)).unionByName(estimates)


def samples(df: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(column, position, value): the first `n` distinct values in text order."""
    first = Window.partitionBy("column").orderBy("value")
    return _long(df).distinct().withColumn("position", F.row_number().over(first)).where(F.col("position") <= n)


def identifier_name(column: Column) -> Column:
    tokens = v.name_tokens(column)
    last, first = F.try_element_at(tokens, F.lit(-1)), F.try_element_at(tokens, F.lit(1))
    words = lambda xs: F.array(*map(F.lit, xs))
    hint = F.arrays_overlap(tokens, words(ID_TOKENS)) | F.coalesce(last.isin(*ID_ENDS), F.lit(False)) | ((F.size(tokens) > 1) & F.coalesce(first.isin(*ID_STARTS), F.lit(False)))
    return F.coalesce(hint, F.lit(False))


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """All of it: one row for each column, in their order. Not exact: distinct values are counted only where that decides a flag
    (`decided_counts`); columns clear of every limit are not shuffled."""
    if exact:
        base = facts(df).join(distinct_counts(df), "column", "left").withColumn("distinct_exact", F.lit(True))
    else:
        base = stored(facts(df, sketches=True), "facts")
        base = base.join(decided_counts(df, base), "column", "left").drop("distinct_estimate").withColumn("distinct_exact", F.coalesce("distinct_exact", F.lit(True)))
    base = base.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    known = F.col("row_count") - F.col("null_count")
    base = base.withColumn("null_ratio", F.coalesce(F.try_divide("null_count", "row_count"), F.lit(0.0))).withColumn("cardinality_ratio", F.coalesce(F.try_divide("distinct_count", known), F.lit(0.0)))
    base = base.withColumn("is_unique", (F.col("row_count") > 0) & (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count")))
    kind = F.col("inferred_type")
    unique = F.col("is_unique") & (F.col("row_count") >= IDENTIFIER_ROWS) & kind.isin("integer", "string")
    base = base.withColumn("identifier_reasons", F.array_compact(F.array(F.when(identifier_name(F.col("column")), "name"), F.when(unique, "unique_values"))))
    base = base.withColumn("is_identifier_candidate", F.size("identifier_reasons") > 0)
    few = (F.col("distinct_count") <= CATEGORICAL_VALUES) | (F.col("cardinality_ratio") <= CATEGORICAL_RATIO)
    base = base.withColumn("is_categorical", (kind == "boolean") | ((kind == "string") & ~F.col("is_identifier_candidate") & few))
    return base.withColumn("is_numeric", kind.isin("integer", "decimal")).withColumn("is_temporal", kind == "datetime")
