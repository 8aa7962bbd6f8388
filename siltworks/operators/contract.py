"""Data contracts: one row or rule for each column; generated from a profile, checked for many files in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions import values as v

RULE_SCHEMA = "column string, type string, nullable boolean, min double, max double, unique boolean"
VALIDATED = "VALIDATED"


def rule_rows(spark: SparkSession, contract: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame([(c, r.get("type"), r.get("nullable"), _float(r.get("min")), _float(r.get("max")), bool(r.get("unique", False))) for c, r in contract.items()], RULE_SCHEMA)


def _float(x):
    return None if x is None else float(x)


def generate(profile: DataFrame, roles: DataFrame, keys: DataFrame) -> DataFrame:
    """Rules from a profile, its roles and key candidates: type, nullable where nulls were seen, bounds that the role asks for
    and the data meet, unique for primary key candidates."""
    p = profile.join(roles.select("column", "semantic_role", "business_role"), "column").join(keys.where("relationship = 'PRIMARY_KEY_CANDIDATE'").select("column", F.lit(True).alias("unique")), "column", "left")
    kind, role = F.col("inferred_type"), F.col("business_role")
    measure = F.col("semantic_role") == "MEASURE"
    type_ = F.when(measure & (kind == "integer") & role.isin("AMOUNT", "PRICE", "RATIO", "TAX"), "decimal").when(kind.isin("integer", "decimal", "boolean", "datetime"), kind).otherwise("string")
    low, high = F.col("min_number"), F.col("max_number")
    least = F.when(role.isin("AMOUNT", "PRICE", "TAX", "RATIO") & (low >= 0), 0.0).when((role == "QUANTITY") & (low >= 1), 1.0).when((role == "QUANTITY") & (low >= 0), 0.0)
    most = F.when((role == "RATIO") & (low >= 0), F.when(high <= 1, 1.0).when(high <= 100, 100.0))
    return p.select("column", type_.alias("type"), (F.col("null_count") > 0).alias("nullable"), F.when(measure, least).alias("min"), F.when(measure, most).alias("max"), F.coalesce("unique", F.lit(False)).alias("unique"))


def column_issues(spark: SparkSession, columns: list[str], contract: dict[str, dict]) -> DataFrame:
    """(column, issue, severity): contract columns that are missing, and columns that are in no contract."""
    rows = [(c, "missing_column", "error") for c in contract if c not in columns] + [(c, "unexpected_column", "warning") for c in columns if c not in contract]
    return spark.createDataFrame(rows, "column string, issue string, severity string")


def fits(f: T.StructField, kind: str) -> Column:
    """Whether a known value of the column may stand for the contract's type; a column without known values fits every type."""
    c = F.col(f.name)
    text, number = isinstance(f.dataType, T.StringType), isinstance(f.dataType, T.NumericType)
    if kind == "integer":
        return (c % 1 == 0) if number else F.lit(False)
    if kind == "decimal":
        return F.lit(number)
    if kind == "boolean":
        return F.lower(v.strip(c)).isin("true", "false") if text else F.lit(isinstance(f.dataType, T.BooleanType))
    if kind == "datetime":
        return v.to_datetime(c).isNotNull() if text else F.lit(isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)))
    if kind == "string":
        return F.lit(text)
    return F.lit(False)


def rule_counts(df: DataFrame, contract: dict[str, dict], by: str) -> DataFrame:
    """(by, column, rule, n): values that break each rule, for each file, from one scan; only rules that are broken.

    Bounds are checked where the column is a number of the right type.
    """
    specs: list[tuple[str, str, Column]] = []
    for f in df.schema:
        rule = contract.get(f.name)
        if rule is None:
            continue
        c = F.col(f.name)
        specs.append((f.name, "type", c.isNotNull() & ~F.coalesce(fits(f, rule["type"]), F.lit(False))))
        if rule.get("nullable") is False:
            specs.append((f.name, "null", c.isNull()))
        if isinstance(f.dataType, T.NumericType) and rule["type"] in ("integer", "decimal"):
            known = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
            if rule.get("min") is not None:
                specs.append((f.name, "min", known < F.lit(rule["min"])))
            if rule.get("max") is not None:
                specs.append((f.name, "max", known > F.lit(rule["max"])))
    one = df.groupBy(by).agg(*[F.count_if(s[2]).alias(f"n{i}") for i, s in enumerate(specs)])
    rows = one.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"n{i}").alias("n")) for i, (c, r, _) in enumerate(specs)])).alias("t")).select(by, "t.*")
    return rows.where("n > 0")


def unique_counts(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, column, rule, n): known values beyond the distinct ones, for each file."""
    long = df.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("t")).select(by, "t.*").where("value IS NOT NULL")
    return long.groupBy(by, "column", "value").agg(F.count(F.lit(1)).alias("k")).groupBy(by, "column").agg(F.sum(F.col("k") - 1).alias("n")).where("n > 0").select(by, "column", F.lit("unique").alias("rule"), "n")


def report(df: DataFrame, contract: dict[str, dict], by: str) -> DataFrame:
    """(by, valid, errors, warnings) of each file: broken rules and missing columns are errors, unexpected columns warnings."""
    spark = df.sparkSession
    columns = [c for c in df.columns if c != by]
    missing = sum(c not in columns for c in contract)
    extra = sum(c not in contract for c in columns)
    unique = [c for c, r in contract.items() if r.get("unique") and c in columns]
    broken = rule_counts(df, contract, by)
    if unique:
        broken = broken.unionByName(unique_counts(df, unique, by))
    errors = broken.groupBy(by).agg(F.count(F.lit(1)).alias("broken"))
    files = df.select(by).distinct()
    total = F.coalesce("broken", F.lit(0)) + F.lit(missing)
    return files.join(errors, by, "left").select(by, (total == 0).alias("valid"), total.cast("long").alias("errors"), F.lit(extra).cast("long").alias("warnings"))


#: integer and decimal meet; empty meets everything.
def _coarse(kind: Column) -> Column:
    return F.when(kind.isin("integer", "decimal"), "number").otherwise(kind)


def match_structure(files: DataFrame, contracts: DataFrame) -> DataFrame:
    """(file, contract): for files (file, kinds array) the one contract (contract, kinds array) with as many columns of the
    same coarse kinds, in order; none where several match. Files and contracts meet on their number of columns."""
    a = files.select("file", F.transform("kinds", _coarse).alias("x"), F.size("kinds").alias("n"))
    b = contracts.select("contract", F.transform("kinds", _coarse).alias("y"), F.size("kinds").alias("n"))
    same = F.forall(F.zip_with("x", "y", lambda p, q: (p == q) | (p == "empty")), lambda ok: ok)
    return a.join(b, "n").where(same).groupBy("file").agg(F.count(F.lit(1)).alias("k"), F.min("contract").alias("contract")).where("k = 1").select("file", "contract")


def registry(contracts: DataFrame) -> DataFrame:
    """Of contracts (dataset, version, status) the latest validated one of each dataset; one without status counts as validated."""
    last = Window.partitionBy("dataset").orderBy(F.transform(F.split("version", r"\."), lambda x: x.try_cast("int")).desc())
    ok = contracts.withColumn("status", F.coalesce("status", F.lit(VALIDATED))).where(F.col("status") == VALIDATED)
    return ok.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
