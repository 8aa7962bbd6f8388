"""Quality rules for each file, their severity, and what is decided about the file's rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import values as v


@dataclass(frozen=True)
class ValueRule:
    """kind: numeric (null is not), positive, not_negative or not_blank."""

    column: str
    kind: str

    def broken(self) -> Column:
        c = F.col(self.column)
        if self.kind == "numeric":
            return v.to_number(c).isNull()
        if self.kind == "positive":
            return v.to_number(c) <= 0
        if self.kind == "not_negative":
            return v.to_number(c) < 0
        if self.kind == "not_blank":
            return F.coalesce(v.strip(c.cast("string")), F.lit("")) == ""
        raise ValueError(f"no rule {self.kind}")


RULES = (ValueRule("quantity", "numeric"), ValueRule("quantity", "positive"), ValueRule("unit_price", "numeric"), ValueRule("unit_price", "not_negative"), ValueRule("product", "not_blank"))


def issues(df: DataFrame, by: str, rules: tuple[ValueRule, ...] = RULES) -> DataFrame:
    """(by, issue, column, n) of each file: nulls of each column, repeated rows, broken value rules; all from one scan, whose
    equal rows are counted first."""
    columns = [c for c in df.columns if c != by]
    specs = [("null", c, F.col(c).isNull()) for c in columns] + [(r.kind, r.column, r.broken()) for r in rules if r.column in columns]
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_k"))
    times = [F.sum(F.when(s[2], F.col("_k")).otherwise(0)) for s in specs] + [F.sum(F.col("_k") - 1)]
    one = rows.groupBy(by).agg(*[n.alias(f"n{i}") for i, n in enumerate(times)])
    names = [(k, c) for k, c, _ in specs] + [("duplicate", "*")]
    return one.select(by, F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, (k, c) in enumerate(names)])).alias("t")).select(by, "t.*").where("n > 0")


def with_severity(found: DataFrame, contract: dict[str, dict]) -> DataFrame:
    """Repeated rows, and nulls of columns that may be null, are warnings; all else blocks."""
    nullable = [c for c, r in contract.items() if r.get("nullable")]
    mild = (F.col("issue") == "duplicate") | ((F.col("issue") == "null") & F.col("column").isin(*nullable))
    return found.withColumn("severity", F.when(mild, "WARNING").otherwise("BLOCKING"))


#: issue -> (step that corrects it, whether it must be approved).
CORRECTIONS = {"duplicate": ("deduplicate_rows", True), "null": ("fill_null_dimensions", True)}


def corrections(found: DataFrame, approved: bool) -> DataFrame:
    """The warnings, with the step that corrects each and whether it will run."""
    step = F.lit(None).cast("string")
    runs = F.lit(False)
    for issue, (name, must) in CORRECTIONS.items():
        step = F.when(F.col("issue") == issue, name).otherwise(step)
        runs = F.when(F.col("issue") == issue, F.lit(approved or not must)).otherwise(runs)
    return found.where("severity = 'WARNING'").select("*", step.alias("step"), runs.alias("will_run"))


def decide(report: DataFrame, found: DataFrame, by: str, contract_status: str = "VALIDATED") -> DataFrame:
    """(by, decision, rule) of each file: contract errors reject; a contract that is not validated, or a blocking issue, puts in
    quarantine; warnings and clean files go in."""
    of_file = found.groupBy(by).agg(F.count_if(F.col("severity") == "BLOCKING").alias("blocking"), F.count_if(F.col("severity") == "WARNING").alias("warning"))
    both = report.join(of_file, by, "left")
    rule = (
        F.when(F.col("errors") > 0, "CONTRACT_VIOLATION")
        .when(F.lit(contract_status != "VALIDATED"), "CONTRACT_NOT_VALIDATED")
        .when(F.col("blocking") > 0, "QUALITY_ISSUES")
        .when((F.col("warning") > 0) | (F.col("warnings") > 0), "PASSED_WITH_WARNINGS")
        .otherwise("ALL_CHECKS_PASSED")
    )
    decision = F.when(F.col("rule") == "CONTRACT_VIOLATION", "REJECT").when(F.col("rule").isin("CONTRACT_NOT_VALIDATED", "QUALITY_ISSUES"), "QUARANTINE").otherwise("INGEST")
    return both.withColumn("rule", rule).select(by, decision.alias("decision"), "rule")


def batch_decision(decisions: DataFrame) -> DataFrame:
    """The decision of all files if they share one, else PARTIAL; with counts."""
    return decisions.agg(
        F.when(F.count_distinct("decision") == 1, F.min("decision")).otherwise("PARTIAL").alias("decision"),
        F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in ("INGEST", "QUARANTINE", "REJECT")],
    )


def route(df: DataFrame, decisions: DataFrame, by: str) -> DataFrame:
    """The rows with their file's decision and rule; written with partitionBy('decision'), each kind lies apart."""
    return df.join(decisions.select(by, "decision", "rule"), by)


def admitted(df: DataFrame, decisions: DataFrame, by: str) -> DataFrame:
    return df.join(decisions.where("decision = 'INGEST'").select(by), by, "left_semi")
