"""Audit tables: run and step rows, KPIs and measures over them, explanations, and incremental loads."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions import values as v
from siltworks.functions.running import running_sum
from siltworks.sources.bucketed import BUCKETS, BucketedTable, by_bucket_key
from siltworks.sources.commits import CommitLog

RUNS = T.StructType().add("run_id", "string").add("source_file", "string").add("contract_path", "string").add("decision", "string").add("execution_mode", "string").add("final_status", "string").add("started_at", "timestamp_ntz").add("finished_at", "timestamp_ntz").add("duration_seconds", "double").add("error", "string")
STEPS = T.StructType().add("run_id", "string").add("step_order", "long").add("step_name", "string").add("status", "string").add("started_at", "timestamp_ntz").add("finished_at", "timestamp_ntz").add("duration_seconds", "double").add("error", "string")
STRUCTURED_MODES = ("ASSESS_ONLY", "INGEST")


def normalise(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a fixed schema: missing ones null, values that do not fit null."""
    def column(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampNTZType) and isinstance(df.schema[f.name].dataType, T.StringType):
            return v.to_datetime(c).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.LongType)) and isinstance(df.schema[f.name].dataType, T.StringType):
            return v.to_number(c).cast(f.dataType).alias(f.name)
        return c.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema])


def nested(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Audit records: runs with an array of their steps, in order."""
    own = steps.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("step_order", "step_name", "status", "started_at", "duration_seconds"))).alias("steps"))
    return runs.join(own, "run_id", "left")


def run_rows(records: DataFrame) -> DataFrame:
    return normalise(records.drop("steps"), RUNS)


def step_rows(records: DataFrame) -> DataFrame:
    """One row for each step, numbered from 1 in the record's order."""
    rows = records.select("run_id", F.posexplode("steps").alias("pos", "s")).select("run_id", (F.col("pos") + 1).cast("long").alias("step_order"), F.col("s.step_name"), F.col("s.status"), F.col("s.started_at"), F.col("s.duration_seconds"))
    return normalise(rows, STEPS)


def structured(runs: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of a structured mode, and their steps."""
    own = runs.where(F.col("execution_mode").isin(*STRUCTURED_MODES))
    return own, steps.join(own.select("run_id"), "run_id", "left_semi")


def _is(column: str, value: str) -> Column:
    """A null is no value."""
    return F.col(column).eqNullSafe(value)


def run_kpis(runs: DataFrame) -> DataFrame:
    """Eleven values over all runs, zeros for none. Runs are counted by mode (assess only, ingest), by decision (quarantine, reject)
    and by final status; the mean is of known durations."""
    n = F.count(F.lit(1))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), n), F.lit(0.0)), 6)
    return runs.agg(
        n.alias("total_runs"),
        F.count_if(_is("execution_mode", "ASSESS_ONLY")).alias("assess_only_runs"),
        F.count_if(_is("execution_mode", "INGEST")).alias("ingest_runs"),
        F.count_if(_is("decision", "QUARANTINE")).alias("quarantine_runs"),
        F.count_if(_is("decision", "REJECT")).alias("reject_runs"),
        F.count_if(_is("final_status", "SUCCESS")).alias("successful_runs"),
        F.count_if(_is("final_status", "FAILED")).alias("failed_runs"),
        share(_is("final_status", "SUCCESS")).alias("success_rate"),
        share(_is("decision", "QUARANTINE")).alias("quarantine_rate"),
        share(_is("decision", "REJECT")).alias("reject_rate"),
        F.when(n == 0, 0.0).otherwise(F.round(F.avg("duration_seconds"), 6)).alias("average_duration_seconds"),
    )


def step_kpis(steps: DataFrame) -> DataFrame:
    """(scope, step_name, executions, failed_executions, success_rate, average_duration_seconds): one row over all steps (scope "all",
    also for none), and one for each step name. A step is a success unless it is FAILED, unknown included; the mean is of known
    durations and null without any."""
    own = steps.groupBy("step_name").agg(
        F.count(F.lit(1)).alias("executions"), F.count_if(_is("status", "FAILED")).alias("failed_executions"), F.sum("duration_seconds").alias("_sum"), F.count("duration_seconds").alias("_known")
    )
    whole = own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("executions", "failed_executions", "_known")], F.sum("_sum").alias("_sum"))
    rows = whole.select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("step_name"), *own.columns[1:]).unionByName(own.where("step_name IS NOT NULL").select(F.lit("step").alias("scope"), "*"))
    rate = F.coalesce(F.try_divide(F.col("executions") - F.col("failed_executions"), F.col("executions")), F.lit(0.0))
    return rows.select("scope", "step_name", "executions", "failed_executions", F.round(rate, 6).alias("success_rate"), F.round(F.try_divide("_sum", "_known"), 6).alias("average_duration_seconds"))


def step_status(steps: DataFrame) -> DataFrame:
    return steps.groupBy("step_name", "status").agg(F.count(F.lit(1)).alias("n"))


#: The measures of an observability model by name, in order: what they are of, and how. A rate is one measure by another.
MEASURES = (
    ("Total Runs", "runs", "count", None, None),
    ("Successful Runs", "runs", "where", "final_status", "SUCCESS"),
    ("Failed Runs", "runs", "where", "final_status", "FAILED"),
    ("Assess Only Runs", "runs", "where", "execution_mode", "ASSESS_ONLY"),
    ("Ingest Mode Runs", "runs", "where", "execution_mode", "INGEST"),
    ("Ingest Decision Runs", "runs", "where", "decision", "INGEST"),
    ("Quarantine Runs", "runs", "where", "decision", "QUARANTINE"),
    ("Reject Runs", "runs", "where", "decision", "REJECT"),
    ("Success Rate", "runs", "rate", "Successful Runs", "Total Runs"),
    ("Quarantine Rate", "runs", "rate", "Quarantine Runs", "Total Runs"),
    ("Reject Rate", "runs", "rate", "Reject Runs", "Total Runs"),
    ("Average Duration (s)", "runs", "mean", "duration_seconds", None),
    ("Step Executions", "steps", "count", None, None),
    ("Failed Steps", "steps", "where", "status", "FAILED"),
    ("Succeeded Steps", "steps", "not where", "status", "FAILED"),
    ("Step Success Rate", "steps", "rate", "Succeeded Steps", "Step Executions"),
    ("Average Step Duration (s)", "steps", "mean", "duration_seconds", None),
)


def measures(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """(measure, value) of MEASURES over the runs and over the steps of these runs. A run's mode and its decision are two things: a
    file that is rejected in INGEST mode counts for both. A rate of none is 0, a mean of none null, and "not" counts nulls."""
    by_name = {m[0]: m for m in MEASURES}

    def value(name: str) -> Column:
        _, _, how, column, wanted = by_name[name]
        if how == "count":
            return F.count(F.lit(1))
        if how == "mean":
            return F.avg(column)
        if how == "rate":
            return F.coalesce(F.try_divide(value(column), value(wanted)), F.lit(0.0))
        return F.count_if(_is(column, wanted) if how == "where" else ~_is(column, wanted))

    def long(df: DataFrame, of: str) -> DataFrame:
        names = [m[0] for m in MEASURES if m[1] == of]
        one = df.agg(*[value(n).cast("double").alias(f"m{i}") for i, n in enumerate(names)])
        return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.round(F.col(f"m{i}"), 6).alias("value")) for i, n in enumerate(names)])).alias("t")).select("t.*")

    own = steps.join(runs.select("run_id").distinct(), "run_id", "left_semi")
    return long(runs, "runs").unionByName(long(own, "steps"))


def summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("decision", "final_status").agg(F.count(F.lit(1)).alias("n"))


def find(runs: DataFrame, run_id: str | None = None, decision: str | None = None, status: str | None = None, source_file: str | None = None) -> DataFrame:
    wanted = {"run_id": run_id, "decision": decision, "final_status": status, "source_file": source_file}
    for c, value in wanted.items():
        if value is not None:
            runs = runs.where(F.col(c) == value)
    return runs


def explain(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """One row for each run: its file, contract, mode, decision, status, times and error as recorded; `meaning`, what the decision
    means in its mode; the first step that failed; the number of steps; and `outputs`, those recorded, else none.

    An admitted run is LOADED in INGEST mode and WOULD_LOAD in ASSESS_ONLY mode. A quarantined or rejected run is NOT_LOADED in any
    mode. A run with a mode but no decision has NO_DECISION. The meaning of any other is not recorded: null."""
    recorded = {c: F.col(c) if c in runs.columns else F.lit(None).cast(RUNS[c].dataType).alias(c) for c in RUNS.names if c != "run_id"}
    admitted, mode = _is("decision", "INGEST"), recorded["execution_mode"]
    meaning = (
        F.when(admitted & mode.eqNullSafe("INGEST"), "LOADED")
        .when(admitted & mode.eqNullSafe("ASSESS_ONLY"), "WOULD_LOAD")
        .when(F.col("decision").isin("QUARANTINE", "REJECT"), "NOT_LOADED")
        .when(F.col("decision").isNull() & (F.coalesce(mode, F.lit("")) != ""), "NO_DECISION")
    )
    outputs = F.coalesce(F.col("outputs"), F.expr("cast(array() as array<string>)")) if "outputs" in runs.columns else F.expr("cast(array() as array<string>)")
    failed = F.when(F.col("status") == "FAILED", F.struct("step_order", "step_name"))
    of_run = steps.groupBy("run_id").agg(F.min(failed)["step_name"].alias("failed_step"), F.count(F.lit(1)).alias("n_steps"))
    own = runs.select("run_id", *recorded.values(), meaning.alias("meaning"), outputs.alias("outputs"))
    return own.join(of_run, "run_id", "left").select("run_id", *recorded, "meaning", "failed_step", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), "outputs")


def combined_runs(runs: DataFrame, steps: DataFrame, batch: Column) -> DataFrame:
    """(batch_id, decision, n_runs, n_steps, duration_seconds): the admitted runs of each batch as one."""
    own = runs.where(_is("decision", "INGEST")).select(batch.alias("batch_id"), "run_id", "duration_seconds")
    numbers = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("_steps"))
    sums = own.join(numbers, "run_id", "left").groupBy("batch_id")
    return sums.agg(F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.sum("_steps"), F.lit(0)).alias("n_steps"), v.money_total(F.col("duration_seconds")).alias("duration_seconds")).select("batch_id", F.lit("INGEST").alias("decision"), "n_runs", "n_steps", "duration_seconds")


def combined_steps(runs: DataFrame, steps: DataFrame, batch: Column) -> DataFrame:
    """(batch_id, position, run_id, step_order, step_name, status, duration_seconds): the steps of a batch's admitted runs one after
    the other, in order of the runs' start, numbered from 1. A row is a step; ranges of rows are numbered by tasks, so a batch may
    hold any number of runs."""
    own = runs.where(_is("decision", "INGEST")).select(batch.alias("batch_id"), "run_id", F.col("started_at").alias("_started"))
    rows = steps.select("run_id", "step_order", "step_name", "status", "duration_seconds").join(own, "run_id")
    order = [F.col("_started").asc_nulls_first(), F.col("run_id").asc(), F.col("step_order").asc()]
    return running_sum(rows, "batch_id", order, F.lit(1).cast("long")).select("batch_id", F.col("running").cast("long").alias("position"), "run_id", "step_order", "step_name", "status", "duration_seconds")


def append(records: DataFrame, path: str) -> None:
    """Appends run records to the audit log under `path`, a JSON line for each run. Each call adds files of its own, so runs that
    are written at once do not meet."""
    records.write.mode("append").json(path)


def runs_per_day(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def step_matrix(steps: DataFrame, statuses: tuple[str, ...] = ("SUCCESS", "FAILED", "UNKNOWN")) -> DataFrame:
    return steps.withColumn("status", F.coalesce("status", F.lit("UNKNOWN"))).groupBy("step_name").pivot("status", list(statuses)).agg(F.count(F.lit(1))).fillna(0)


# -- incremental loads ---------------------------------------------------------------------------


def first_runs(runs: DataFrame) -> DataFrame:
    """One row for each run: the first by (started_at, source_file)."""
    first = Window.partitionBy("run_id").orderBy("started_at", "source_file")
    return runs.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def first_steps(steps: DataFrame) -> DataFrame:
    """One row for each run and step number: the first by (started_at, step_name)."""
    first = Window.partitionBy("run_id", "step_order").orderBy("started_at", "step_name")
    return steps.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def new_runs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source runs that any target frame lacks, one for each id. `AuditStore.new_runs` does this against a store in buckets."""
    return first_runs(source.join(target.select("run_id"), "run_id", "left_anti"))


def new_steps(source_steps: DataFrame, source_runs: DataFrame, target: DataFrame) -> DataFrame:
    """Steps of source runs that any target frame lacks, one for each run and number."""
    keys = ["run_id", "step_order"]
    return first_steps(source_steps.join(source_runs.select("run_id").distinct(), "run_id", "left_semi").join(target.select(*keys), keys, "left_anti"))


def aligned(df: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns in its types (null where a value does not fit), then new columns as they are."""
    return normalise(df, target).select("*") if set(df.columns) <= set(target.names) else df.select(*[c.alias(f.name) for f, c in ((f, F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)) for f in target)], *[c for c in df.columns if c not in target.names])


class AuditStore:
    """Run and step rows under one folder, both in buckets of run_id, that grow by loads. One commit names what a load wrote to both
    tables, so a reader sees a load whole or not at all, wherever it breaks off."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.log = CommitLog(spark, root)
        self.tables = {"runs": BucketedTable(spark, f"{root}/runs", RUNS, "run_id", buckets), "steps": BucketedTable(spark, f"{root}/steps", STEPS, "run_id", buckets)}

    def _loads(self, table: str) -> list[str]:
        return [e["load"] for e in self.log.entries() if e[table]]

    def runs(self) -> DataFrame:
        return self.tables["runs"].read(self._loads("runs"))

    def steps(self) -> DataFrame:
        return self.tables["steps"].read(self._loads("steps"))

    def new_runs(self, source: DataFrame) -> DataFrame:
        """Source runs that the store lacks, one for each id; the store's files are joined bucket by bucket."""
        return first_runs(self.tables["runs"].lacking(source, self._loads("runs"), ["run_id"]))

    def new_steps(self, source_steps: DataFrame, source_runs: DataFrame) -> DataFrame:
        """Steps of source runs that the store lacks, one for each run and number."""
        own = source_steps.join(source_runs.select("run_id").distinct(), "run_id", "left_semi")
        return first_steps(self.tables["steps"].lacking(own, self._loads("steps"), ["run_id", "step_order"]))

    def load(self, source_runs: DataFrame, source_steps: DataFrame, batch: str | None = None) -> tuple[int, int]:
        """Adds what is new and gives its numbers of runs and steps. Steps are written first, then runs, then the commit. A `batch`
        that has its commit adds nothing and gives the numbers of that load."""
        done = self.log.find(batch) if batch is not None else None
        if done:
            return done["runs"], done["steps"]
        load = uuid.uuid4().hex
        runs, steps = normalise(source_runs, RUNS), normalise(source_steps, STEPS)
        counts = {}
        with by_bucket_key(self.spark):
            for name, new in (("steps", self.new_steps(steps, runs)), ("runs", self.new_runs(runs))):
                seen = Observation()
                self.tables[name].write(new.observe(seen, F.count(F.lit(1)).alias("n")), load)
                counts[name] = seen.get["n"]
        if batch is not None or counts["runs"] or counts["steps"]:
            self.log.commit({"batch": batch, "load": load, **counts})
        return counts["runs"], counts["steps"]


def load(source_runs: DataFrame, source_steps: DataFrame, root: str, batch: str | None = None) -> tuple[int, int]:
    """`AuditStore.load` into the store under `root`."""
    return AuditStore(source_runs.sparkSession, root).load(source_runs, source_steps, batch)


def pending_loads(manifest: DataFrame, loads: DataFrame) -> DataFrame:
    """Manifest rows (run_id, dataset, table_name, rows) that `loads` lacks."""
    return manifest.join(loads.select("run_id", "dataset").distinct(), ["run_id", "dataset"], "left_anti")


GOLD_LOADS = "run_id string, dataset string, table_name string, rows long, loaded_at timestamp"


class GoldStore:
    """Gold tables under one folder. Each load writes a folder of its own for each table, and its commit holds the folder that every
    table is read from. That is the pointer: until it is in place, all tables are read as they were."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, root)

    def folders(self) -> dict[str, str]:
        """The folder of each table that holds its rows now."""
        last = self.log.last()
        return last["folders"] if last else {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.folders()[name]}")

    def loads(self) -> DataFrame:
        """The log of loads, a row for each run, dataset and table. A commit holds a row for each of its tables."""
        rows = [(*r, datetime.fromisoformat(e["loaded_at"])) for e in self.log.entries() for r in e["loads"]]
        return self.spark.createDataFrame(rows, GOLD_LOADS)

    def load(self, manifest: DataFrame, tables: dict[str, DataFrame]) -> list[str]:
        """Loads the pending tables of the manifest and gives their names. Rows are counted as they are written; if a table's number
        is not the manifest's, or a write fails, nothing is swapped."""
        todo = pending_loads(manifest, self.loads()).orderBy("table_name").collect()
        folders, wrong = {}, []
        for r in todo:
            folders[r.table_name] = f"{r.table_name}/{uuid.uuid4().hex}"
            seen = Observation()
            tables[r.table_name].observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{folders[r.table_name]}")
            if seen.get["n"] != r.rows:
                wrong.append(r.table_name)
        if wrong:
            raise ValueError(f"row counts differ: {', '.join(wrong)}")
        if todo:
            rows = [[r.run_id, r.dataset, r.table_name, r.rows] for r in todo]
            self.log.commit({"folders": self.folders() | folders, "loads": rows, "loaded_at": datetime.now(timezone.utc).isoformat()})
        return list(folders)

    def clean(self) -> list[str]:
        """Removes folders that no table is read from any more, those of broken loads among them, and gives them. Not for a time at
        which the store is read or loaded."""
        keep, gone = set(self.folders().values()), []
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for table in files.listStatus(hadoop.Path(self.root)):
            name = table.getPath().getName()
            if table.isDirectory() and not name.startswith(("_", ".")):
                for version in files.listStatus(table.getPath()):
                    folder = f"{name}/{version.getPath().getName()}"
                    if folder not in keep:
                        files.delete(version.getPath(), True)
                        gone.append(folder)
        return sorted(gone)
