"""Queries over audit records, which are derived from events: ten events are a run, each event one of its steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import audit, gold
from siltworks.sources.work import fresh_path, stored

from .sales import CANCELLED, METRICS, silver
from .views import AUDIT_RUNS, AUDIT_STEPS, SILVER, audit_runs, audit_steps, text_dates, text_dates_sql

BOTH = f"{AUDIT_RUNS}, {AUDIT_STEPS}"


def _records(spark, sf_dir):
    return audit.nested(audit_runs(spark, sf_dir), audit_steps(spark, sf_dir))


def _json(spark, sf_dir):
    """Records written as JSON lines and read back."""
    path = fresh_path(spark, "audit-json")
    audit.append(_records(spark, sf_dir), path)
    schema = "run_id string, source_file string, decision string, execution_mode string, final_status string, started_at timestamp_ntz, duration_seconds double, steps array<struct<step_order: bigint, step_name: string, status: string, started_at: timestamp_ntz, duration_seconds: double>>"
    return spark.read.schema(schema).json(path)


def audit_append(spark, sf_dir):
    """Runs of each decision, and those without, appended one after the other; the log's lines, and whether each is one run's JSON."""
    path = fresh_path(spark, "audit-log")
    records = stored(_records(spark, sf_dir), "records")
    for decision in ("INGEST", "QUARANTINE", "REJECT", None):
        audit.append(records.where(F.col("decision").eqNullSafe(decision)), path)
    lines = spark.read.text(path)
    of_line = F.get_json_object("value", "$.decision")
    return lines.groupBy(of_line.alias("decision")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct(F.get_json_object("value", "$.run_id")).alias("runs"))


def audit_runs_query(spark, sf_dir):
    return audit.run_rows(_json(spark, sf_dir)).select("run_id", "source_file", "decision", "execution_mode", "final_status", F.round("duration_seconds", 2).alias("duration_seconds"))


def audit_steps_query(spark, sf_dir):
    return audit.step_rows(_json(spark, sf_dir)).select("run_id", "step_order", "step_name", "status", "duration_seconds")


def audit_structured(spark, sf_dir):
    runs, steps = audit.structured(audit_runs(spark, sf_dir), audit_steps(spark, sf_dir))
    out = stored(steps, "structured-steps")
    return out.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_steps")).join(stored(runs, "structured-runs"), "run_id").select("run_id", "execution_mode", "n_steps")


def audit_normalize(spark, sf_dir):
    """Text columns of a source brought to the fixed schema; some timestamps are none."""
    bad = F.when(F.substring("run_id", -1, 1) == "7", "soon").otherwise(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))
    source = audit_runs(spark, sf_dir).select("run_id", "decision", bad.alias("started_at"), F.col("duration_seconds").cast("string").alias("duration_seconds"))
    rows = audit.normalise(source, audit.RUNS)
    return rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.count("started_at").alias("started"), F.count("error").alias("errors"), F.round(F.sum("duration_seconds"), 2).alias("duration"))


def obs_runs(spark, sf_dir):
    return audit.run_kpis(audit_runs(spark, sf_dir))


def obs_steps(spark, sf_dir):
    return audit.step_kpis(audit_steps(spark, sf_dir))


def obs_step_status(spark, sf_dir):
    return audit.step_status(audit_steps(spark, sf_dir))


def obs_measures(spark, sf_dir):
    runs, _ = audit.structured(audit_runs(spark, sf_dir), audit_steps(spark, sf_dir))
    return audit.measures(runs, audit_steps(spark, sf_dir))


def audit_summary(spark, sf_dir):
    return audit.summary(audit_runs(spark, sf_dir))


def audit_find(spark, sf_dir):
    return audit.find(audit_runs(spark, sf_dir), decision="INGEST", source_file="file_3").select("run_id", "final_status")


def audit_explain(spark, sf_dir):
    """Runs that were loaded have one output, named by their file; nothing is recorded for others."""
    runs = audit_runs(spark, sf_dir).withColumn("outputs", F.when((F.col("decision") == "INGEST") & (F.col("execution_mode") == "INGEST"), F.array(F.concat(F.lit("silver/"), F.col("source_file")))))
    out = audit.explain(runs, audit_steps(spark, sf_dir))
    return out.select("run_id", "source_file", "execution_mode", "decision", "meaning", "final_status", F.round("duration_seconds", 2).alias("duration_seconds"), "failed_step", "n_steps", F.array_join("outputs", ",").alias("outputs"))


def audit_combined(spark, sf_dir):
    """Each file's admitted runs as one run: its steps with their places."""
    return audit.combined_steps(audit_runs(spark, sf_dir), audit_steps(spark, sf_dir), F.col("source_file")).select("batch_id", "position", "run_id", "step_order", "step_name", "status")


def audit_combined_runs(spark, sf_dir):
    return audit.combined_runs(audit_runs(spark, sf_dir), audit_steps(spark, sf_dir), F.col("source_file"))


def obs_runs_per_day(spark, sf_dir):
    return audit.runs_per_day(audit_runs(spark, sf_dir))


def obs_step_matrix(spark, sf_dir):
    return audit.step_matrix(audit_steps(spark, sf_dir))


def _target(df):
    """Two thirds of the runs, or of their steps, as they stand in the target."""
    return df.where(F.regexp_extract("run_id", r"\d+", 0).cast("long") % 3 > 0)


def _store(spark, runs, steps):
    """A store that two thirds of the runs are loaded to."""
    store = audit.AuditStore(spark, fresh_path(spark, "audit-store"))
    store.load(_target(runs), _target(steps), "first")
    return store


def load_new_runs(spark, sf_dir):
    runs = audit_runs(spark, sf_dir)
    twice = runs.unionByName(runs.where(F.col("decision") == "REJECT"))
    return _store(spark, runs, audit_steps(spark, sf_dir)).new_runs(twice).select("run_id", "decision", "final_status")


def load_new_steps(spark, sf_dir):
    runs, steps = audit.structured(audit_runs(spark, sf_dir), audit_steps(spark, sf_dir))
    return _store(spark, runs, steps).new_steps(audit_steps(spark, sf_dir).unionByName(steps.where("step_order = 1")), runs).select("run_id", "step_order", "step_name")


def load_align(spark, sf_dir):
    source = audit_runs(spark, sf_dir).select("run_id", F.when(F.col("decision") == "REJECT", "n/a").otherwise(F.col("duration_seconds").cast("string")).alias("duration_seconds"), F.lit("eu").alias("zone"))
    rows = audit.aligned(source, audit.RUNS)
    return rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.count("duration_seconds").alias("known"), F.count("contract_path").alias("paths"))


def load_twice(spark, sf_dir):
    """Two thirds loaded, then everything, then everything again, then the second batch once more: the last two loads add nothing."""
    runs, steps = audit_runs(spark, sf_dir), audit_steps(spark, sf_dir)
    store = _store(spark, runs, steps)
    first = store.log.find("first")
    counts = [(first["runs"], first["steps"]), store.load(runs, steps, "second"), store.load(runs, steps), store.load(runs, steps, "second")]
    rows = [(i, a, b) for i, (a, b) in enumerate(counts, 1)]
    total = store.runs().agg(F.count(F.lit(1)).alias("runs_in_all")).join(store.steps().agg(F.count(F.lit(1)).alias("steps_in_all")), F.lit(True))
    return spark.createDataFrame(rows, "load_number int, new_runs long, new_steps long").join(total, F.lit(True))


def load_full(spark, sf_dir):
    path = fresh_path(spark, "full")
    for part in (_target(audit_runs(spark, sf_dir)), audit_runs(spark, sf_dir)):
        part.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def _gold_tables(spark, sf_dir):
    s = stored(silver(spark, sf_dir), "silver")
    return {"by_month": gold.aggregate(s, ["year", "month"], METRICS, CANCELLED), "by_region": gold.aggregate(s, ["region"], METRICS, CANCELLED), "by_status": gold.aggregate(s, ["status"], METRICS, CANCELLED)}


def _manifest(tables):
    out = None
    for name, frame in tables.items():
        row = frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("run_1").alias("run_id"), F.lit("sales").alias("dataset"), F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def gold_manifest(spark, sf_dir):
    return _manifest(_gold_tables(spark, sf_dir))


def gold_load_pending(spark, sf_dir):
    """The manifest of this run, loaded; then what is pending of it and of a newer run, with the rows that each table is read with."""
    tables = _gold_tables(spark, sf_dir)
    manifest = stored(_manifest(tables), "manifest")
    store = audit.GoldStore(spark, fresh_path(spark, "gold"))
    store.load(manifest, tables)
    newer = manifest.withColumn("run_id", F.lit("run_2"))
    pending = audit.pending_loads(manifest.unionByName(newer), store.loads())
    read = None
    for name in tables:
        row = store.table(name).agg(F.count(F.lit(1)).alias("rows_read")).select(F.lit(name).alias("table_name"), "rows_read")
        read = row if read is None else read.unionByName(row)
    return pending.join(F.broadcast(read), "table_name")


def bronze_rows_by_file(spark, sf_dir):
    """Raw rows written with their file and time, counted back by file."""
    from .views import dirty_sales

    raw = stored(dirty_sales(spark, sf_dir).withColumn("_ingested_at", F.current_timestamp()), "bronze")
    return raw.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_ingested_at").isNotNull()).alias("stamped"))


_RATE = "coalesce(round(count(*) FILTER (WHERE {}) / nullif(count(*), 0), 6), 0)"
_OBS = f"""SELECT count(*) AS total_runs, count(*) FILTER (WHERE execution_mode = 'ASSESS_ONLY') AS assess_only_runs, count(*) FILTER (WHERE execution_mode = 'INGEST') AS ingest_runs,
 count(*) FILTER (WHERE decision = 'QUARANTINE') AS quarantine_runs, count(*) FILTER (WHERE decision = 'REJECT') AS reject_runs, count(*) FILTER (WHERE final_status = 'SUCCESS') AS successful_runs, count(*) FILTER (WHERE final_status = 'FAILED') AS failed_runs,
 {_RATE.format("final_status = 'SUCCESS'")} AS success_rate, {_RATE.format("decision = 'QUARANTINE'")} AS quarantine_rate, {_RATE.format("decision = 'REJECT'")} AS reject_rate,
 CASE WHEN count(*) = 0 THEN 0.0 ELSE round(avg(duration_seconds), 6) END AS average_duration_seconds FROM audit_runs"""
_STEP_VALUES = "count(*) AS executions, count(*) FILTER (WHERE status = 'FAILED') AS failed_executions, coalesce(round(count(*) FILTER (WHERE status IS DISTINCT FROM 'FAILED') / nullif(count(*), 0), 6), 0) AS success_rate, round(avg(duration_seconds), 6) AS average_duration_seconds"
_RUN_MEASURES = {
    "Total Runs": "count(*)", "Successful Runs": "count(*) FILTER (WHERE final_status = 'SUCCESS')", "Failed Runs": "count(*) FILTER (WHERE final_status = 'FAILED')",
    "Assess Only Runs": "count(*) FILTER (WHERE execution_mode = 'ASSESS_ONLY')", "Ingest Mode Runs": "count(*) FILTER (WHERE execution_mode = 'INGEST')", "Ingest Decision Runs": "count(*) FILTER (WHERE decision = 'INGEST')",
    "Quarantine Runs": "count(*) FILTER (WHERE decision = 'QUARANTINE')", "Reject Runs": "count(*) FILTER (WHERE decision = 'REJECT')",
    "Success Rate": _RATE.format("final_status = 'SUCCESS'"), "Quarantine Rate": _RATE.format("decision = 'QUARANTINE'"), "Reject Rate": _RATE.format("decision = 'REJECT'"), "Average Duration (s)": "avg(duration_seconds)",
}
_STEP_MEASURES = {
    "Step Executions": "count(*)", "Failed Steps": "count(*) FILTER (WHERE status = 'FAILED')", "Succeeded Steps": "count(*) FILTER (WHERE status IS DISTINCT FROM 'FAILED')",
    "Step Success Rate": _RATE.format("status IS DISTINCT FROM 'FAILED'"), "Average Step Duration (s)": "avg(duration_seconds)",
}
_STRUCTURED = f"{BOTH}, own AS (SELECT * FROM audit_runs WHERE execution_mode IN ('ASSESS_ONLY', 'INGEST')), own_steps AS (SELECT * FROM audit_steps WHERE run_id IN (SELECT run_id FROM own))"
_IN_TARGET = "CAST(regexp_extract(run_id, '[0-9]+') AS BIGINT) % 3 > 0"
_COUNT = lambda t: f"(SELECT count(*) FROM {t})"

ORACLES = {
    "audit_runs": f"WITH {BOTH} SELECT run_id, source_file, decision, execution_mode, final_status, round(duration_seconds, 2) AS duration_seconds FROM audit_runs",
    "audit_append": f"WITH {AUDIT_RUNS} SELECT decision, count(*) AS lines, count(DISTINCT run_id) AS runs FROM audit_runs GROUP BY 1",
    "audit_steps": f"WITH {BOTH} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step_order) AS step_order, step_name, status, duration_seconds FROM audit_steps",
    "audit_structured": f"WITH {_STRUCTURED} SELECT run_id, execution_mode, count(*) AS n_steps FROM own JOIN own_steps USING (run_id) GROUP BY 1, 2",
    "audit_normalize": f"WITH {AUDIT_RUNS} SELECT decision, count(*) AS n, count(*) FILTER (WHERE right(run_id, 1) <> '7') AS started, CAST(0 AS BIGINT) AS errors, round(sum(duration_seconds), 2) AS duration FROM audit_runs GROUP BY 1",
    "obs_runs": f"WITH {AUDIT_RUNS} {_OBS}",
    "obs_steps": f"WITH {AUDIT_STEPS} SELECT 'all' AS scope, CAST(NULL AS VARCHAR) AS step_name, {_STEP_VALUES} FROM audit_steps UNION ALL SELECT 'step', step_name, {_STEP_VALUES} FROM audit_steps WHERE step_name IS NOT NULL GROUP BY step_name",
    "obs_step_status": f"WITH {AUDIT_STEPS} SELECT step_name, status, count(*) AS n FROM audit_steps GROUP BY 1, 2",
    "obs_measures": f"WITH {_STRUCTURED} " + " UNION ALL ".join([f"SELECT '{n}' AS measure, round(CAST({e} AS DOUBLE), 6) AS value FROM own" for n, e in _RUN_MEASURES.items()] + [f"SELECT '{n}', round(CAST({e} AS DOUBLE), 6) FROM own_steps" for n, e in _STEP_MEASURES.items()]),
    "audit_summary": f"WITH {AUDIT_RUNS} SELECT decision, final_status, count(*) AS n FROM audit_runs GROUP BY 1, 2",
    "audit_find": f"WITH {AUDIT_RUNS} SELECT run_id, final_status FROM audit_runs WHERE decision = 'INGEST' AND source_file = 'file_3'",
    "audit_explain": f"WITH {BOTH}, f AS (SELECT run_id, count(*) AS n, arg_min(step_name, step_order) FILTER (WHERE status = 'FAILED') AS failed_step FROM audit_steps GROUP BY 1) SELECT r.run_id, source_file, execution_mode, decision, CASE WHEN decision IN ('QUARANTINE', 'REJECT') THEN 'NOT_LOADED' WHEN decision = 'INGEST' AND execution_mode = 'INGEST' THEN 'LOADED' WHEN decision = 'INGEST' AND execution_mode = 'ASSESS_ONLY' THEN 'WOULD_LOAD' WHEN decision IS NULL AND execution_mode <> '' THEN 'NO_DECISION' END AS meaning, final_status, round(duration_seconds, 2) AS duration_seconds, failed_step, coalesce(n, 0) AS n_steps, CASE WHEN decision = 'INGEST' AND execution_mode = 'INGEST' THEN concat('silver/', source_file) ELSE '' END AS outputs FROM audit_runs r LEFT JOIN f ON f.run_id = r.run_id",
    "audit_combined": f"WITH {BOTH} SELECT source_file AS batch_id, row_number() OVER (PARTITION BY source_file ORDER BY r.started_at, r.run_id, step_order) AS position, r.run_id, step_order, step_name, status FROM audit_runs r JOIN audit_steps s ON s.run_id = r.run_id WHERE decision = 'INGEST'",
    "audit_combined_runs": f"WITH {BOTH}, n AS (SELECT run_id, count(*) AS n FROM audit_steps GROUP BY 1) SELECT source_file AS batch_id, 'INGEST' AS decision, count(*) AS n_runs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_steps, coalesce(CAST(sum(CAST(duration_seconds AS DECIMAL(18,2))) AS DOUBLE), 0) AS duration_seconds FROM audit_runs r LEFT JOIN n ON n.run_id = r.run_id WHERE decision = 'INGEST' GROUP BY 1",
    "obs_runs_per_day": text_dates_sql(f"WITH {AUDIT_RUNS} SELECT CAST(started_at AS DATE) AS day, count(*) AS n FROM audit_runs GROUP BY 1", "day"),
    "obs_step_matrix": f"WITH {AUDIT_STEPS} SELECT step_name, count(*) FILTER (WHERE status = 'SUCCESS') AS SUCCESS, count(*) FILTER (WHERE status = 'FAILED') AS FAILED, count(*) FILTER (WHERE status IS NULL) AS UNKNOWN FROM audit_steps GROUP BY 1",
    "load_new_runs": f"WITH {AUDIT_RUNS} SELECT run_id, decision, final_status FROM audit_runs WHERE NOT ({_IN_TARGET})",
    "load_new_steps": f"WITH {_STRUCTURED} SELECT run_id, step_order, step_name FROM own_steps WHERE NOT ({_IN_TARGET})",
    "load_align": f"WITH {AUDIT_RUNS} SELECT 'eu' AS zone, count(*) AS n, count(*) FILTER (WHERE decision IS DISTINCT FROM 'REJECT' AND duration_seconds IS NOT NULL) AS known, CAST(0 AS BIGINT) AS paths FROM audit_runs",
    "load_twice": f"WITH {BOTH} SELECT CAST(i AS INTEGER) AS load_number, a AS new_runs, b AS new_steps, {_COUNT('audit_runs')} AS runs_in_all, {_COUNT('audit_steps')} AS steps_in_all FROM (SELECT 1 AS i, (SELECT count(*) FROM audit_runs WHERE {_IN_TARGET}) AS a, (SELECT count(*) FROM audit_steps WHERE {_IN_TARGET}) AS b UNION ALL SELECT 2, (SELECT count(*) FROM audit_runs WHERE NOT ({_IN_TARGET})), (SELECT count(*) FROM audit_steps WHERE NOT ({_IN_TARGET})) UNION ALL SELECT 3, 0, 0 UNION ALL SELECT 4, (SELECT count(*) FROM audit_runs WHERE NOT ({_IN_TARGET})), (SELECT count(*) FROM audit_steps WHERE NOT ({_IN_TARGET})))",
    "load_full": f"WITH {AUDIT_RUNS} SELECT decision, count(*) AS n FROM audit_runs GROUP BY 1",
    "gold_manifest": f"WITH {SILVER}, k AS (SELECT * FROM silver WHERE status IS NULL OR status <> 'CANCELLED') SELECT 'run_1' AS run_id, 'sales' AS dataset, * FROM (SELECT 'by_month' AS table_name, count(DISTINCT year * 100 + month) AS rows FROM k UNION ALL SELECT 'by_region', count(DISTINCT region) FROM k UNION ALL SELECT 'by_status', count(DISTINCT coalesce(status, '?')) FROM k)",
    "gold_load_pending": f"WITH {SILVER}, k AS (SELECT * FROM silver WHERE status IS NULL OR status <> 'CANCELLED') SELECT 'run_2' AS run_id, 'sales' AS dataset, *, rows AS rows_read FROM (SELECT 'by_month' AS table_name, count(DISTINCT year * 100 + month) AS rows FROM k UNION ALL SELECT 'by_region', count(DISTINCT region) FROM k UNION ALL SELECT 'by_status', count(DISTINCT coalesce(status, '?')) FROM k)",
    "bronze_rows_by_file": f"WITH {SILVER} SELECT source_file, count(*) AS rows, count(*) AS stamped FROM dirty_sales GROUP BY 1",
}

QUERIES = {
    f.__name__.removesuffix("_query"): (lambda spark, sf_dir, f=f: text_dates(f(spark, sf_dir)))
    for f in (
        audit_append, audit_runs_query, audit_steps_query, audit_structured, audit_normalize, obs_runs, obs_steps, obs_step_status, obs_measures, audit_summary, audit_find, audit_explain, audit_combined, audit_combined_runs, obs_runs_per_day, obs_step_matrix,
        load_new_runs, load_new_steps, load_align, load_twice, load_full, gold_manifest, gold_load_pending, bronze_rows_by_file,
    )
}
