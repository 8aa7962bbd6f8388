"""Audit KPIs, measures and explanations; months, extremes and findings where there is little to go by."""

import datetime

import pytest
from pyspark.sql import functions as F

from siltworks.operators import analysis as an
from siltworks.operators import audit, dashboard, gold

KEEP_ALL = gold.Exclusion("kind", ("none",))
RUNS = "run_id string, decision string, execution_mode string, final_status string, duration_seconds double"
STEPS = "run_id string, step_order long, step_name string, status string, duration_seconds double"


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        ("a", "INGEST", "INGEST", "SUCCESS", 1.0),
        ("b", "INGEST", "ASSESS_ONLY", "SUCCESS", 3.0),
        ("c", "REJECT", "INGEST", "REJECTED", None),
        ("d", "QUARANTINE", "INGEST", "QUARANTINED", 2.0),
        ("e", None, "INGEST", "FAILED", 4.0),
        ("f", None, None, None, None),
    ]
    return spark.createDataFrame(rows, RUNS)


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame([("a", 1, "read", "SUCCESS", 0.2), ("a", 2, "load", "FAILED", 1.0), ("e", 2, "load", "FAILED", None), ("e", 1, "read", None, 0.6), ("d", 1, None, "QUARANTINED", None)], STEPS)


def test_run_kpis_count_modes_and_decisions(spark, runs):
    k = audit.run_kpis(runs).first().asDict()
    assert k == {
        "total_runs": 6, "assess_only_runs": 1, "ingest_runs": 4, "quarantine_runs": 1, "reject_runs": 1, "successful_runs": 2, "failed_runs": 1,
        "success_rate": 0.333333, "quarantine_rate": 0.166667, "reject_rate": 0.166667, "average_duration_seconds": 2.5,
    }
    assert set(audit.run_kpis(runs.where("false")).first()) == {0, 0.0}
    assert audit.run_kpis(runs.where("run_id = 'c'")).first().average_duration_seconds is None


def test_step_kpis_have_an_overall_row(steps):
    got = {(r.scope, r.step_name): tuple(r)[2:] for r in audit.step_kpis(steps).collect()}
    assert got == {("all", None): (5, 2, 0.6, 0.6), ("step", "read"): (2, 0, 1.0, 0.4), ("step", "load"): (2, 2, 0.0, 1.0)}
    assert [tuple(r) for r in audit.step_kpis(steps.where("false")).collect()] == [("all", None, 0, 0, 0.0, None)]


def test_seventeen_measures(runs, steps):
    got = {r.measure: r.value for r in audit.measures(runs, steps).collect()}
    assert list(got) == [m[0] for m in audit.MEASURES] and len(got) == 17
    kpis = audit.run_kpis(runs).first()
    assert (got["Ingest Mode Runs"], got["Ingest Decision Runs"], got["Assess Only Runs"]) == (4, 2, 1)
    assert (got["Total Runs"], got["Success Rate"], got["Average Duration (s)"]) == (kpis.total_runs, kpis.success_rate, kpis.average_duration_seconds)
    assert (got["Succeeded Steps"], got["Step Success Rate"], got["Average Step Duration (s)"]) == (3, 0.6, 0.6)
    none = {r.measure: r.value for r in audit.measures(runs.where("false"), steps).collect()}
    assert none["Step Success Rate"] == 0 and none["Average Duration (s)"] is None and none["Step Executions"] == 0


def test_explanations(runs, steps):
    with_outputs = runs.withColumn("outputs", F.when(F.col("run_id") == "a", F.array(F.lit("x"), F.lit("y"))))
    got = {r.run_id: r for r in audit.explain(with_outputs, steps).collect()}
    assert {k: r.meaning for k, r in got.items()} == {"a": "LOADED", "b": "WOULD_LOAD", "c": "NOT_LOADED", "d": "NOT_LOADED", "e": "NO_DECISION", "f": None}
    assert (got["a"].failed_step, got["e"].failed_step, got["d"].failed_step, got["b"].n_steps) == ("load", "load", None, 0)
    assert got["a"].outputs == ["x", "y"] and got["b"].outputs == [] and got["a"].contract_path is None
    assert audit.explain(runs, steps).where(F.size("outputs") > 0).count() == 0


def test_combined_run_of_many_runs(spark):
    """Steps of a batch of any number of runs are numbered by ranges: no list of a batch is made."""
    n = 20_000
    runs = spark.range(n).select(F.concat(F.lit("r"), "id").alias("run_id"), F.lit("INGEST").alias("decision"), (F.timestamp_seconds((F.col("id") * 7919) % n)).alias("started_at"), F.lit(0.5).alias("duration_seconds"))
    steps = runs.select("run_id", F.explode(F.array(F.lit(2).cast("long"), F.lit(1).cast("long"))).alias("step_order")).withColumns({"step_name": F.lit("s"), "status": F.lit("SUCCESS"), "duration_seconds": F.lit(0.1)})
    out = audit.combined_steps(runs, steps, F.lit("b"))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = out.orderBy("position").select("position", "run_id", "step_order").collect()
    assert [r.position for r in got] == list(range(1, 2 * n + 1))
    order = sorted(range(n), key=lambda i: ((i * 7919) % n, f"r{i}"))
    assert [(r.run_id, r.step_order) for r in got[:6]] == [(f"r{i}", k) for i in order[:3] for k in (1, 2)]
    assert [tuple(r) for r in audit.combined_runs(runs, steps, F.lit("b")).collect()] == [("b", "INGEST", n, 2 * n, n / 2)]


def test_months_all_incomplete_all_count(spark):
    df = spark.createDataFrame([(datetime.datetime(2026, 3, 10), 5.0), (datetime.datetime(2026, 3, 20), 2.0)], "d timestamp, x double").withColumn("kind", F.lit("x"))
    months = an.monthly(df, F.col("x"), "d", KEEP_ALL)
    assert [(str(r.month), r.total, r.incomplete) for r in months.collect()] == [("2026-03-01", 7.0, True)]
    best = an.best_worst(months).first()
    assert (str(best.best_month), best.best_total, best.worst_total, best.mean_total) == ("2026-03-01", 7.0, 7.0, 7.0)
    assert an.month_over_month(months).count() == 0
    two = df.unionByName(spark.createDataFrame([(datetime.datetime(2026, 4, 2), 14.0, "x")], df.schema))
    last = an.month_over_month(an.monthly(two, F.col("x"), "d", KEEP_ALL)).first()
    assert (str(last.month), last.total, last.previous, last.change) == ("2026-04-01", 14.0, 7.0, 1.0)


def test_extremes_need_two_groups(spark):
    rows = [("x", 10.0)] * 5 + [("y", 20.0)] * 5 + [("small", 99.0)] * 4 + [(None, 1.0)] * 9
    df = spark.createDataFrame(rows, "g string, v double")
    one = an.extremes(df, "v", "g").first()
    assert (one.highest, one.highest_mean, one.lowest, one.lowest_mean, one.close) == ("y", 20.0, "x", 10.0, False)
    assert an.extremes(df.where("g = 'x'"), "v", "g").count() == 0
    near = spark.createDataFrame([("x", 100.0)] * 5 + [("y", 101.0)] * 5, "g string, v double")
    assert an.extremes(near, "v", "g").first().close
    zero = spark.createDataFrame([("x", -1.0)] * 5 + [("y", 1.0)] * 5, "g string, v double")
    assert an.extremes(zero, "v", "g").first().close is False


def test_columns_of_many_values_are_no_filters(spark):
    df = spark.range(200).select((F.col("id") % 60).alias("wide"), (F.col("id") % 50).alias("fits"), *[(F.col("id") % k).alias(f"c{k}") for k in (2, 3, 4, 5)], F.lit(None).cast("string").alias("empty"), F.to_date(F.lit("2026-01-01")).alias("d"))
    got = {r.column: r for r in dashboard.filters(df, "d", ["wide", "empty", "fits", "c2", "c3", "c4", "c5"]).collect()}
    assert set(got) == {"d", "fits", "c2", "c3", "c4"} and got["fits"].n_values == 50 and got["c3"].options == "0|1|2"
    assert set(r.column for r in dashboard.filters(df, None, ["wide", "c2"]).collect()) == {"c2"}


def test_split_of_many_values_is_no_chart(spark):
    df = spark.range(60).select((F.col("id") % 6).alias("six"), F.when(F.col("id") > 0, F.col("id") % 5).alias("five"), F.lit(1.0).alias("x"), F.to_date(F.lit("2026-01-05")).alias("d"), F.lit("x").alias("kind"))
    assert dashboard.month_split(df, F.col("x"), "d", "six", KEEP_ALL).count() == 0
    assert dashboard.month_split(df, F.col("x"), "d", "five", KEEP_ALL).count() == 6


def test_cited_numbers(spark):
    texts = ["12 345,6 k then 7", "1,67 Md and 40 %", "in 2024 or 31", "A50 x", "3 milliards d'euros, 5 millionième", "50 Mx 50 km", "60 000 and 1.5M"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = sorted((r.i, r.cited, round(r.value, 3), round(r.half, 3)) for r in an.cited_numbers(df, ["i"], "t").collect())
    assert got == sorted([
        (0, "12 345,6 k", 12345600.0, 50.0), (1, "1,67 Md", 1.67e9, 5e6), (1, "40 %", 40.0, 0.5), (4, "3 milliards", 3e9, 5e8), (4, "5 million", 5e6, 5e5), (5, "50", 50.0, 0.5), (5, "50", 50.0, 0.5),
        (6, "60 000", 60000.0, 0.5), (6, "1.5M", 1.5e6, 5e4),
    ])
