import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from siltworks.operators import analysis as an
from siltworks.operators import audit, contract, dashboard, gold, quality, silver
from siltworks.operators import profile as pf
from siltworks.sources import files
from siltworks.sources.work import fresh_path


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(1, " paid", "2026-01-01", 2, 10.0), (2, "shipped ", "2026-01-02", 1, 5.5), (3, None, "2026-02-01", 3, None), (3, None, "2026-02-01", 3, None), (None, "paid", "2026-02-03", -1, 4.0)]
    return spark.createDataFrame(rows, "`Order ID` int, status string, order_date string, quantity int, unit_price double")


def test_silver_steps(orders):
    steps = [silver.Step("r", "rename"), silver.Step("t", "trim"), silver.Step("c", "cast", {"kinds": {"order_date": "datetime"}}), silver.Step("n", "normalize", {"columns": ["status"]}), silver.Step("i", "impute", {"columns": ["status"]}, True), silver.Step("d", "deduplicate", destructive=True), silver.Step("a", "amount", {"quantity": "quantity", "price": "unit_price"})]
    cleaned = silver.apply_steps(orders, steps, rules={"quantity": {"min": 1}, "order_id": {"nullable": False, "unique": True}})
    assert sorted(r.status for r in cleaned.passed.collect()) == ["PAID", "SHIPPED", "UNKNOWN"]
    assert [r._violations for r in cleaned.quarantined.collect()] == [["quantity:min", "order_id:null"]]
    careful = silver.apply_steps(orders, steps, approved=False)
    assert careful.passed.count() == 5
    assert [(s, o) for s, o, _, _ in careful.counts][4:6] == [("i", "SKIPPED_NOT_APPROVED"), ("d", "SKIPPED_NOT_APPROVED")]


def test_silver_refuses(spark, orders):
    with pytest.raises(ValueError):
        silver.cast(spark.createDataFrame([("2026-01-01",), ("no date",)], "d string"), {"d": "datetime"})
    with pytest.raises(ValueError):
        silver.cast(spark.createDataFrame([(1.5,)], "x double"), {"x": "integer"})
    with pytest.raises(ValueError):
        silver.rename(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))
    with pytest.raises(ValueError):
        silver.enrich(orders, [{"kind": "constant", "value": 1, "target": "status"}])


def test_unique_rule_keeps_the_first(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "x"), (None, "y")], "k int, t string")
    kept = silver.check_rows(df, {"k": {"unique": True}}, ["t"]).where(F.size("_violations") == 0)
    assert sorted((r.k or 0, r.t) for r in kept.collect()) == [(0, "x"), (0, "y"), (1, "a")]


def test_gold(spark):
    df = spark.createDataFrame([("A", 2.0, "CANCELLED"), ("A", 3.0, None), (None, 4.0, "PAID")], "g string, x double, status string")
    gone = gold.Exclusion("status", ("CANCELLED",))
    got = {r.g: (r.s, r.n) for r in gold.aggregate(df, ["g"], [gold.Metric("s", "SUM", "x"), gold.Metric("n", "COUNT", "g")], gone).collect()}
    assert got == {"A": (3.0, 1), None: (4.0, 0)}
    assert gold.aggregate(df.where("false"), [], [gold.Metric("s", "SUM", "x")]).first().s == 0.0
    with pytest.raises(ValueError):
        gold.aggregate(df, ["no"], [])
    wrong = gold.verify_totals(gold.totals(df, ["x"]), {"t": df.where("g IS NOT NULL").withColumnRenamed("x", "s")}, {"s": "x"})
    assert [r.ok for r in wrong.collect()] == [False]


def test_months_without_rows_are_zero(spark):
    df = spark.createDataFrame([("2024-01-15", 1.0), ("2024-03-31", 2.0)], "d string, x double").withColumn("d", F.to_timestamp("d"))
    months = an.monthly(df, F.col("x"), "d", gold.Exclusion("x", (99.0,))).orderBy("month").collect()
    assert [(str(r.month), r.total, r.incomplete) for r in months] == [("2024-01-01", 1.0, True), ("2024-02-01", 0.0, False), ("2024-03-01", 2.0, False)]


def test_cited_numbers(spark):
    texts = spark.createDataFrame([(1, "Up 12,5 % to 3.2 M in 2024, 7 stores and 1 250 lines, 99")], "id int, t string")
    cited = an.cited_numbers(texts, ["id"], "t")
    got = sorted(round(r.value, 4) for r in cited.collect())
    assert got == [12.5, 99.0, 1250.0, 3_200_000.0]
    figures = spark.createDataFrame([(0.126,), (3_190_000.0,), (1250.0,)], "value double")
    assert [r.cited for r in an.unverified(cited, figures, ["id"]).collect()] == ["99"]


def test_cited_units(spark):
    texts = spark.createDataFrame([(1, "1,67 M; 2 Milliards; 3 md; 45 k; 12\u202f345; 1 million; 7 milliers; 67,8 %; 31; 1999; 32 lots")], "id int, t string")
    got = {r.cited: (r.value, r.half) for r in an.cited_numbers(texts, ["id"], "t").collect()}
    want = {"1,67 M": (1.67e6, 5e3), "2 Milliards": (2e9, 5e8), "3 md": (3e9, 5e8), "45 k": (45e3, 500), "12\u202f345": (12345, 0.5), "1 million": (1e6, 5e5), "7 milliers": (7e3, 500), "67,8 %": (67.8, 0.05), "32": (32, 0.5)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want), got
    cited = an.cited_numbers(spark.createDataFrame([(1, "101.4 and 101.6 and 67,8 %")], "id int, t string"), ["id"], "t")
    figures = spark.createDataFrame([(100.0,), (0.678,)], "value double")
    assert [r.cited for r in an.unverified(cited, figures, ["id"]).collect()] == ["101.6"]


def test_clean_file_passes_all_checks(spark):
    report = spark.createDataFrame([("clean", 0, 0), ("warned", 0, 1), ("held", 0, 0), ("bad", 2, 0)], "f string, errors long, warnings long")
    found = spark.createDataFrame([("held", "BLOCKING")], "f string, severity string")
    got = {r.f: (r.decision, r.rule) for r in quality.decide(report, found, "f").collect()}
    assert got == {"clean": ("INGEST", "ALL_CHECKS_PASSED"), "warned": ("INGEST", "PASSED_WITH_WARNINGS"), "held": ("QUARANTINE", "QUALITY_ISSUES"), "bad": ("REJECT", "CONTRACT_VIOLATION")}


def test_quartiles_and_running_sums(spark):
    rng = np.random.default_rng(5)
    values = [float(x) for x in rng.integers(0, 40, 301)]
    df = spark.createDataFrame([(x, None if i % 3 else x * 2) for i, x in enumerate(values)], "a double, b double")
    got = {r.column: (r.q1, r.median, r.q3) for r in an.quartiles(df, ["a", "b"]).collect()}
    other = [x * 2 for i, x in enumerate(values) if not i % 3]
    assert got == {"a": pytest.approx(np.percentile(values, [25, 50, 75])), "b": pytest.approx(np.percentile(other, [25, 50, 75]))}


def test_mean_by_keeps_ends(spark):
    df = spark.createDataFrame([(g, float(g)) for g in range(30)] + [(None, 1.0)], "g int, x double")
    assert sorted(r.group for r in an.mean_by(df, "x", F.col("g")).collect()) == [0, 1, 2, 3, 4, 25, 26, 27, 28, 29]
    assert sorted(r.group for r in an.mean_by(df.where("g < 10"), "x", F.col("g")).collect()) == list(range(10))


def test_pseudonyms_need_a_key(spark):
    df = spark.createDataFrame([("ann",), ("bob",), (None,), ("ann",)], "c string")
    with pytest.raises(ValueError):
        an.pseudonyms(df, "c", "")
    one, two = ([r.c for r in an.pseudonyms(df, "c", k).collect()] for k in ("k1", "k2"))
    assert one[0] == one[3] != one[1] and one[2] is None and one[0] != two[0]


def test_dashboard_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, "2024-01-31"), ("b", 1.0, None, None), (None, 1.0, 9.0, "2024-02-01")], "g string, x double, y double, d string").withColumn("d", F.to_timestamp("d"))
    assert [tuple(r) for r in dashboard.scatter_bins(df, "x", "y").orderBy("y_bin").collect()] == [(0, 0, 1), (0, 19, 1)]
    got = {r.column: r for r in dashboard.filters(df, "d", ["g"], most=2).collect()}
    assert (got["d"].low, got["d"].high) == ("2024-01-31", "2024-02-01")
    assert (got["g"].n_values, got["g"].options) == (2, "a|b")
    assert [r.column for r in dashboard.filters(df, "d", ["g"], most=1).collect()] == ["d"]
    assert dashboard.month_split(df, F.col("x"), "d", "g", gold.Exclusion("g", ("b",))).count() == 2
    assert dashboard.scatter_bins(df.where("false"), "x", "y").count() == 0


def test_profile(spark):
    rows = [(i, "paid" if i % 2 else None, "2026-01-%02d" % (i + 1), float(i), [1, i]) for i in range(12)]
    p = {r.column: r for r in pf.profile(spark.createDataFrame(rows, "order_id int, status string, created string, amount double, tags array<int>")).collect()}
    assert (p["order_id"].identifier_reasons, p["order_id"].is_unique) == (["name", "unique_values"], True)
    assert (p["status"].inferred_type, p["status"].null_count, p["status"].is_categorical) == ("string", 6, True)
    assert p["created"].inferred_type == "datetime" and p["amount"].inferred_type == "integer"
    assert p["tags"].distinct_count == 12
    empty = spark.createDataFrame([(None,), (None,)], "x string")
    assert pf.profile(empty).first().inferred_type == "empty"


def test_contract_and_decisions(spark):
    df = spark.createDataFrame([("f", "abc", 1), ("f", None, 2), ("g", "5", 3), ("g", "5", 3)], "file string, q string, k int")
    rules = {"q": {"type": "integer", "nullable": True}, "k": {"type": "integer", "nullable": False, "min": 2, "unique": True}}
    got = {(r.file, r.column, r.rule): r.n for r in contract.rule_counts(df, rules, "file").collect()}
    assert got == {("f", "q", "type"): 1, ("g", "q", "type"): 2, ("f", "k", "min"): 1}
    assert contract.unique_counts(df, ["k"], "file").first().n == 1
    found = quality.with_severity(quality.issues(df, "file", ()), rules)
    assert {(r.file, r.issue): r.severity for r in found.collect()} == {("f", "null"): "WARNING", ("g", "duplicate"): "WARNING"}
    decisions = quality.decide(spark.createDataFrame([("f", 0, 0), ("g", 1, 0)], "file string, errors int, warnings int"), found, "file")
    assert {r.file: (r.decision, r.rule) for r in decisions.collect()} == {"f": ("INGEST", "PASSED_WITH_WARNINGS"), "g": ("REJECT", "CONTRACT_VIOLATION")}
    assert quality.batch_decision(decisions).first().decision == "PARTIAL"


def test_registry(spark):
    rows = [("a", "1.9", None), ("a", "1.10", "VALIDATED"), ("a", "2.0", "PROPOSED"), ("b", "1.0", "REJECTED")]
    got = contract.registry(spark.createDataFrame(rows, "dataset string, version string, status string")).collect()
    assert [(r.dataset, r.version) for r in got] == [("a", "1.10")]


def test_landing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;when;note\n1;2026-01-02;x\n2;2026-01-03;NA\n")
    (tmp_path / "b.csv").write_text("7,2026-01-02,5\n8,2026-01-03,6\n9,2026-01-04,7\n")
    (tmp_path / "c.parquet").write_text("no parquet")
    (tmp_path / "d.dat").write_text('{"data": [{"id": 1, "c": {"city": "X"}}]}')
    (tmp_path / "e.csv").write_text("")
    heads = files.heads(spark, str(tmp_path))
    got = {os.path.basename(r.path): (r.format, r.delimiter, r.error) for r in files.classify(heads).collect()}
    assert got == {"a.csv": ("csv", ";", None), "b.csv": ("csv", ",", None), "c.parquet": ("parquet", None, "SIGNATURE_MISSING"), "d.dat": ("json", None, None), "e.csv": ("csv", ",", "EMPTY_FILE")}
    header = {os.path.basename(r.path): r.has_header for r in files.detect_header(heads).collect()}
    assert header["a.csv"] and not header["b.csv"]
    a = files.read_delimited(spark, str(tmp_path / "a.csv"), ";", kinds={"id": "integer", "when": "datetime"})
    assert [(r.id, str(r.when), r.note) for r in a.collect()] == [(1, "2026-01-02 00:00:00", "x"), (2, "2026-01-03 00:00:00", None)]
    d = files.read_json(spark, str(tmp_path / "d.dat"))
    assert [(r["id"], r["c.city"]) for r in d.collect()] == [(1, "X")]
    assert files.name_columns(spark.createDataFrame([(1, "x")]), kinds=["integer", "string"], contracts={"k": {"a": "decimal", "b": "string"}}).columns == ["a", "b"]
