"""Loads that break off, come again, or find new rows bucket by bucket."""

import pytest
from pyspark.sql import functions as F

from siltworks.operators import audit
from siltworks.sources.bucketed import BucketedTable, by_bucket_key
from siltworks.sources.commits import CommitLog
from siltworks.sources.work import fresh_path


@pytest.fixture(scope="module")
def runs(spark):
    r = spark.createDataFrame([(f"r{i}", "f", "INGEST", "INGEST", "SUCCESS", None if i == 1 else float(i)) for i in range(4)], "run_id string, source_file string, decision string, execution_mode string, final_status string, duration_seconds double").withColumn("started_at", F.expr("timestamp_ntz '2026-01-01'"))
    s = spark.createDataFrame([(f"r{i}", j, "step", None if j == 2 else "FAILED" if i == 3 else "SUCCESS", 1.0) for i in range(4) for j in (1, 2, 3)], "run_id string, step_order long, step_name string, status string, duration_seconds double").withColumn("started_at", F.expr("timestamp_ntz '2026-01-01'"))
    return r, s


def counts(store):
    return store.runs().count(), store.steps().count()


def test_loads_add_once(spark, runs):
    r, s = runs
    store = audit.AuditStore(spark, fresh_path(spark, "store"), buckets=4)
    assert counts(store) == (0, 0)
    assert store.load(r.where("run_id = 'r0'"), s) == (1, 3)
    assert store.load(r, s) == (3, 9)
    assert store.load(r.union(r), s.union(s)) == (0, 0)
    assert counts(store) == (4, 12)
    assert sorted(map(tuple, store.runs().select("run_id", "duration_seconds").collect())) == [("r0", 0.0), ("r1", None), ("r2", 2.0), ("r3", 3.0)]


@pytest.mark.parametrize("broken", ["steps", "runs", "commit"])
def test_a_load_that_breaks_off_leaves_nothing_to_read(spark, runs, monkeypatch, broken):
    r, s = runs
    root = fresh_path(spark, "store")
    store = audit.AuditStore(spark, root, buckets=4)
    store.load(r.where("run_id = 'r0'"), s, "1")

    write, commit = BucketedTable.write, CommitLog.commit

    def breaking_write(table, rows, load):
        write(table, rows, load)
        if table is store.tables[broken if broken != "commit" else "runs"] and broken != "commit":
            raise OSError("lost")

    def breaking_commit(log, entry):
        if broken == "commit":
            raise OSError("lost")
        commit(log, entry)

    with monkeypatch.context() as m:
        m.setattr(BucketedTable, "write", breaking_write)
        m.setattr(CommitLog, "commit", breaking_commit)
        with pytest.raises(OSError):
            store.load(r, s, "2")
    assert counts(store) == (1, 3)
    assert store.load(r, s, "2") == (3, 9)
    assert counts(store) == (4, 12)


def test_a_batch_that_comes_again_adds_nothing(spark, runs):
    r, s = runs
    root = fresh_path(spark, "store")
    assert audit.load(r.where("run_id < 'r2'"), s, root, "1") == (2, 6)
    # known by its number, whatever its rows are now
    assert audit.load(r, s, root, "1") == (2, 6)
    assert audit.load(r, s, root, "2") == (2, 6)
    assert [e["batch"] for e in CommitLog(spark, root).entries()] == ["1", "2"]


def test_a_half_written_commit_is_none(spark):
    log = CommitLog(spark, fresh_path(spark, "log"))
    assert log.entries() == [] and log.last() is None
    log.commit({"batch": "a"})
    hidden = log._hadoop.Path(f"{log.path}/.000000001.tmp")
    log._files.create(hidden, True).close()
    assert log.entries() == [{"batch": "a"}]
    log.commit({"batch": "b"})
    assert log.last() == {"batch": "b"} and log.find("a") == {"batch": "a"} and log.find("c") is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_the_source_is_shuffled(spark, runs):
    r, s = runs
    store = audit.AuditStore(spark, fresh_path(spark, "store"))
    store.load(r, s)
    # the file of each bucket is joined as it lies, on the key alone and on more columns
    with by_bucket_key(spark):
        for table, rows, keys in (("runs", audit.normalise(r, audit.RUNS), ["run_id"]), ("steps", audit.normalise(s, audit.STEPS), ["run_id", "step_order"])):
            joined = store.tables[table].lacking(rows, store._loads(table), keys)
            assert plan(joined).count("Exchange hashpartitioning") == 1
            assert "bucketed_" in plan(joined) and joined.count() == 0


def test_buckets_of_other_keys_are_not_read(spark, runs):
    r, s = runs
    store = audit.AuditStore(spark, fresh_path(spark, "store"), buckets=16)
    store.load(r, s)
    new = store.new_runs(audit.normalise(r.where("run_id = 'r2'"), audit.RUNS))
    assert "SelectedBucketsCount: 1 out of 16" in new._jdf.queryExecution().toString() or "SelectedBucketsCount: 1 out of 16" in plan(new)
    assert new.count() == 0


def test_null_keys_and_extra_columns(spark, runs):
    r, s = runs
    store = audit.AuditStore(spark, fresh_path(spark, "store"), buckets=4)
    odd = r.withColumn("run_id", F.lit(None).cast("string")).withColumn("zone", F.lit("x"))
    assert store.load(odd, s) == (1, 0)
    assert store.runs().columns == audit.RUNS.names


def gold_tables(spark, n):
    return {name: spark.range(n).withColumn("v", F.lit(name)) for name in ("a", "b", "c")}


def manifest(spark, run, rows):
    return spark.createDataFrame([(run, "sales", name, n) for name, n in rows.items()], "run_id string, dataset string, table_name string, rows long")


def test_gold_tables_are_swapped_together(spark):
    store = audit.GoldStore(spark, fresh_path(spark, "gold"))
    assert store.load(manifest(spark, "1", {"a": 5, "b": 5, "c": 5}), gold_tables(spark, 5)) == ["a", "b", "c"]
    old = store.folders()
    # the third table fails in its write, then has another number of rows
    failing = gold_tables(spark, 7) | {"c": spark.range(7).select("id", F.when(F.col("id") == 6, F.raise_error(F.lit("lost"))).cast("string").alias("v"))}
    with pytest.raises(Exception, match="lost"):
        store.load(manifest(spark, "2", {"a": 7, "b": 7, "c": 7}), failing)
    with pytest.raises(ValueError, match="row counts differ: c"):
        store.load(manifest(spark, "2", {"a": 7, "b": 7, "c": 8}), gold_tables(spark, 7))
    assert store.folders() == old and [store.table(t).count() for t in "abc"] == [5, 5, 5]
    assert store.loads().select("run_id").distinct().count() == 1
    # the same again, whole; then nothing is pending
    again = manifest(spark, "2", {"a": 7, "b": 7})
    assert store.load(again, gold_tables(spark, 7)) == ["a", "b"]
    assert store.load(again, gold_tables(spark, 9)) == []
    assert [store.table(t).count() for t in "abc"] == [7, 7, 5]
    assert len(store.clean()) >= 4 and [store.table(t).count() for t in "abc"] == [7, 7, 5]
    assert store.clean() == []


def test_arriving_audit_files(spark, runs):
    from siltworks.streaming.audit_stream import load_arriving

    folder, root, checkpoint = (fresh_path(spark, n) for n in ("arriving", "store", "stream"))
    records = audit.nested(*runs)
    for part in ("run_id < 'r2'", "true"):
        records.where(part).write.mode("append").json(folder)
        load_arriving(spark, folder, records.schema, root, checkpoint)
    assert counts(audit.AuditStore(spark, root)) == (4, 12)
