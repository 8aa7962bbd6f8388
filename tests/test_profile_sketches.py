"""Distinct counts decided by sketches, null counts, and inclusion of keys."""

from pyspark.sql import functions as F

from siltworks.operators import catalogue as ca
from siltworks.operators import profile as pf

N = 20_000


def frame(spark):
    i = F.col("id")
    return spark.range(N).select(
        i.alias("unique"),
        F.when(i > 0, i).alias("unique_but_null"),
        (i % 48).cast("string").alias("few"),
        (i % 50).cast("string").alias("at_the_limit"),
        (i % 51).cast("string").alias("beyond_the_limit"),
        (i % (N // 2)).cast("string").alias("half"),
        (i % (N // 2 + 1)).cast("string").alias("more_than_half"),
        (i % 2000).cast("string").alias("clear_low"),
        (i % 15_000).cast("string").alias("clear_high"),
        F.lit(None).cast("string").alias("empty"),
    )


def test_flags_are_those_of_exact_counts(spark):
    df = frame(spark)
    flags = ["column", "is_unique", "is_categorical", "is_identifier_candidate", "inferred_type", "null_count"]
    want, got = (sorted(map(tuple, pf.profile(df, exact=e).select(*flags).collect()), key=str) for e in (True, False))
    assert got == want
    assert {t[0] for t in want if t[1]} == {"unique"} and {t[0] for t in want if t[2]} >= {"few", "at_the_limit", "half", "clear_low"}


def test_columns_clear_of_every_limit_are_not_shuffled(spark):
    df = frame(spark)
    base = pf.facts(df, sketches=True)
    near = set(pf.near_a_limit(base))
    assert near >= {"unique", "at_the_limit", "few", "beyond_the_limit", "half", "more_than_half"} and not near & {"clear_low", "clear_high"}
    plan = pf.decided_counts(df, base)._jdf.queryExecution().optimizedPlan().toString()
    exact = {r.column: (r.distinct_count, r.distinct_exact) for r in pf.decided_counts(df, base).collect()}
    assert exact["unique"] == (N, True) and exact["half"] == (N // 2, True) and not exact["clear_low"][1]
    assert abs(exact["clear_high"][0] / 15_000 - 1) <= pf.SKETCH_ERROR * pf.SKETCH_DEVIATIONS
    values = plan.split("distinct_estimate")[0]
    assert "column, half" in values and "column, clear_low" not in values and "column, clear_high" not in values


def test_null_counts(spark):
    df = spark.createDataFrame([(1.0, "a", None), (float("nan"), None, None), (None, "b", None)], "x double, y string, z array<int>")
    assert sorted(map(tuple, pf.null_counts(df).collect())) == [("x", 2, 3), ("y", 1, 3), ("z", 3, 3)]
    assert [tuple(r) for r in pf.null_counts(df.where("false").select("x")).collect()] == [("x", 0, 0)]


def test_inclusions(spark):
    child = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (9, "a")], "fk int, name string")
    parent = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id bigint")
    got = {(r.child, r.parent): (r.n_values, r.missing) for r in ca.inclusions({"c": child, "p": parent}, [("c", "fk"), ("c", "name"), ("p", "id")]).collect()}
    assert got == {
        ("c.fk", "c.name"): (3, 3), ("c.fk", "p.id"): (3, 0), ("c.name", "c.fk"): (2, 2), ("c.name", "p.id"): (2, 2), ("p.id", "c.fk"): (4, 1), ("p.id", "c.name"): (4, 4),
    }
