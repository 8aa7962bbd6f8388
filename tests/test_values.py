from datetime import datetime

from pyspark.sql import functions as F
from siltworks.functions import values as v


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_text_to_numbers_and_dates(spark):
    rows = [("12",), ("12d",), (" 3.5e2 ",), ("x",), ("",), (None,)]
    assert [r[0] for r in one(spark, "t string", rows, v.to_number(F.col("t")))] == [12.0, None, 350.0, None, None, None]
    rows = [("2026-01-05",), ("2026/1/5",), ("15/01/2026",), ("03/04/2026",), ("2026-01-05T10:11:12Z",), ("2024",), ("soon",), ("2026-13-45",), (None,)]
    got = [r[0] for r in one(spark, "t string", rows, v.to_datetime(F.col("t")))]
    assert got == [datetime(2026, 1, 5), datetime(2026, 1, 5), datetime(2026, 1, 15), datetime(2026, 3, 4), datetime(2026, 1, 5, 10, 11, 12), None, None, None, None]


def test_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), (None, float("nan")), ("b", None)], "t string, x double")
    assert df.where(v.not_in(F.col("t"), ["a"])).count() == 2
    folded = v.fold_nan(df)
    assert folded.agg(F.count("x"), v.total(F.col("x")), v.distinct_with_null(F.col("t"))).first()[:3] == (1, 1.0, 3)
    assert df.where("false").agg(v.money_total(F.col("x"))).first()[0] == 0.0
    tokens = spark.createDataFrame([("NA",), ("",), ("x",), (None,)], "t string")
    assert [r.t for r in v.fold_null_tokens(tokens).collect()] == [None, None, "x", None]


def test_text(spark):
    rows = [("\t a b\n", None), ("", "z")]
    assert one(spark, "a string, b string", rows, v.strip(F.col("a")), v.join_text("-", F.col("a"), F.col("b"))) == [("a b", "a b\n-"), ("", "-z")]
    rows = [("QuantitéVendue",), ("Order ID",), ("unit_price",), ("---",)]
    assert [r[0] for r in one(spark, "n string", rows, v.name_tokens(F.col("n")))] == [["quantite", "vendue"], ["order", "id"], ["unit", "price"], []]
    assert [v.plain_name(n) for n, in rows] == ["quantite_vendue", "order_id", "unit_price", "---"]
    assert one(spark, "n string", [("SO43701",), ("É-x9",)], v.value_shape(F.col("n"))) == [("AA99999",), ("A-a9",)]
