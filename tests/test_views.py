import pytest

from siltworks.operators import silver as sv
from siltworks.plans import views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sent", [1, 1_000_000])
def test_tasks_grow_with_the_lines(spark, monkeypatch, sent):
    """Large tables are joined, and their repeated rows found, by more tasks than the setting has; the rows are the same."""
    want = sorted(map(str, sv.deduplicate(views.dirty_sales(spark, SF)).collect()))
    monkeypatch.setattr(views, "ROWS_A_TASK", 500, raising=False)
    monkeypatch.setattr(views, "PARTS_SENT", sent, raising=False)
    lines = views.table(spark, SF, "lineitem").count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = sv.deduplicate(views.dirty_sales(spark, SF))
        assert rows.rdd.getNumPartitions() == -(-lines // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted(map(str, rows.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
