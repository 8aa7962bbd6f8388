"""Tables that grow by commits, bucketed by a key: a join on the key moves only the other side.

A table's files lie in one folder, a partition for each load and in it a file for each bucket, sorted by the key, with Bloom filters of
the key. Only loads that a CommitLog names are read. Spark knows the buckets from the catalogue, so the table is made known there
under a name of its folder; nothing but the files and the log lasts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
#: With at most so many keys looked for, buckets and files without them are left out of the scan.
FEW_KEYS = 1000

LOAD = "_load"


@contextmanager
def by_bucket_key(spark: SparkSession) -> Iterator[None]:
    """Within, a join on the bucket key and more columns takes the buckets as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.schema, self.key = spark, schema, key
        self.name = "bucketed_" + hashlib.sha256(f"{path}|{buckets}".encode()).hexdigest()[:24]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, {LOAD} STRING) USING parquet OPTIONS ('parquet.bloom.filter.enabled#{key}' 'true') "
            f"PARTITIONED BY ({LOAD}) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def write(self, rows: DataFrame, load: str) -> None:
        """Adds the files of a load, which are read once its commit names it."""
        rows.select(*self.schema.names, F.lit(load).alias(LOAD)).write.insertInto(self.name)

    def read(self, loads: list[str]) -> DataFrame:
        """The rows of these loads."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).where(F.col(LOAD).isin(loads)).drop(LOAD)

    def lacking(self, rows: DataFrame, loads: list[str], keys: list[str]) -> DataFrame:
        """The rows whose `keys`, the bucket key among them, no row of these loads has. Where `rows` has few keys, only their
        buckets are read. Evaluate within `by_bucket_key` where there are more columns than the key."""
        there = self.read(loads)
        asked = [r[0] for r in rows.select(self.key).where(F.col(self.key).isNotNull()).distinct().limit(FEW_KEYS + 1).collect()]
        if len(asked) <= FEW_KEYS:
            there = there.where(F.col(self.key).isin(asked))
        return rows.join(there.select(*keys).hint("merge"), keys, "left_anti")
