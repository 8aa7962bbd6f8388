"""Audit files that arrive in a folder, loaded by the same anti-joins as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siltworks.operators import audit


def load_arriving(spark: SparkSession, folder: str, schema: T.StructType, root: str, checkpoint: str) -> None:
    """Takes all audit records (JSON lines with their steps) that have arrived since the last call into the store under `root`. A
    micro-batch that comes again is known by its number and the stream's checkpoint; records that are delivered again are added once."""
    store = audit.AuditStore(spark, root)

    def add(batch: DataFrame, number: int) -> None:
        store.load(audit.run_rows(batch), audit.step_rows(batch), f"{checkpoint}#{number}")

    arriving = spark.readStream.schema(schema).json(folder)
    arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
