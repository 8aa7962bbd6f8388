"""The folder that all executors share, names that are free, and the keys that bring results back to their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.sources.work import fresh_path, remove, stored

__all__ = ["arrow_batches", "documents", "free_names", "fresh_path", "join_groups", "remove", "sha256_hex", "stored", "text_key", "text_or_empty"]

#: Rows in an Arrow batch. Spark also cuts batches at spark.sql.execution.arrow.maxBytesPerBatch.
ARROW_ROWS = 1000
#: A key is hot if it has more than one in HOT_KEYS of the rows, so fewer than HOT_KEYS keys are.
HOT_KEYS = 2000


def free_names(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores behind those that are taken; case does not tell names apart."""
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str = "n_rows") -> DataFrame:
    """The inner join of stored `rows` with stored `groups`, which hold each key once, with the number of its rows in column `n`.
    Groups of hot keys, fewer than HOT_KEYS by their definition, are broadcast, and their rows stay where they are; only the
    other rows are dealt by key."""
    hot = F.col(n) * HOT_KEYS > rows.count()
    few = F.broadcast(groups.where(hot))
    apart = rows.join(few, keys)
    rest = rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti").join(groups.where(~hot), keys)
    return apart.unionByName(rest).drop(n)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def text_key(text: str) -> Column:
    """Together with a row's id, tells rows apart; rows of one id and one text have the same results."""
    return F.xxhash64(text_or_empty(text))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
