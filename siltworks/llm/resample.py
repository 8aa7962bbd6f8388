"""Target-distribution importance resampling: documents drawn by how much more likely their n-grams are in a target text.

Overlapped scanning: separators of a text collapse to single spaces, and for each n one pattern with look-arounds at the word
bounds runs over the text with overlapped matches, so that every n-gram comes as one span of bytes, which the CRC counts
directly. A word byte is a digit, a letter a-z or a byte above 0x7F; separators are the other ASCII bytes; A-Z count as a-z.

A feature's bucket is its CRC-32 modulo `buckets`. All documents give a count for each bucket, so do all target texts; a
bucket's gain is its log ratio in thousandths, and a document's weight the mean gain of its features. Gumbel noise from a hash
of the id makes the highest scores a draw without replacement.

Each text is scanned once; its buckets and their numbers are stored. Counts are added up in each task before they are shuffled.
What reaches the driver are the counts of the buckets. Ranks are given by ranges of (score, id), so no task holds all rows.

Defined cases: a null or empty text has no features, weight 0 and is never drawn (`min_words` is 1 at least); a text of any
length is scanned whole; rows with one id are documents of their own, which share their noise; ties go to the smaller id, nulls
first, then to the lesser hash of the text; a null id hashes like an empty one; other columns are ignored; an empty table gives
none, an empty target gives the gains of no counts. A draw of several shards of the same seed is the draw of their union.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from operator import getitem
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_batches, stored, text_key, text_or_empty

BUCKETS = 10_000
MAX_N = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Buckets are counted in vectors, in tasks and on the driver.
MAX_BUCKETS = 1 << 22

_CLEAN = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_RUNS = re.compile(rb"  +")


def patterns(max_n: int) -> list[regex.Pattern]:
    """For each n, the pattern of n whole words with single spaces between."""
    return [regex.compile(rb"(?<![^ ])[^ ]+" + rb" [^ ]+" * (n - 1) + rb"(?![^ ])") for n in range(1, max_n + 1)]


def collapsed(text: str) -> bytes:
    """The text's bytes in lower case, with one space for each run of separators."""
    return _RUNS.sub(b" ", text.encode("utf-8", "replace").translate(_CLEAN))


def features(text: str, scan: list[regex.Pattern]) -> tuple[int, np.ndarray]:
    """The number of words, and the CRC of every n-gram."""
    data = collapsed(text)
    found = [np.fromiter(map(crc32, map(getitem, p.finditer(data, overlapped=True), repeat(0))), np.uint32) for p in scan]
    return len(found[0]), np.concatenate(found)


def feature_table(docs: DataFrame, id: str | None, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of `docs`: id, k (hash of the text), n_words, n_features, and its buckets with their numbers."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MAX_BUCKETS}")
    arrow_batches(docs.sparkSession)
    own = F.col(id) if id is not None else F.lit(None).cast("long")
    slim = docs.select(own.alias("id"), text_key(text).alias("k"), text_or_empty(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = patterns(max_n)
        for batch in batches:
            n_words, n_features, names, counts = [], [], [], []
            for value in batch.column(2):
                n, crcs = features(value.as_py(), scan)
                where, times = np.unique(crcs % np.uint32(buckets), return_counts=True)
                n_words.append(n)
                n_features.append(len(crcs))
                names.append(where.astype(np.int32))
                counts.append(times)
            ends = pa.array(np.cumsum([0, *map(len, names)]), pa.int32())
            flat = lambda parts, kind: pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(kind))
            columns = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.ListArray.from_arrays(ends, flat(names, np.int32)), pa.ListArray.from_arrays(ends, flat(counts, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "k", "n_words", "n_features", "buckets", "counts"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, k long, n_words long, n_features long, buckets array<int>, counts array<long>")


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall in each bucket: added up in each task, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in table.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """Of each bucket, the log ratio of its smoothed shares in target and documents, in thousandths, floored."""
    n = len(of_docs)
    all_docs, all_target = float(of_docs.sum()), float(of_target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_docs + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(of_docs.tolist(), of_target.tolist())], np.int64)


def weigh(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, k, n_words, n_features, weight) by the gains, which are one number for each bucket."""
    shared = table.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.concatenate([[0], np.cumsum(shared.value[batch.column(4).flatten().to_numpy()] * batch.column(5).flatten().to_numpy())]).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.diff(batch.column(4).offsets.to_numpy()))])
            n = batch.column(3).to_numpy()
            weight = np.where(n > 0, (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight)], names=[*batch.schema.names[:4], "weight"])

    return table.mapInArrow(run, f"id {table.schema['id'].dataType.simpleString()}, k long, n_words long, n_features long, weight long")


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, drawn: Column, order: list[Column]) -> DataFrame:
    """The rows with `rank`: 1, 2, 3... of the rows that may be drawn, in order; null for others. Rows are dealt by ranges; only
    the numbers of rows of the ranges are added up in order."""
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = scored.where(drawn).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    dealt = stored(asked.withColumn("_at", at), "ranks")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    of_part = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = of_part.select(F.col("_part"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    counted = dealt.join(F.broadcast(before), part == F.col("_part")).withColumn("rank", F.col("_before") + place + 1).drop("_at", "_part", "_before")
    return counted.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document. Of those with at least `min_words` words, `percent` of a
    hundred are drawn, rounded down; `rank` numbers them by score and is null for the rest."""
    if not 0 <= percent <= 100:
        raise ValueError("percent must be between 0 and 100")
    table = stored(feature_table(docs, id, text, max_n, buckets), "features")
    of_target = bucket_counts(feature_table(target, None, target_text, max_n, buckets), buckets)
    weighed = weigh(table, gains(bucket_counts(table, buckets), of_target))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    may = F.col("n_words") >= max(1, min_words)
    wanted = scored.where(may).count() * percent // 100
    out = ranked(scored, may, [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("k").asc()])
    return out.select(F.col("id").alias(id), "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents drawn, columns as they were. Rows that share an id are drawn together."""
    picked = resample(docs, target, id, text, **options).where(F.col("rank").isNotNull()).select(F.col(id).alias("_id")).distinct()
    return docs.join(picked, docs[id].eqNullSafe(picked["_id"]), "left_semi")
