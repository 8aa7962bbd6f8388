"""Line dedup over levelled sorted runs of line hashes.

The index holds, for each line key, in how many documents it was found. Each batch is written as a
run, hashed into buckets and sorted by key. A batch first merge-anti-joins the settled runs (keys
that have reached the limit and need no more counting) and adds what is left as a run of its own on
level 0; `fanout` runs of a level are compacted into one of the next, and keys that reach the limit
there move to a settled run. The runs are bucketed alike, so merging them moves no rows.

A line's key is the line without blanks and 0x09-0x0D at both ends, A-Z lower-cased; 128 bits of
hash stand for it.

Defined cases: a null or empty text is one empty line; keys of fewer than `min_chars` code points
are never dropped; rows that repeat, also with the same id, are documents of their own; other
columns are ignored by `line_table` and kept by `drop_lines`; a text of any length is handled whole, in time linear in its
lines; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import _SPACE, signed, span_hashes, text_chunks
from .shared import arrow_batches, free_names, fresh_path, join_groups, remove, stored, text_key, text_or_empty

#: Keys found in so many documents are boilerplate.
MIN_DOCS = 10
#: Batches that one table is dealt to when it is deduplicated whole.
BATCHES = 4
#: Runs of one level that are compacted together.
FANOUT = 2

_KEYS = "h1 long, h2 long"
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def _line_keys(chunk, min_chars: int):
    """Of each line: its text's row, its number in the text, two hashes of its key, and whether the key is long enough."""
    data, offsets = chunk.data, chunk.offsets
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    rows = np.concatenate([np.arange(chunk.rows), row_of_break])
    order = np.argsort(rows, kind="stable")
    starts, rows = starts[order], rows[order]
    per_row = np.bincount(rows, minlength=chunk.rows)
    first = np.concatenate([[0], np.cumsum(per_row)[:-1]])
    numbers = np.arange(len(rows)) - first[rows]
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends = np.empty(len(rows), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[last] = offsets[1:][rows[last]]
    solid = np.flatnonzero(~_SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    begin, stop = starts.copy(), starts.copy()
    begin[some], stop[some] = solid[a[some]], solid[b[some] - 1] + 1
    chars = np.concatenate([[0], np.cumsum(~_CONTINUES[data])])
    return rows, numbers, span_hashes(data, begin, stop, 0, lower=True), span_hashes(data, begin, stop, 1, lower=True), chars[stop] - chars[begin] >= min_chars


def line_table(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """One row for each distinct line key of a row of `docs`: key columns of the row (k0 id, k1 hash of the text),
    h1 and h2 of the key, and `lines`, the numbers of its lines in the text, from 0."""
    arrow_batches(docs.sparkSession)
    slim = docs.select(F.col(id).alias("k0"), text_key(text).alias("k1"), text_or_empty(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(2)):
                rows, numbers, h1, h2, fits = _line_keys(chunk, min_chars)
                rows, numbers, h1, h2 = rows[fits], numbers[fits], h1[fits], h2[fits]
                if not len(rows):
                    continue
                order = np.lexsort((numbers, h2, h1, rows))
                rows, numbers, h1, h2 = rows[order], numbers[order], h1[order], h2[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                at = np.flatnonzero(new)
                bounds = np.append(at, len(rows)).astype(np.int32)
                taken = pa.array(rows[at] + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(taken),
                        batch.column(1).take(taken),
                        pa.array(signed(h1[at])),
                        pa.array(signed(h2[at])),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(numbers.astype(np.int32))),
                    ],
                    names=["k0", "k1", "h1", "h2", "lines"],
                )

    return slim.mapInArrow(run, f"k0 {slim.schema['k0'].dataType.simpleString()}, k1 long, {_KEYS}, lines array<int>")


class LineIndex:
    """Levelled runs of (h1, h2, n): keys and the documents that have them."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self.written: list[str] = []
        self.paths: list[str] = []

    def _write(self, run: DataFrame, kind: str) -> str:
        name = f"line_run_{kind}_{uuid.uuid4().hex}"
        path = fresh_path(self.spark, name)
        self.written.append(name)
        self.paths.append(path)
        run.select("h1", "h2", "n").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    def drop(self) -> None:
        """Takes the runs out of the catalogue and removes their files."""
        for name in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            remove(self.spark, path)
        self.written, self.paths, self.levels, self.settled = [], [], [[]], []

    def _without_settled(self, keys: DataFrame) -> DataFrame:
        for name in self.settled:
            keys = keys.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """A batch: one row (h1, h2) for each document and key."""
        counted = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        self.levels[0].append(self._write(self._without_settled(counted), "l0"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self._compact(self.levels[level], level + 1)
            self.levels[level] = []
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs added up, by full merge joins of tables that are bucketed alike."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnRenamed("n", "m")
            out = out.join(more, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def _compact(self, names: list[str], level: int) -> None:
        merged = self._without_settled(self._merged(names))
        settled = self._write(merged.where(F.col("n") >= self.min_docs), "settled")
        self.levels[level].append(self._write(merged.where(F.col("n") < self.min_docs), f"l{level}"))
        self.settled.append(settled)
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def frequent(self) -> DataFrame:
        """The keys (h1, h2) found in at least `min_docs` documents."""
        rest = [name for level in self.levels for name in level]
        parts = [self.spark.table(name).select("h1", "h2") for name in self.settled]
        if rest:
            parts.append(self._without_settled(self._merged(rest)).where(F.col("n") >= self.min_docs).select("h1", "h2"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def dropped_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(k0, k1, dropped): for each row of `docs` with lines that go, the numbers of these lines.

    The table is dealt to `batches` batches by the rows' hashes, and each is added to a LineIndex.
    """
    spark = docs.sparkSession
    lines = stored(line_table(docs, id, text, min_chars).withColumn("batch", F.pmod(F.xxhash64("k0", "k1"), F.lit(batches)).cast("int")), "lines", "batch")
    index = LineIndex(spark, min_docs, fanout)
    try:
        for k in range(batches):
            index.add(lines.where(F.col("batch") == k).select("h1", "h2"))
        frequent = stored(index.frequent(), "frequent-lines")
    finally:
        index.drop()
    # lines that very many documents have are joined where they lie
    groups = stored(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_rows")).join(frequent, ["h1", "h2"], "left_semi"), "frequent-groups")
    hits = join_groups(lines, groups, ["h1", "h2"]).dropDuplicates(["k0", "k1", "h1", "h2"])
    return hits.groupBy("k0", "k1").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("dropped"))


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    """The texts without the lines of these numbers, in one pass over each text's lines. Null where nothing is dropped."""

    def kept(text: str | None, gone: np.ndarray | None) -> str | None:
        if gone is None:
            return None
        lines = text.split("\n")
        stay = np.ones(len(lines), bool)
        stay[gone] = False
        return "\n".join(compress(lines, stay.tolist()))

    return pd.Series([kept(t, g) for t, g in zip(texts, dropped)], dtype=object)


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES, fanout: int = FANOUT, counts: tuple[str, str] | None = ("_n_lines", "_n_dropped")) -> DataFrame:
    """The documents, columns as they were, with the lines of frequent keys taken out of the text; then two columns more, the
    lines before dropping and those dropped, named by `counts` (None: neither) with underscores behind where such a name
    is taken. Other lines stay, joined by a line feed. A null text with no dropped line stays null."""
    dropped = dropped_lines(docs, id, text, min_docs, min_chars, batches, fanout)
    names = docs.columns
    left = docs.select([F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    at = f"c{names.index(text)}"
    left = left.withColumn("k1", text_key(at))
    key = f"c{names.index(id)}"
    both = left.join(dropped, left[key].eqNullSafe(dropped.k0) & (left.k1 == dropped.k1), "left")
    value = text_or_empty(at)
    kept = _without(F.when(F.col("dropped").isNotNull(), value), F.col("dropped"))
    out = [F.when(F.col("dropped").isNotNull(), kept).otherwise(F.col(c)).alias(n) if c == at else F.col(c).alias(n) for n, c in zip(names, left.columns)]
    if counts:
        n_lines, n_dropped = free_names(names, *counts)
        n = F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit(""))) + 1
        out += [n.cast("long").alias(n_lines), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias(n_dropped)]
    return both.select(*out)
