"""Substring dedup: words of passages that an earlier document has too are removed.

A window is `window` consecutive words of one document; it is repeated if the same words also start
in a document with a smaller id. Windows are hashed by prefix sums. Three scans find them all:

1. Each window is represented by its least hash of `GRAM` consecutive words, so that neighbouring
   windows share one and equal windows have the same. A count-min sketch of each partition counts
   the documents' least hashes; merged, it overestimates how often any window occurs.
2. Windows whose estimate is 1 occur once and are left out. The others go on in blocks, the
   neighbouring windows with one least hash; a block's words are hashed whole. Equal blocks are
   grouped exactly: all but those of the smallest id are repeated, with all their windows.
3. What is left are windows that two different blocks share. Of each block only the documents with
   the smallest id take part, and only where a least hash has several blocks; these blocks' windows
   are found again in a third scan and grouped exactly, one by one.

So the exact passes see few rows, and none is lost: the filters of scans 2 and 3 (the second is a
sketch of the blocks that take part) let all of theirs pass, and what they let pass too much are
true windows, which change no result. Sketches are as wide as their keys need. One that is too wide to
be broadcast stays dealt over the executors, and the blocks of scan 2 are dealt to it; in scan 3 the
list of blocks is joined to the texts instead. Groups are reduced to their smallest id before they are
joined back, and the rows of a passage that many documents share are joined where they lie.

Defined cases: a null or empty text has no words; a null id is neither smaller nor larger than any
other, so its windows are kept and repeat nothing; rows of one id never repeat each other; ids
of any type that has an order will do; a text of any length is read whole, as a chunk of its
own; rows that repeat with one id keep their windows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch as sk
from .hashing import Rolling, mix, signed, sliding_min, span_hashes, text_chunks, window_starts, word_spans
from .shared import arrow_batches, join_groups, stored, text_or_empty
from .sketch import BLOCK_SCHEMA, Counting, Sketch, width_for

WINDOW = 50
#: Words of the hashes whose least stands for a window.
GRAM = 10

_SPANS = "start int, n int"


class Windows:
    """The windows of a chunk of texts, as blocks of neighbours with one least hash."""

    def __init__(self, chunk, window: int, gram: int):
        starts, ends, self.word_offsets = word_spans(chunk)
        words = span_hashes(chunk.data, starts, ends)
        self.window = window
        self.rolling = [Rolling(words, 0), Rolling(words, 1)]
        self.at = window_starts(self.word_offsets, window)
        if len(self.at):
            places = np.arange(len(words) - gram + 1)
            least = sliding_min(mix(self.rolling[0].runs(places, places + gram)), window - gram + 1)[self.at]
            new = np.ones(len(self.at), bool)
            new[1:] = (self.at[1:] != self.at[:-1] + 1) | (least[1:] != least[:-1])
            first = np.flatnonzero(new)
            self.n = np.diff(np.append(first, len(self.at)))
            self.begin = self.at[first]
            self.least = least[first]
        else:
            self.n = self.begin = self.at
            self.least = np.zeros(0, np.uint64)
        self.row = np.searchsorted(self.word_offsets, self.begin, "right") - 1

    def block_hashes(self, which: int, some: np.ndarray) -> np.ndarray:
        begin = self.begin[some]
        return self.rolling[which].runs(begin, begin + self.n[some] + self.window - 1)

    def inside(self, some: np.ndarray) -> np.ndarray:
        """Where the blocks begin in their own texts."""
        return self.begin[some] - self.word_offsets[self.row[some]]


def _block_keys(k1: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(k1.astype(np.int64).view(np.uint64) * np.uint64(3) + start.astype(np.uint64))


def _key(id: str, text: str) -> Column:
    """A hash of id and text."""
    return F.xxhash64(F.col(id).cast("string"), text_or_empty(text))


def _slim(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("k0"), _key(id, text).alias("k1"), text_or_empty(text).alias("t")).where("k0 IS NOT NULL")


def _estimated_twice(blocks: DataFrame, counters: DataFrame, width: int) -> DataFrame:
    """The stored blocks, without the column `slot`, whose least hash a sketch too wide to broadcast estimates to be there twice. Each least
    hash meets its slot once, however many blocks have it, and its blocks are joined back where very many share it."""
    keys = blocks.groupBy("m", "slot").agg(F.count(F.lit(1)).alias("n_rows"))
    return join_groups(blocks.drop("slot"), stored(sk.dealt(keys, counters, width, "m", "slot", 2), "least-hashes"), ["m"])


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k0 id, k1 hash of id and text, start, n): `n` repeated windows begin at the words start, start + 1, ... of the text."""
    spark = docs.sparkSession
    arrow_batches(spark)
    gram = min(gram, window)
    slim = _slim(docs, id, text)
    own = f"k0 {slim.schema['k0'].dataType.simpleString()}, k1 long"

    # 1. a sketch of least hashes; about two in (window - gram + 2) words change it
    chars = slim.agg(F.sum(F.length("t"))).first()[0] or 0
    width = width_for(chars / 6 * 2 / (window - gram + 2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(width)
        for batch in batches:
            for chunk in text_chunks(batch.column(0)):
                counting.add(Windows(chunk, window, gram).least)
        yield from counting.blocks()

    counters = slim.select("t").mapInArrow(count, BLOCK_SCHEMA)
    small = width <= sk.MAX_WIDTH
    sketch = spark.sparkContext.broadcast(Sketch.gathered(counters, width)) if small else None

    # 2. blocks that may be repeated, grouped exactly
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(2)):
                w = Windows(chunk, window, gram)
                some = np.flatnonzero(sketch.value.estimate(w.least) > 1) if small else np.arange(len(w.least))
                if not len(some):
                    continue
                rows = pa.array(w.row[some] + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(signed(w.least[some])), *[pa.array(signed(w.block_hashes(k, some))) for k in (0, 1)], pa.array(w.inside(some).astype(np.int32)), pa.array(w.n[some].astype(np.int32)), pa.array(sk.slots(w.least[some], width))],
                    names=["k0", "k1", "m", "b1", "b2", "start", "n", "slot"],
                )

    blocks = slim.mapInArrow(candidates, f"{own}, m long, b1 long, b2 long, {_SPANS}, slot long")
    blocks = stored(blocks.drop("slot") if small else _estimated_twice(stored(blocks, "all-candidates"), counters, width), "blocks")
    firsts = blocks.groupBy("m", "b1", "b2").agg(F.min("k0").alias("first"), (F.min("k0") < F.max("k0")).alias("shared"), F.count(F.lit(1)).alias("n_rows"))
    firsts = stored(firsts, "all-blocks")
    several = firsts.groupBy("m").agg((F.count(F.lit(1)) > 1).alias("several"), F.count(F.lit(1)).alias("n_blocks"))
    firsts = stored(join_groups(firsts, stored(several, "least-hashes"), ["m"], "n_blocks").where("shared OR several"), "first-blocks")
    judged = join_groups(blocks, firsts, ["m", "b1", "b2"])
    whole = judged.where("first < k0").select("k0", "k1", "start", "n")
    left = judged.where("first = k0 AND several").select("k0", "k1", "start")

    # 3. single windows of the blocks that are left: found again by a sketch of them, or by their list, joined to the text
    n_left = left.count()
    narrow = width_for(n_left)
    few = narrow <= sk.MAX_WIDTH

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(narrow)
        for batch in batches:
            counting.add(_block_keys(*(batch.column(i).to_numpy() for i in (0, 1))))
        yield from counting.blocks()

    marked = spark.sparkContext.broadcast(Sketch.gathered(left.select("k1", "start").mapInArrow(mark, BLOCK_SCHEMA), narrow)) if few else None
    texts = slim.withColumn("starts", F.lit(None).cast("array<int>")) if few else slim.join(left.groupBy("k0", "k1").agg(F.collect_set("start").alias("starts")), ["k0", "k1"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1 = batch.column(1).to_numpy()
            for chunk in text_chunks(batch.column(2)):
                w = Windows(chunk, window, gram)
                some = np.flatnonzero(sketch.value.estimate(w.least) > 1) if small else np.arange(len(w.least))
                rows, inside = w.row[some] + chunk.first, w.inside(some)
                keys = _block_keys(k1[rows], inside)
                if few:
                    some = some[marked.value.estimate(keys) > 0]
                else:
                    listed = batch.column(3).slice(chunk.first, chunk.rows)
                    of_row = np.repeat(np.arange(chunk.rows), np.diff(listed.offsets.to_numpy())) + chunk.first
                    some = some[np.isin(keys, _block_keys(k1[of_row], listed.flatten().to_numpy()))]
                if not len(some):
                    continue
                n = w.n[some]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(w.begin[some], n) + step
                rows = pa.array(np.repeat(w.row[some], n) + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(signed(w.rolling[k].runs(at, at + window))) for k in (0, 1)], pa.array((np.repeat(w.inside(some), n) + step).astype(np.int32))],
                    names=["k0", "k1", "w1", "w2", "start"],
                )

    windows = stored(texts.select("k0", "k1", "t", "starts").mapInArrow(single, f"{own}, w1 long, w2 long, start int"), "windows")
    first_of = windows.groupBy("w1", "w2").agg(F.min("k0").alias("first"), F.max("k0").alias("last"), F.count(F.lit(1)).alias("n_rows"))
    first_of = stored(first_of.where("first < last").drop("last"), "first-windows")
    alone = join_groups(windows, first_of, ["w1", "w2"]).where("first < k0").select("k0", "k1", "start", F.lit(1).alias("n"))
    return whole.unionByName(alone)


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, kept) for each row of `docs`; `kept` are the words that stay, joined by one blank."""
    spans = repeated_spans(docs, id, text, window, gram)
    gone = spans.distinct().groupBy("k0", "k1").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    left = docs.select(F.col(id).alias("id"), _key(id, text).alias("k"), text_or_empty(text).alias("t"))
    both = left.join(gone, (left["id"] == gone.k0) & (left.k == gone.k1), "left").select("id", "t", F.col("spans.start").alias("starts"), F.col("spans.n").alias("ns"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for i, value in enumerate(batch.column(1)):
                words = value.as_py().encode().split()
                n_words.append(len(words))
                n_removed.append(0)
                if batch.column(2)[i].is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    starts, ns = batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + ns + window - 1, -1)
                    stays = np.cumsum(edges[:-1]) == 0
                    n_removed[-1] = int((~stays).sum())
                    words = [words[j] for j in np.flatnonzero(stays).tolist()]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    out = both.mapInArrow(cut, f"id {left.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id)
