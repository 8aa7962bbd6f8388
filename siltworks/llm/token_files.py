"""Token-id files of directly addressable codes.

A segment holds the ids of consecutive documents. Each id is split into chunks of `CHUNK_BITS` bits,
lowest first; level k holds the k-th chunk of every id that has one. A bitmap on each level says
which of its chunks are continued on the next, and a rank directory counts the set bits before each
block of the bitmap, so that the place on the next level of any chunk, and with it any single id, is
found in a few steps without decoding what stands around it.

The files are Parquet with one row for each segment, written by Spark in ascending order of the
documents: shard s holds a range of ids, and its segments and documents are in order. Writes are
atomic, a lost executor's task is done again, and any store that Spark reaches will do.

The order is by id, nulls first, then by a hash of the text, then by the text. Defined cases: a null
or empty text is a document of the end id alone; rows with the same id are documents of their own,
next to each other; a text of any length is one document, which is never cut, so its
segment is as long as it; other columns are ignored; an empty table gives a folder without segments.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import MAX_VOCABULARY_BYTES, byte_letters, require_byte_level, split_words
from .shared import arrow_batches, text_key, text_or_empty

CHUNK_BITS = 8
#: Bits of a bitmap between two entries of its rank directory.
RANK_BITS = 512
#: A segment is closed when it holds so many ids; a document is never cut.
SEGMENT_IDS = 1 << 18
#: The id after each document.
END_ID = 0
#: Words kept with their ids by a worker, in each of two generations: about 100 MB each at most.
CACHE_WORDS = 400_000

SEGMENT = "shard int, segment int, n_ids long, doc_ids array<{id}>, doc_ends array<int>, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


# -- the code ------------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(levels, bitmaps, rank directories) of unsigned 32-bit ids. The last level has no bitmap."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes())
        more = rest >= 1 << CHUNK_BITS
        if not more.any():
            return levels, bitmaps, ranks
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<i4").tobytes())
        rest = rest[more] >> np.uint32(CHUNK_BITS)


def unpack(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    out = np.frombuffer(levels[-1], np.uint8).astype(np.uint32)
    for level, bitmap in zip(levels[-2::-1], bitmaps[::-1]):
        low = np.frombuffer(level, np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(low), bitorder="little").view(bool)
        low[more] |= out << np.uint32(CHUNK_BITS)
        out = low
    return out


def token_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """One id, by the bitmaps and rank directories alone."""
    value = 0
    for k, level in enumerate(levels):
        value |= level[i] << CHUNK_BITS * k
        if k == len(bitmaps) or not bitmaps[k][i >> 3] >> (i & 7) & 1:
            return value
        block = i // RANK_BITS
        before = int.from_bytes(ranks[k][4 * block : 4 * block + 4], "little")
        bits = int.from_bytes(bitmaps[k][block * RANK_BITS // 8 : (i >> 3) + 1], "little") & ((1 << (i - block * RANK_BITS)) - 1)
        i = before + bits.bit_count()
    raise ValueError("a chunk is continued on a level that is not there")


# -- ids by the tokenizers library ---------------------------------------------------------------


class _Kept(dict):
    """What `make` gives for a key. When `limit` keys are kept they become the older generation, which keys in use are
    taken over from; the generation before is forgotten."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit = make, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class LibraryEncoder:
    """The library's ids of whole texts. Words are cut by `split_words`, the pattern that the file must ask for, and the
    library's model is asked for each word that is not kept. A text with a special token goes through the library whole."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        require_byte_level(json.loads(spec))
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokenize = self.library.model.tokenize
        self.letters = {b: c for c, b in byte_letters().items()}
        self.words = _Kept(self._word, CACHE_WORDS)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, split_words(text)))


_encoders: dict[str, LibraryEncoder] = {}


def _library_encoder(spec: str) -> LibraryEncoder:
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = LibraryEncoder(spec)
    return _encoders[spec]


# -- files ---------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, vocab_path: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes all documents and writes their ids, each document's followed by `end_id`, in ascending order of `id`.

    Documents are dealt by ranges of (id, hash of the text), so that many rows of one id are no single task.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    with open(vocab_path, encoding="utf-8") as f:
        spec = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(spec) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocab_path} holds more than {MAX_VOCABULARY_BYTES} bytes")
    shared = spark.sparkContext.broadcast(spec)
    slim = docs.select(F.col(id).alias("id"), text_key(text).alias("k"), text_or_empty(text).alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartitionByRange(parts, "id", "k").sortWithinPartitions("id", "k", "t").select("id", "t", F.spark_partition_id().alias("shard"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _library_encoder(shared.value)
        end = np.array([end_id], "<u4").tobytes()
        names: list[pa.Array] = []
        coded: list[bytes] = []
        held = segment = shard = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(coded), "<u4")
            ends = np.cumsum([len(c) // 4 for c in coded]).astype(np.int32)
            levels, bitmaps, ranks = pack(ids)
            whole = pa.concat_arrays(names)
            one = pa.array([0, len(whole)], pa.int32())
            binary = pa.list_(pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(one, whole), pa.array([ends.tolist()], pa.list_(pa.int32())), pa.array([levels], binary), pa.array([bitmaps], binary), pa.array([ranks], binary)],
                names=["shard", "segment", "n_ids", "doc_ids", "doc_ends", "levels", "bitmaps", "ranks"],
            )

        for batch in batches:
            shard = batch.column(2)[0].as_py() if batch.num_rows else shard
            first = 0
            texts = batch.column(1)
            for i in range(batch.num_rows):
                coded.append(encoder.encode(texts[i].as_py()) + end)
                held += len(coded[-1]) // 4
                if held >= segment_ids:
                    names.append(batch.column(0).slice(first, i + 1 - first))
                    first = i + 1
                    yield closed()
                    names, coded, held, segment = [], [], 0, segment + 1
            if first < batch.num_rows:
                names.append(batch.column(0).slice(first))
        if coded:
            yield closed()

    ordered.mapInArrow(run, SEGMENT.format(id=id_type)).write.option("parquet.enable.dictionary", "false").parquet(path)


def _starts(segments: DataFrame) -> DataFrame:
    """shard, segment -> start: ids before the segment. Totals of shards, of which there are as many as partitions
    were written, are added up first, then the segments within each shard."""
    sizes = segments.select("shard", "segment", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(shards, "shard").select("shard", "segment", (F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files: the ids of all documents before it, its own
    with the end id, and the CRC-32 of these as little-endian unsigned 32-bit integers."""
    segments = spark.read.parquet(path)
    id_type = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = unpack(batch.column(4)[r].as_py(), batch.column(5)[r].as_py()).astype("<u4").tobytes()
                names = batch.column(2)[r].values
                ends = batch.column(3)[r].values.to_numpy().astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                n = len(names)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(0)[r].as_py(), np.int32)), pa.array(np.full(n, batch.column(1)[r].as_py(), np.int32)), names, pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())],
                    names=["shard", "segment", "id", "inside", "n_tokens", "ids_crc32"],
                )

    docs = segments.select("shard", "segment", "doc_ids", "doc_ends", "levels", "bitmaps").mapInArrow(run, f"shard int, segment int, id {id_type}, inside long, n_tokens long, ids_crc32 long")
    joined = docs.join(_starts(segments), ["shard", "segment"])
    return joined.select("id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, position: str = "position") -> DataFrame:
    """(position, token) for distinct global positions, each read from its segment without decoding it; positions outside are left out.

    Segments are found through fixed blocks of positions, so the join is on equal keys.
    """
    segments = spark.read.parquet(path)
    block = SEGMENT_IDS
    spans = _starts(segments).join(segments.select("shard", "segment", "n_ids"), ["shard", "segment"])
    spans = spans.withColumn("end", F.col("start") + F.col("n_ids"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    asked = positions.select(F.col(position).cast("long").alias("position")).withColumn("block", F.floor(F.col("position") / block))
    found = asked.join(spans, "block").where("position >= start AND position < end")
    asked_of = found.groupBy("shard", "segment").agg(F.collect_set(F.struct("position", (F.col("position") - F.col("start")).alias("inside"))).alias("asked"))
    wanted = asked_of.join(segments.select("shard", "segment", "levels", "bitmaps", "ranks"), ["shard", "segment"]).select("asked", "levels", "bitmaps", "ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                asked = batch.column(0)[r].as_py()
                code = [batch.column(k)[r].as_py() for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array([x["position"] for x in asked], pa.int64()), pa.array([token_at(*code, x["inside"]) for x in asked], pa.int64())], names=["position", "token"])

    return wanted.mapInArrow(run, "position long, token long")
