"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is a set of shingles of `SHINGLE` words, each with a weight. Darts are thrown into the plane of
weight and rank of each shingle: cells of the plane get a Poisson number of darts, and a dart's place and
coordinate are hashes of shingle, cell and number, so every document that holds the region holds the same
darts. Only darts below the document's weight and a rank bound are looked at, about k ln k + 2k in all,
however many shingles there are; the earliest dart of each coordinate is the signature. Two signatures
agree at a coordinate with the probability of the weighted Jaccard similarity.

Steps:

1. Signatures of all texts; texts with the same words are one node, that of their least id.
2. Band keys of `ROWS` coordinates, dealt by ranges of (key, following coordinates), so a bucket of any size is
   spread over tasks. Keys that one node alone has end there. A node is paired with the first node of its bucket
   in the task and with the one before it, which share the most coordinates beyond the band. By a short
   signature, each node's closest pair is chosen, and checked exactly on the shingles.
3. Each bucket's node with the most links is paired with all nodes of the bucket; again each node's closest pair
   is checked. This joins most of a family of near copies cheaply.
4. What is still apart is searched in full. Nodes are labelled with their components; in each bucket that
   holds several, every node outside the largest is compared with all nodes of the bucket, in blocks of bounded
   size dealt over tasks, by short signature. Nodes of pairs that may be close meet again in such blocks with their
   shingles, and are compared exactly, until two components have a link. So no link between nodes that share a bucket
   is lost, wherever they stand in it.
5. Classes are the connected components of the links.

Most nodes that share a bucket are not alike, and such meetings grow faster than the documents. Only band keys and
signatures of those are shuffled; shingles are made anew for each check, of the nodes in pairs whose short signatures may
be close.

Joins on a node or bucket that very many rows share are dealt by a second column. Hashes of shingles have 64 bits.

Defined cases: texts without words, null ones too, are copies of each other; a row without id has a null
class; a text of fewer words than a shingle is one shingle; rows of one id are one document; repeated rows
have one class; ids that are no whole numbers are told apart and ordered by a hash, and a class has the id that
is first in that order; a text of any length is shingled whole, in one task; other columns are ignored by `classes` and kept by `keep_one`; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .components import components
from .hashing import Rolling, mix, signed, span_hashes, text_chunks, word_spans
from .shared import arrow_batches, stored, text_or_empty
from .sketch import BLOCK_SCHEMA, MAX_WIDTH, Counting, Sketch, width_for

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 7
#: What a shingle weighs: "counts", how often it is in the text; "binary", 1.
WEIGHTS = "counts"
#: Coordinates of the short signature, one byte each, and how far below SIMILARITY a pair's similarity by it may be:
#: four standard deviations.
SHORT = 252
MARGIN = 0.10
#: Bytes of shingle hashes on each side of a block, about, and pairs compared at once.
BLOCK_BYTES = 8 << 20
AT_ONCE = 1 << 15
#: Nodes on each side of a block, about, however short their texts are.
BLOCK_NODES = 1 << 13
#: A key of a join with more rows than HOT, and than a SALTED-th of all, is dealt to several tasks.
HOT, SALTED = 128, 50_000

_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 18.0)])))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """k coordinates (uint32) for each of `n_sets` weighted sets; `sets` has the set of each element, whose hash and weight
    stand beside it. Elements are distinct within a set, and every set has one of weight above 0."""
    total = np.bincount(sets, weights, n_sets)
    signature = np.zeros((n_sets, k), np.uint32)
    todo = np.arange(n_sets)
    throws = k * (np.log(k) + 2)
    while len(todo):
        chosen = np.zeros(n_sets, bool)
        chosen[todo] = True
        own = chosen[sets]
        place = np.zeros(n_sets, np.int64)
        place[todo] = np.arange(len(todo))
        best, ids = _earliest(elements[own], weights[own], place[sets[own]], throws / total[todo], k)
        full = np.isfinite(best).all(axis=1)
        signature[todo[full]] = ids[full]
        todo = todo[~full]
        throws *= 2
    return signature


def _earliest(elements, weights, sets, bound, k):
    """(rank, dart) of the earliest dart of each set and coordinate with a rank below the set's bound."""
    best = np.full((len(bound), k), np.inf)
    ids = np.zeros((len(bound), k), np.uint32)
    # weight cells [0, 1), [1, 2), [2, 4), ...; rank blocks of area 1
    cell = 0
    left = np.arange(len(elements))
    found = []
    while len(left):
        low, high = (0.0, 1.0) if cell == 0 else (2.0 ** (cell - 1), 2.0**cell)
        left = left[weights[left] > low]
        width = high - low
        blocks = np.ceil(bound[sets[left]] * width).astype(np.int64)
        which = np.repeat(left, blocks)
        block = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        seed = mix(elements[which] + mix(block.astype(np.uint64) * np.uint64(64) + np.uint64(cell)))
        darts = np.searchsorted(_POISSON, _uniform(mix(seed + np.uint64(1))))
        which, seed, block = np.repeat(which, darts), np.repeat(seed, darts), np.repeat(block, darts)
        number = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(seed ^ mix(number.astype(np.uint64) + np.uint64(2)))
        rank = (block + _uniform(dart)) / width
        second = mix(dart + np.uint64(3))
        weight = low + _uniform(second) * width
        hit = (rank < bound[sets[which]]) & (weight < weights[which])
        found.append((sets[which[hit]] * k + (mix(second)[hit] % np.uint64(k)).astype(np.int64), rank[hit], (dart[hit] & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
        cell += 1
    if found:
        at, rank, dart = (np.concatenate(x) for x in zip(*found))
        np.minimum.at(best.reshape(-1), at, rank)
        winner = best.reshape(-1)[at] == rank
        ids.reshape(-1)[at[winner]] = dart[winner]
    return best, ids


def shingles(chunk, size: int = SHINGLE, counts: bool = False):
    """(hash, times, row) of the distinct shingles of each text of a chunk, by row and hash, and two hashes of each whole text's words."""
    starts, ends, offsets = word_spans(chunk)
    words = span_hashes(chunk.data, starts, ends)
    n = np.diff(offsets)
    rolling = Rolling(words, 0)
    begin = np.arange(len(words))
    row = np.repeat(np.arange(chunk.rows), n)
    last = np.repeat(offsets[1:], n)
    ok = (begin + size <= last) | (begin == np.repeat(offsets[:-1], n))
    begin, row, last = begin[ok], row[ok], last[ok]
    h = rolling.runs(begin, np.minimum(begin + size, last))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    whole = [Rolling(words, i).runs(offsets[:-1], offsets[1:]) for i in (0, 1)]
    return h[at], times if counts else np.ones(len(at), np.int64), row[at], whole


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each set and band: a key of its coordinates."""
    s = signature[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), s.shape[:2])
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i])
    return key


def _ranks(short: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each set and band: the short coordinates that follow the band, as a number; it orders the sets of a bucket."""
    following = (np.arange(bands)[:, None] + 1) * rows + np.arange(8)[None, :]
    out = short[:, following % short.shape[1]]
    return np.ascontiguousarray(out).view(">u8")[:, :, 0].astype(np.uint64)


def number(docs: DataFrame, id: str) -> Column:
    """A whole number for each id: itself, or a hash of an id of another type."""
    return F.col(f"`{id}`").cast("long") if isinstance(docs.schema[id].dataType, IntegralType) else F.xxhash64(F.col(f"`{id}`"))


def _slim(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.where(F.col(f"`{id}`").isNotNull()).select(number(docs, id).alias("id"), text_or_empty(text).alias("t"))


def signatures(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, weights: str = WEIGHTS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, b1, b2, keys, short) of each text: two hashes of its words, band keys, and the short signature."""
    arrow_batches(docs.sparkSession)
    k = max(bands * rows, SHORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                h, times, row, whole = shingles(chunk, size, weights == "counts")
                some = np.unique(row)  # texts without words have no keys
                signature = dart_signatures(h, times.astype(float), np.searchsorted(some, row), len(some), k)
                has = np.zeros(chunk.rows, np.int32)
                has[some] = bands
                bounds = pa.array(np.append(0, np.cumsum(has)).astype(np.int32))
                short = np.zeros((chunk.rows, SHORT), np.uint8)
                short[some] = mix(signature[:, :SHORT].astype(np.uint64)) & np.uint64(255)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.rows), *[pa.array(signed(w)) for w in whole], pa.ListArray.from_arrays(bounds, pa.array(signed(_band_keys(signature, bands, rows).reshape(-1)))), pa.array([x.tobytes() for x in short], pa.binary())],
                    names=["id", "b1", "b2", "keys", "short"],
                )

    return _slim(docs, id, text).mapInArrow(run, "id long, b1 long, b2 long, keys array<long>, short binary")


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity of sets by their short signatures; one coordinate in 256 agrees by chance."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _shorts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SHORT)


def _spread(left: DataFrame, right: DataFrame, key: str, other: str, counted: DataFrame | None = None) -> DataFrame:
    """left JOIN right on `key`, which is unique in `right`. Keys that many rows of `left` have are dealt by a hash of `other`,
    and their one row of `right` goes to each part. These keys are few: less than `SALTED` can have more than a
    SALTED-th of the rows, so their list is broadcast. `counted`, a stored table, has the keys as `left` has them."""
    counted = left if counted is None else counted
    most = max(HOT, counted.count() // SALTED)
    hot = counted.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_hot", F.ceil(F.col("_n") / most).alias("_parts"))
    hot = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(other), parts)).drop("_hot", "_parts")
    copies = right.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_hot", "_parts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def _bucket_rows(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node, before, first): the nodes of buckets that may hold several, with the node before in order and the first of
    the bucket in the task. Dealt by ranges of (key, rank), so that a bucket of any size is spread over tasks; a bucket
    that ends or begins a task may go on elsewhere, so its nodes stay."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = np.diff(batch.column(1).offsets.to_numpy())
            rank = _ranks(_shorts(batch.column(2))[has > 0], bands, rows) if (has > 0).any() else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(1).flatten(), pa.array(signed(rank.reshape(-1))), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), has)))], names=["key", "rank", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for the one after it
        first_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            before, head = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
            alone = np.ones(len(key), bool)
            if held is not None:
                key, node, before, head, alone = np.append(held[0], key), np.append(held[1], node), np.append(held[2], before), np.append(held[3], head), np.append(held[4], alone)
            else:
                first_key = key[0]
                head[0], alone[0] = node[0], False
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            start = 0 if held is None else 1
            head[start:] = np.where(at[start:] == 0, head[0], node[at[start:]])
            again = np.flatnonzero(~new)
            before[again], alone[again], alone[again - 1] = node[again - 1], False, False
            alone[key == first_key] = False
            held = key[-1:], node[-1:], before[-1:], head[-1:], alone[-1:]
            ok = ~alone[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][ok]) for x in (key, node, before, head)], names=["key", "node", "before", "first"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[:4]], names=["key", "node", "before", "first"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = nodes.select("node", "keys", "short").mapInArrow(keyed, "key long, rank long, node long").repartitionByRange(parts, "key", "rank").sortWithinPartitions("key", "rank", "node")
    return ordered.select("key", "node").mapInArrow(shared, "key long, node long, before long, first long")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _neighbour_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of nodes: each with its neighbour in its bucket, and with the first of its bucket in its task."""
    met = rows.select("node", F.explode(F.array("before", "first")).alias("other")).where("other <> -1 AND other <> node")
    return met.select(*_ordered("node", "other")).distinct()


def _centre_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of each node with the most linked node of each of its buckets."""
    ends = [links.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("d")) for c in ("a", "b")]
    degree = ends[0].unionByName(ends[1]).groupBy("node").agg(F.sum("d").alias("d"))
    centre = rows.join(degree, "node").groupBy("key").agg(F.max_by("node", F.struct("d", -F.col("node"))).alias("centre"))
    return _spread(rows.select("key", "node"), centre, "key", "node").where("node <> centre").select(*_ordered("node", "centre")).distinct()


def _labelled(frame: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """The frame with the component of its column `node`; a node without links is its own."""
    of = labels.select(F.col("a").alias("_node"), F.col("b").alias("_label"))
    return frame.join(of, F.col(node) == F.col("_node"), "left").withColumn(label, F.coalesce("_label", node)).drop("_node", "_label")


def _several(rows: DataFrame, labels: DataFrame, sizes: DataFrame | None, block: int) -> DataFrame:
    """The rows (key, node) of buckets that hold several components, each with its label, whether it is outside the bucket's largest,
    and how many blocks there are of either side. `sizes` has the bytes of each node, where they differ."""
    labelled = _labelled(rows.select("key", "node"), labels, "node", "label")
    labelled = labelled.withColumn("size", F.lit(8 * BANDS + SHORT)) if sizes is None else labelled.join(sizes, "node")
    most = labelled.groupBy("key", "label").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("c"))
    largest = F.struct("n", -F.col("label"))
    most = most.groupBy("key").agg(F.max_by("label", largest).alias("most"), F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("c").alias("c"), F.max_by("c", largest).alias("top_c")).where("c > top_c")
    parts = lambda size, count: F.greatest(F.ceil(size / block), F.ceil(count / BLOCK_NODES), F.lit(1))
    most = most.select("key", "most", parts(F.col("n") - F.col("top"), F.col("c") - F.col("top_c")).alias("outside"), parts(F.col("n"), F.col("c")).alias("all"))
    several = _spread(labelled, most, "key", "node", rows)
    return stored(several.withColumn("out", F.col("label") != F.col("most")).withColumn("h", F.xxhash64("node")).drop("size", "most"), "bucket-nodes")


def _in_blocks(several: DataFrame, own: DataFrame) -> DataFrame:
    """The blocks' rows with what `own` has of their nodes: every node outside the bucket's largest component meets all its nodes;
    the two sides are dealt by hash."""
    columns = ["key", "i", "j", "side", "node", "label", "out"]
    asking = several.where("out").withColumn("i", F.expr("pmod(h, outside)")).withColumn("j", F.explode(F.expr("sequence(0L, all - 1)"))).withColumn("side", F.lit(0)).select(columns)
    asked = several.withColumn("j", F.expr("pmod(h, all)")).withColumn("i", F.explode(F.expr("sequence(0L, outside - 1)"))).withColumn("side", F.lit(1)).select(columns)
    blocks = asking.unionByName(asked).join(own, "node").select(*columns, *[c for c in own.columns if c != "node"])
    return blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut between blocks: tables of whole blocks."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(k).to_numpy() for k in range(3)]
        # rows up to the start of the batch's last block belong to whole blocks
        last = np.flatnonzero(np.any([k != k[-1] for k in at], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if waiting and not cut and any(waiting[-1].column(k)[-1].as_py() != at[k][0] for k in range(3)):
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
        if cut:
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)]).combine_chunks()
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _close_in(block: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of the pairs of different components in blocks whose short signatures may be close, the closest first among
    pairs compared at once; each in the first of the buckets that it shares."""
    key, i, j, side, node, label = (block.column(k).to_numpy() for k in range(6))
    out, short = block.column(6).to_numpy(), _shorts(block.column(8))
    keys = block.column(7).combine_chunks().flatten().to_numpy().reshape(len(key), -1)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    at = np.append(np.flatnonzero(new), len(key))
    ends = np.repeat(at[1:], np.diff(at))
    first = np.repeat(np.add.reduceat(side == 0, at[:-1]) + at[:-1], np.diff(at))
    left = np.flatnonzero(side == 0)
    n = (ends - first)[left]
    before = np.append(0, np.cumsum(n))
    for start in range(0, int(before[-1]), AT_ONCE):
        pair = np.arange(start, min(start + AT_ONCE, int(before[-1])))
        which = np.searchsorted(before, pair, side="right") - 1
        x = left[which]
        y = first[x] + pair - before[which]
        ok = (label[x] != label[y]) & (~out[y] | (node[x] < node[y]))
        x, y = x[ok], y[ok]
        same = _same(short[x], short[y])
        ok = same >= least
        x, y, same = x[ok], y[ok], same[ok]
        shared = keys[x] == keys[y]
        ok = keys[x, shared.argmax(axis=1)] == key[x]
        x, y, same = x[ok], y[ok], same[ok]
        order = np.argsort(-same, kind="stable")
        yield x[order], y[order]


def _close_rows(rows: DataFrame, nodes: DataFrame, labels: DataFrame, least: float, block: int = BLOCK_BYTES) -> DataFrame:
    """The rows (key, node) that are in a pair of different components of their bucket whose short signatures may be close."""
    several = _several(rows, labels, None, block)
    own = _among(nodes.select("node", "keys", "short"), several)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            close = np.zeros(table.num_rows, bool)
            for x, y in _close_in(table, least):
                close[x] = close[y] = True
            yield pa.RecordBatch.from_arrays([pa.array(table.column(k).to_numpy()[close]) for k in (0, 4)], names=["key", "node"])

    return _in_blocks(several, own).mapInArrow(run, "key long, node long").distinct()


def _block_links(rows: DataFrame, nodes: DataFrame, elements: DataFrame, labels: DataFrame, least: float, similarity: float, block: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between different components of a bucket, from blocks of about `block` bytes and BLOCK_NODES nodes at most.
    Short signatures choose the pairs that are checked; a pair is checked in the first of the buckets that it shares, and not once
    its components have a link here."""
    own = _among(nodes.select("node", "keys", "short"), rows).join(elements.select("node", "s"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            node, label, sets = table.column(4).to_numpy(), table.column(5).to_numpy(), table.column(9)
            done, links = set(), []
            for xs, ys in _close_in(table, least):
                for x, y in zip(xs.tolist(), ys.tolist()):
                    both = frozenset((label[x], label[y]))
                    if both not in done and similar(sets[x].as_py(), sets[y].as_py(), similarity):
                        done.add(both)
                        links.append((min(node[x], node[y]), max(node[x], node[y])))
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    several = _several(rows, labels, elements.select("node", "size"), block)
    return _in_blocks(several, own).mapInArrow(run, "a long, b long").distinct()


def _closest(pairs: DataFrame, shorts: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) whose short signatures may be close, those that are the closest of one of their nodes."""
    one = _spread(pairs, shorts.select(F.col("node").alias("a"), F.col("short").alias("x")), "a", "b")
    two = _spread(one, shorts.select(F.col("node").alias("b"), F.col("short").alias("y")), "b", "a", pairs).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = _same(_shorts(batch.column(2)), _shorts(batch.column(3)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same)], names=["a", "b", "same"]).filter(pa.array(same >= least))

    close = two.mapInArrow(run, "a long, b long, same double")
    ways = close.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "same"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "same"))).alias("w")).select("w.*")
    best = ways.groupBy("node").agg(F.max_by("other", F.struct("same", -F.col("other"))).alias("other"))
    return best.select(*_ordered("node", "other")).distinct()


def similar(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether two sets of hashes, each sorted or not, are as similar as `similarity`."""
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def _marks(nodes: DataFrame) -> Broadcast:
    """A sketch of the column `node`, 64 MB at most."""
    width = width_for(nodes.count(), MAX_WIDTH)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(width)
        for batch in batches:
            counting.add(batch.column(0).to_numpy().view(np.uint64))
        yield from counting.blocks()

    return nodes.sparkSession.sparkContext.broadcast(Sketch.gathered(nodes.mapInArrow(mark, BLOCK_SCHEMA), width))


def _marked(batch: pa.RecordBatch, marks: Broadcast) -> pa.RecordBatch:
    """The rows whose first column a sketch has, or seems to have."""
    return batch.filter(pa.array(marks.value.estimate(batch.column(0).to_numpy().view(np.uint64)) > 0))


def _among(frame: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of a frame whose first column is a `node` of `nodes`, and some more: few rows go on to a join by node."""
    marks = _marks(nodes.select("node").distinct())
    return frame.mapInArrow(lambda batches: (_marked(batch, marks) for batch in batches), frame.schema)


def _elements(docs: DataFrame, nodes: DataFrame, id: str, text: str, size: int, weights: str) -> DataFrame:
    """(node, size, s): the sorted 64-bit hashes of the shingles of `nodes` (node), and of some documents more, which a sketch of the
    nodes lets pass; they meet no pair. A shingle found again is an element of its own where they are counted."""
    marks = _marks(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _marked(batch, marks)
            for chunk in text_chunks(batch.column(1)):
                h, times, row, _ = shingles(chunk, size, weights == "counts")
                again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                h, row = mix(np.repeat(h, times) + again.astype(np.uint64)), np.repeat(row, times)
                order = np.lexsort((h, row))
                own = np.split(h[order].astype("<u8"), np.searchsorted(row[order], np.arange(1, chunk.rows)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.rows), pa.array([x.nbytes for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "size", "s"])

    return _slim(docs, id, text).mapInArrow(run, "node long, size long, s binary")


def _verified(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingles are as similar as `similarity`: sets by Jaccard, counted shingles by weighted Jaccard."""
    one = _spread(pairs, elements.select(F.col("node").alias("a"), F.col("s").alias("x")), "a", "b")
    two = _spread(one, elements.select(F.col("node").alias("b"), F.col("s").alias("y")), "b", "a", pairs).select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(x.as_py(), y.as_py(), similarity) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return two.mapInArrow(compare, "a long, b long").distinct()


def _links(docs: DataFrame, nodes: DataFrame, repeated: bool, id: str, text: str, size: int, weights: str, similarity: float, bands: int, rows: int) -> DataFrame:
    """(a, b): each node that has links but the least of its component, with that least node."""
    shorts = nodes.select("node", "short")
    buckets = stored(_bucket_rows(nodes, bands, rows), "bucket-rows")
    least = similarity - MARGIN

    def sets(of: DataFrame) -> DataFrame:
        elements = _elements(docs, of.distinct(), id, text, size, weights)
        return stored(elements.dropDuplicates(["node", "s"]) if repeated else elements, "elements")

    def checked(pairs: DataFrame) -> DataFrame:
        return pairs if pairs.isEmpty() else stored(_verified(pairs, sets(pairs.select(F.explode(F.array("a", "b")).alias("node"))), similarity), "links")

    tried = stored(_closest(stored(_neighbour_pairs(buckets), "pairs"), shorts, least), "pairs")
    found = checked(tried)
    near = stored(_centre_pairs(buckets, found).join(tried, ["a", "b"], "left_anti"), "pairs")
    labels = components(found.unionByName(checked(stored(_closest(near, shorts, least), "pairs"))))
    nodes = nodes.where("size(keys) > 0")
    close = stored(_close_rows(buckets, nodes, labels, least), "close-rows")
    if not close.isEmpty():
        new = stored(_block_links(close, nodes, sets(close.select("node")), labels, least, similarity), "links")
        labels = labels if new.isEmpty() else components(labels.unionByName(new))
    return labels


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, weights: str = WEIGHTS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id) for each row of `docs`: the least id of the documents that links connect with it; its own where none do."""
    signed_ = stored(signatures(docs, id, text, size, weights, bands, rows), "signatures")
    nodes = stored(signed_.groupBy("b1", "b2").agg(F.min("id").alias("node"), F.min_by(F.struct("keys", "short"), "id").alias("s")).select("node", "b1", "b2", "s.*"), "nodes")
    twice = stored(signed_.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-ids")
    repeated = not twice.isEmpty()
    labels = _links(docs, nodes, repeated, id, text, size, weights, similarity, bands, rows)
    if repeated:  # rows of one id are one document, whatever their texts
        own = signed_.join(twice, "id").select("id", "b1", "b2").distinct().join(nodes.select("b1", "b2", "node"), ["b1", "b2"])
        own = own.join(own.groupBy("id").agg(F.min("node").alias("least")), "id").where("node <> least")
        labels = components(labels.unionByName(own.select(F.col("node").alias("a"), F.col("least").alias("b"))))
    of_text = _labelled(nodes.select("node", "b1", F.col("b2").alias("c2")), labels, "node", "class").select("b1", "c2", "class")
    of_id = _spread(signed_.select("id", "b1", "b2"), of_text, "b1", "id").where("b2 = c2").groupBy(F.col("id").alias("_id")).agg(F.min("class").alias("class"))
    plain = docs.select(F.col(f"`{id}`").alias("_own"), number(docs, id).alias("_number"))
    if not isinstance(docs.schema[id].dataType, IntegralType):  # from the number of a class back to its id
        names = plain.where("_own IS NOT NULL").distinct().select(F.col("_number").alias("class"), F.col("_own").alias("name"))
        of_id = _spread(stored(of_id, "numbered"), names, "class", "_id").select("_id", F.col("name").alias("class"))
    both = plain.join(of_id, (F.col("_number") == F.col("_id")) & F.col("_own").isNotNull(), "left")
    return both.select(F.col("_own").alias(id), F.col("class").alias("class_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents, columns as they were, without those that have a class with a smaller id; of rows with one id and one
    text, one stays. Rows of one id with different texts stay, and rows without id."""
    names = docs.columns
    left = docs.select([F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    key, value = f"c{names.index(id)}", f"c{names.index(text)}"
    gone = classes(docs, id, text, **how).where(F.col(id) != F.col("class_id")).select(F.col(id).alias("gone")).distinct()
    kept = left.where(F.col(key).isNotNull()).join(gone, F.col(key) == F.col("gone"), "left_anti")
    plain = [c for c, kind in left.dtypes if "map<" not in kind and kind != "variant"]
    first = Window.partitionBy(key, text_or_empty(value)).orderBy(F.xxhash64(*plain))
    kept = kept.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return kept.unionByName(left.where(F.col(key).isNull())).toDF(*names)
