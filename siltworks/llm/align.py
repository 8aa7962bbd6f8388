"""Alignment of two tokenizers' ids over whole texts, with counts of the pairs of ids that overlap.

A text, with a space before it, is encoded by A (byte-level BPE) and by B (sentence pieces). Byte offsets at which tokens of both
end cut the tokens into groups; within a group, an A token and a B token are linked where their bytes overlap.

Both tokenizers end a token before a space that follows a character other than white space, so a text is cut there into units, and
each unit's alignment is a function of the unit alone; it is made once and kept. Identity map: for each A id, the B id of the same
bytes. Groups of one A token and its identity in B are counted in a vector as long as A's vocabulary; only the links of other
groups are pairs that Spark shuffles.

Texts are dealt to blocks, of which each holds a bounded number of links of units and of words (and one batch more). A block's row has the units' links and how
often each unit is there; a document's row has the units by their numbers. Pairs are counted from blocks, so each pair is shuffled once
for each block that has it. The counts of a block's pairs then go back to the block and are added up for its units, and those
for its documents. No vector or list grows with the corpus: vectors are as long as the vocabularies, which are checked, lists as
long as a block.

Defined cases: a null or empty text, and one whose tokens' bytes are not the text's (U+2581 in it, or a text that B changes), has
no tokens, zeros and an empty digest; special tokens' strings are plain text; a text of any length is one document, a unit of more than
LONG_UNIT characters is aligned anew each time; rows that repeat or share an id are documents of their own; ties for a B id's
highest count are all best; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import MAX_VOCABULARY_BYTES, byte_letters, require_byte_level, split_words
from .shared import arrow_batches, stored, text_or_empty

#: A block is closed when its units have so many links together, or its documents so many words.
BLOCK_LINKS = 1_000_000
BLOCK_WORDS = 2_000_000
#: Longer units, as in texts without spaces, are not kept.
LONG_UNIT = 64
#: Ids of a vocabulary; a larger one is refused.
MAX_IDS = 1 << 20

#: A space behind anything but white space begins a unit. White space of the byte-level pattern.
_UNITS = re.compile("(?<=[^\t-\r \x85\xa0  -     　])(?= )")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Vocabularies:
    """The two files' contents, the bytes of each id, and for each A id the B id of the same bytes, or -1."""

    a_spec: str
    b_model: bytes
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    identity: np.ndarray
    #: Whether A's merges are those of its tokens by rank (`by_rank`).
    ranked: bool

    @classmethod
    def read(cls, a_path: str, b_path: str) -> Vocabularies:
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            a_spec = f.read(MAX_VOCABULARY_BYTES + 1)
        with open(b_path, "rb") as f:
            b_model = f.read(MAX_VOCABULARY_BYTES + 1)
        if len(a_spec) > MAX_VOCABULARY_BYTES or len(b_model) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"a vocabulary file holds more than {MAX_VOCABULARY_BYTES} bytes")
        spec = json.loads(a_spec)
        require_byte_level(spec)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        a_bytes = [b""] * (1 + max([*vocab.values(), *specials.values()]))
        for token, i in vocab.items():
            a_bytes[i] = bytes(letters[c] for c in token) if token not in specials else token.encode()
        pieces = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        require_pieces(pieces)
        b_bytes = [piece_bytes(pieces, i) for i in range(pieces.get_piece_size())]
        if max(len(a_bytes), len(b_bytes)) > MAX_IDS:
            raise ValueError(f"a vocabulary holds more than {MAX_IDS} ids")
        # a piece before a byte piece of the same bytes
        by_bytes = {b_bytes[i]: i for i in sorted(range(len(b_bytes)), key=lambda i: (not pieces.is_byte(i), i), reverse=True) if b_bytes[i]}
        identity = np.array([by_bytes.get(x, -1) if x else -1 for x in a_bytes], np.int64)
        return cls(a_spec, b_model, a_bytes, b_bytes, identity, by_rank(spec))


def by_rank(spec: dict) -> bool:
    """Whether merging two parts whenever their bytes together are a token, the token of the least id first, gives the ids of the file's
    merges. It does if ids rise with the merges and each merged token's own bytes are encoded as that token: within the
    bytes of a token, parts are merged as if nothing stood beside them, so the two parts that make it are those of its merge."""
    from tokenizers import Tokenizer

    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
    ids = [vocab[m] for m in made]
    model = Tokenizer.from_str(json.dumps(spec)).model
    return all(a < b for a, b in zip(ids, ids[1:])) and all(vocab[c] < ids[0] for c in byte_letters()) and all([t.id for t in model.tokenize(m)] == [i] for m, i in zip(made, ids))


def require_pieces(pieces) -> None:
    """Refuses a model in which a token may go on behind a word and a space, or that has a piece for what is to be plain text."""
    wrong = [p for p in map(pieces.id_to_piece, range(pieces.get_piece_size())) if "▁" in p.lstrip("▁")]
    if wrong or pieces.encode("a", out_type=str)[0][:1] != "▁" or pieces.is_unknown(pieces.piece_to_id("▁")):
        raise ValueError("not a model of words with a space before each")


def piece_bytes(pieces, i: int) -> bytes:
    """The bytes of a piece; none for control pieces and the unknown one."""
    if pieces.is_control(i) or pieces.is_unknown(i):
        return b""
    piece = pieces.id_to_piece(i)
    if pieces.is_byte(i):
        return bytes([int(_BYTE_PIECE.fullmatch(piece)[1], 16)])
    return piece.replace("▁", " ").encode()


@dataclass(slots=True)
class Unit:
    """A unit's alignment. ok: the tokens' bytes are the unit's. same: A ids of one-to-one groups; pairs: other links; both as bytes."""

    ok: bool
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: str = ""
    same: bytes = b""
    pairs: bytes = b""


class Aligner:
    def __init__(self, v: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.v = v
        if v.ranked:
            merged = json.loads(v.a_spec)["model"]["vocab"].values()
            self.word = tiktoken.Encoding("a", pat_str="", mergeable_ranks={v.a_bytes[i]: i for i in merged if v.a_bytes[i]}, special_tokens={})._encode_single_piece
        else:
            model, letters = Tokenizer.from_str(v.a_spec).model, {b: c for c, b in byte_letters().items()}
            self.word = lambda word: [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(letters))]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=v.b_model)
        self.space = self.b.piece_to_id("▁")
        # units of the task's block before
        self.known: dict[str, Unit] = {}
        self.a_size, self.b_size = np.array(list(map(len, v.a_bytes))), np.array(list(map(len, v.b_bytes)))
        # an id in decimal with what stands behind it: A's within a group, its last one, B's within a group, its last one
        self.written = [f"{i}{mark}" for size, marks in ((len(v.a_bytes), ",|"), (len(v.b_bytes), ",;")) for mark in marks for i in range(size)]

    def align(self, units: list[str]) -> list[Unit]:
        """The alignment of each unit; a unit begins with a space."""
        raw = [u.encode() for u in units]
        word = self.word
        a = [list(chain.from_iterable([word(w) for w in split_words(u)])) for u in units]
        # the model puts the space before each unit, but not where there is nothing else
        b = [own or [self.space] for own in self.b.encode([u[1:] for u in units], num_threads=1)]
        if self._fit(raw, a, b):
            return self._aligned(raw, a, b)
        fits = [self._fit([r], [x], [y]) for r, x, y in zip(raw, a, b)]
        good = [k for k, ok in enumerate(fits) if ok]
        made = iter(self._aligned([raw[k] for k in good], [a[k] for k in good], [b[k] for k in good]) if good else ())
        return [next(made) if ok else Unit(False) for ok in fits]

    def _fit(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> bool:
        """Whether the tokens' bytes are those of the units, unit by unit."""
        whole, ends = b"".join(raw), np.cumsum(list(map(len, raw)))
        for ids, tokens, sizes in ((a, self.v.a_bytes, self.a_size), (b, self.v.b_bytes, self.b_size)):
            flat = list(chain.from_iterable(ids))
            if b"".join(map(tokens.__getitem__, flat)) != whole:
                return False
            last = np.cumsum(list(map(len, ids)))
            if not np.array_equal(np.concatenate([[0], np.cumsum(sizes[flat])])[last], ends):
                return False
        return True

    def _aligned(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[Unit]:
        """All units at once, as one run of bytes. Between two neighbouring ends of tokens lies the overlap of just one A token
        and one B token."""
        a_size, b_size = len(self.v.a_bytes), len(self.v.b_bytes)
        of_a, of_b = np.fromiter(chain.from_iterable(a), np.int64), np.fromiter(chain.from_iterable(b), np.int64)
        ends = np.cumsum(list(map(len, raw)))
        ends_a, ends_b = np.cumsum(self.a_size[of_a]), np.cumsum(self.b_size[of_b])
        # at each byte offset: does a token end there, and how many have ended before
        at_a, at_b = np.zeros(ends[-1] + 1, bool), np.zeros(ends[-1] + 1, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        both, either = at_a & at_b, at_a | at_b
        n_before = lambda marks: np.cumsum(marks) - marks
        before_a, before_b, groups_before = n_before(at_a), n_before(at_b), n_before(both)
        pieces = np.flatnonzero(either)
        pair_a, pair_b, group = of_a[before_a[pieces]], of_b[before_b[pieces]], groups_before[pieces]
        same = (np.bincount(group)[group] == 1) & (self.v.identity[pair_a] == pair_b)
        pairs, pair_at = pair_a[~same] * b_size + pair_b[~same], np.cumsum(~same)
        same_ids, same_at = pair_a[same].astype(np.int32), np.cumsum(same)
        # each group's A ids, then its B ids: an A id stands behind the B ids of the groups before, a B id behind its group's A ids too
        cuts = np.flatnonzero(both)
        b_until, a_until = np.concatenate([[0], before_b[cuts] + 1]), before_a[cuts] + 1
        shown = np.empty(len(of_a) + len(of_b), np.int64)
        shown[np.arange(len(of_a)) + b_until[groups_before[ends_a]]] = of_a + at_b[ends_a] * a_size
        shown[np.arange(len(of_b)) + a_until[groups_before[ends_b]]] = 2 * a_size + of_b + at_a[ends_b] * b_size
        text = list(map(self.written.__getitem__, shown.tolist()))
        last = np.cumsum(either)[ends] - 1
        counts = zip(map(len, a), map(len, b), np.diff(np.cumsum(both)[ends], prepend=0).tolist(), np.diff(last + 1, prepend=0).tolist())
        out, t, p, s = [], 0, 0, 0
        for (n_a, n_b, n_groups, n_links), p_end, s_end in zip(counts, pair_at[last].tolist(), same_at[last].tolist()):
            out.append(Unit(True, n_a, n_b, n_groups, n_links, "".join(text[t : t + n_a + n_b])[:-1], same_ids[s:s_end].tobytes(), pairs[p:p_end].tobytes()))
            t, p, s = t + n_a + n_b, p_end, s_end
        return out


def split_units(text: str) -> list[str]:
    """The units of a text with a space before it."""
    return _UNITS.split(" " + text)


_aligners: dict[int, Aligner] = {}


def _task_aligner(v: Vocabularies) -> Aligner:
    if id(v) not in _aligners:
        _aligners.clear()
        _aligners[id(v)] = Aligner(v)
    return _aligners[id(v)]


class _Block:
    """Units by number, their sizes, how often each is there, and their links."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.units: list[Unit] = []
        # of each unit: whether it fits, its A and B tokens, groups and links, and its times
        self.sizes = np.zeros((1024, 5), np.int64)
        self.times = np.zeros(1024, np.int64)
        self.words = 0
        self.links = 0

    def _add(self, units: list[Unit]) -> None:
        n = len(self.units)
        self.units += units
        while len(self.units) > len(self.times):
            self.sizes, self.times = np.concatenate([self.sizes, np.zeros_like(self.sizes)]), np.concatenate([self.times, np.zeros_like(self.times)])
        self.sizes[n : len(self.units)] = [(u.ok, u.n_a, u.n_b, u.n_groups, u.n_links) for u in units]
        self.links += len(units) + int(self.sizes[n : len(self.units), 4].sum())

    def number(self, names: list[str], aligner: Aligner) -> np.ndarray:
        """The number of each unit; units new to the block are aligned."""
        get = self.numbers.get
        found = [get(u, -1) for u in names]
        if -1 in found:
            new = list(dict.fromkeys([u for u, k in zip(names, found) if k < 0]))
            unknown = [u for u in new if u not in aligner.known]
            made = dict(zip(unknown, aligner.align(unknown))) if unknown else {}
            own = dict(zip(new, range(len(self.units), len(self.units) + len(new))))
            self._add([made[u] if u in made else aligner.known[u] for u in new])
            self.numbers.update({u: k for u, k in own.items() if len(u) <= LONG_UNIT})
            found = [own[u] if k < 0 else k for u, k in zip(names, found)]
        return np.array(found, np.int64)

    def count(self, numbers: np.ndarray, times: np.ndarray) -> None:
        self.times[numbers] += times
        self.words += int(times.sum())

    def kept(self) -> dict[str, Unit]:
        return {u: self.units[k] for u, k in self.numbers.items()}


CODED = "block long, id {id}, n_a long, n_b long, n_groups long, n_links long, groups string, units array<int>, times array<long>, same_ends array<int>, same array<int>, pair_ends array<int>, pairs array<long>"
_NAMES = [c.split()[0] for c in CODED.split(", ")]


def _lists(parts: list, kind) -> pa.Array:
    arrays = [np.asarray(x, kind) for x in parts]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, kind)])))


def _list(parts: list[bytes], kind) -> pa.Array:
    """One list of all parts."""
    return _lists([np.frombuffer(b"".join(parts), kind)], kind)


def coded(docs: DataFrame, vocabularies: Vocabularies, id: str = "doc_id", text: str = "text", hashed: bool = True) -> DataFrame:
    """Rows of documents (units by number, with their times) and, with a null `n_a`, one row for each block: its units' times
    and links. `groups` is the text of a document's groups, or its digest where `hashed`."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(vocabularies)
    slim = docs.select(F.col(id).alias("id"), text_or_empty(text).alias("t"))

    def documents(block: int, ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        cut = lambda k: pa.array([r[k] for r in rows], pa.int64())
        none = lambda kind: pa.nulls(n, pa.list_(kind))
        columns = [pa.array([block] * n, pa.int64()), ids, cut(0), cut(1), cut(2), cut(3), pa.array([r[4] for r in rows], pa.string()), _lists([r[5] for r in rows], np.int32), _lists([r[6] for r in rows], np.int64)]
        return pa.RecordBatch.from_arrays([*columns, none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.int64())], names=_NAMES)

    def ended(number: int, block: _Block, kind: pa.DataType) -> pa.RecordBatch:
        ends = lambda lists, size: np.cumsum([len(x) // size for x in lists])
        same, pairs = [u.same for u in block.units], [u.pairs for u in block.units]
        none = lambda t: pa.nulls(1, t)
        columns = [pa.array([number], pa.int64()), none(kind), *[none(pa.int64())] * 4, none(pa.string()), none(pa.list_(pa.int32())), _lists([block.times[: len(block.units)]], np.int64)]
        return pa.RecordBatch.from_arrays([*columns, _lists([ends(same, 4)], np.int32), _list(same, np.int32), _lists([ends(pairs, 8)], np.int32), _list(pairs, np.int64)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _task_aligner(shared.value)
        aligner.known = {}
        number = TaskContext.get().partitionId() << 32
        block, kind = _Block(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at, n in text_runs(batch.column(1), 100, 1 << 19):
                part = batch.slice(at, n)
                yield documents(number, part.column(0), _documents(block, part.column(1).to_pylist(), aligner, hashed))
                if block.links >= BLOCK_LINKS or block.words >= BLOCK_WORDS:
                    yield ended(number, block, kind)
                    aligner.known, number, block = block.kept(), number + 1, _Block()
        if block.words:
            yield ended(number, block, kind)
        # the worker may stay idle beside later stages
        aligner.known = {}

    return slim.mapInArrow(run, CODED.format(id=slim.schema["id"].dataType.simpleString()))


def text_runs(texts: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of consecutive texts: at most so many rows, and so many bytes but for the last text."""
    first, held = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n
        if held >= size or k + 1 - first >= rows:
            yield first, k + 1 - first
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts) - first


def _documents(block: _Block, texts: list[str], aligner: Aligner, hashed: bool) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups, numbers of units, their times) of each text."""
    names = [split_units(t) if t else [] for t in texts]
    all_numbers = block.number(list(chain.from_iterable(names)), aligner)
    out, at = [], 0
    for own_names in names:
        numbers, at = all_numbers[at : at + len(own_names)], at + len(own_names)
        sizes = block.sizes[numbers]
        if not len(numbers) or not sizes[:, 0].all():
            out.append((0, 0, 0, 0, "", [], []))
            continue
        own, times = np.unique(numbers, return_counts=True)
        block.count(own, times)
        groups = ";".join([block.units[k].groups for k in numbers.tolist()])
        out.append((*sizes[:, 1:].sum(axis=0).tolist(), hashlib.sha256(groups.encode()).hexdigest() if hashed else groups, own, times))
    return out


def pair_counts(table: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """(pair, n, best) of every pair of linked ids: how many links hold it, and whether no pair of the B id has more. A pair is
    A's id times B's number of ids, plus B's id."""
    spark = table.sparkSession
    n_a, n_b = len(vocabularies.a_bytes), len(vocabularies.b_bytes)
    blocks = table.where(F.col("n_a").isNull()).select("times", "same_ends", "same", "pair_ends", "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(n_a, np.int64)
        for batch in batches:
            for times, same_ends, same, ends, pairs in zip(*[[x.values.to_numpy() for x in c] for c in batch.columns]):
                np.add.at(vector, same, np.repeat(times, np.diff(same_ends, prepend=0)))
                own, where = np.unique(pairs, return_inverse=True)
                sums = np.zeros(len(own), np.int64)
                np.add.at(sums, where, np.repeat(times, np.diff(ends, prepend=0)))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int32()), pa.array(own), pa.array(sums)], names=["a", "pair", "n"])
        there = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.nulls(len(there), pa.int64()), pa.array(vector[there])], names=["a", "pair", "n"])

    counted = blocks.mapInArrow(run, "a int, pair long, n long")
    # the vectors' rows, at most one for each id of A and task, become pairs with the identity
    same = spark.createDataFrame([(int(a), int(a) * n_b + int(b)) for a, b in enumerate(vocabularies.identity) if b >= 0], "a int, own long")
    pairs = counted.join(F.broadcast(same), "a", "left").select(F.coalesce("pair", "own").alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = stored(pairs, "pairs")
    b = F.col("pair") % n_b
    most = pairs.groupBy(b.alias("_b")).agg(F.max("n").alias("_most"))
    return stored(pairs.join(F.broadcast(most), b == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best")), "pair-counts")


def align(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text", hashed: bool = True) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document. `n_best`: links whose pair's count is the
    highest of its B id; `count_sum`: the pairs' counts, added up over all links; `groups`: as `a1,a2|b1;a3|b2,b3` in decimal
    ids, or its digest (`hashed`), empty without tokens."""
    vocabularies = Vocabularies.read(a_path, b_path)
    table = stored(coded(docs, vocabularies, id, text, hashed), "coded")
    counts = pair_counts(table, vocabularies)
    return _scored(table, counts, vocabularies).withColumnRenamed("id", id)


def _scored(table: DataFrame, counts: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    spark = table.sparkSession
    n_b = len(vocabularies.b_bytes)
    # counts of the identity pairs, one for each id of A at most
    identity = spark.createDataFrame([(int(a) * n_b + int(b), int(a)) for a, b in enumerate(vocabularies.identity) if b >= 0], "pair long, a int")
    same_n, same_best = np.zeros(len(vocabularies.a_bytes), np.int64), np.zeros(len(vocabularies.a_bytes), bool)
    for r in counts.join(F.broadcast(identity), "pair").collect():
        same_n[r.a], same_best[r.a] = r.n, r.best
    vectors = spark.sparkContext.broadcast((same_n, same_best))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs in zip(batch.column(0), batch.column(1)):
                own = np.unique(pairs.values.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block.as_py(), np.int64)), pa.array(own)], names=["block", "pair"])

    blocks = table.where(F.col("n_a").isNull())
    looked_up = blocks.select("block", "pairs").mapInArrow(wanted, "block long, pair long").join(counts, "pair").select("block", "pair", "n", "best")
    id_type = table.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    names = [c.split()[0] for c in schema.split(", ")]

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows, found = rows.combine_chunks(), found.combine_chunks()
        is_block = rows.column("n_a").is_null()
        docs = rows.filter(rows.column("n_a").is_valid())
        sums, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in rows.filter(is_block).select(["same_ends", "same", "pair_ends", "pairs"]).to_batches():
            same_ends, same, ends, pairs = (c[0].values.to_numpy() for c in r.columns)
            order = np.argsort(found.column("pair").to_numpy())
            at = order[np.searchsorted(found.column("pair").to_numpy()[order], pairs)] if len(pairs) else np.zeros(0, np.int64)
            n, top = found.column("n").to_numpy()[at], found.column("best").to_numpy()[at].astype(np.int64)
            add = lambda values, ends: np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)
            sums = add(n, ends) + add(vectors.value[0][same], same_ends)
            best = add(top, ends) + add(vectors.value[1][same].astype(np.int64), same_ends)
        of_doc = docs.column("units").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(np.nan_to_num(of_doc.value_lengths().to_numpy(zero_copy_only=False)))]).astype(np.int64)
        units, times = of_doc.flatten().to_numpy(), docs.column("times").combine_chunks().flatten().to_numpy()
        total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[units] * times)])[ends])
        made = {"n_best": pa.array(total(best)), "count_sum": pa.array(total(sums))} if len(sums) else {c: pa.array(np.zeros(docs.num_rows, np.int64)) for c in ("n_best", "count_sum")}
        return pa.table({c: made[c] if c in made else docs.column(c) for c in names})

    return table.groupBy("block").cogroup(looked_up.groupBy("block")).applyInArrow(score, schema)
