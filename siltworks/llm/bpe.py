"""Byte-level BPE encoding and decoding with a contiguous array of ranks.

A text is cut at the special tokens of the vocabulary, then into words by the byte-level pattern.
Each word's parts lie in one array of boundaries; beside it lies the rank of every adjacent pair.
The array is scanned for the least rank, that boundary is deleted, and the ranks of the two
neighbouring pairs are looked up again, until no pair has a rank. Words of a batch that are not in
the cache are merged together: a matrix with a row for each word, one scan per round for all rows.
A word of more than `SHORT` bytes is merged alone with a heap over a linked list, so that a text
without blanks takes n log n steps.

Defined cases: a null or empty text has no ids; a special token's string in a text is that token;
each row is encoded alone; columns besides id and text are ignored, and kept by `add_ids`; bytes that
are no UTF-8 after decoding become U+FFFD; rows that repeat are encoded each; an empty table gives an empty table. A
vocabulary file that asks for more than plain byte-level BPE, or has more than MAX_IDS ids or merges, is refused. Learnt words are kept in two generations: where one is full it becomes the older, which words
are taken over from, so words in use are never learnt again.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_batches, free_names, text_or_empty

#: Words of at most so many bytes are merged in matrices.
SHORT = 32
#: Words that a task keeps with their ids, in each of two generations.
CACHE_WORDS = 200_000
#: Vocabulary files are read whole by the driver and sent to each executor; a larger file is refused.
MAX_VOCABULARY_BYTES = 64 << 20

#: Ids and merges that a vocabulary may have: a pair of ids, and a rank with a pair's place, are one number each.
MAX_IDS = 1 << 20

_NO_RANK = np.int64(1) << np.int64(40)

#: The pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EXACT = regex.compile(PATTERN)
#: The same words, from the faster standard library, for texts without characters on which the two disagree.
_FAST = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7e\xa0\xa1\xa3-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧぀-ゟ一-鿿]*")
#: Code points that `regex` takes for letters or numbers by a later Unicode version than the
#: tokenizer's, which takes them for other characters. They are split as such.
LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 "
    "1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
_LATER = re.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b or a, 16))}" for a, _, b in (x.partition("-") for x in LATER.split())) + "]")


def split_words(text: str) -> list[str]:
    """The words of a text; joined, they are the text."""
    if _PLAIN.fullmatch(text):
        return _FAST.findall(text)
    if _LATER.search(text):
        return [text[m.start() : m.end()] for m in _EXACT.finditer(_LATER.sub("\u2e2e", text))]
    return _EXACT.findall(text)


def require_byte_level(spec: dict) -> None:
    """Refuses a tokenizer file that asks for anything but byte-level BPE with this module's pattern."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if spec.get("normalizer"):
        wrong.append("normalizer")
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if model.get("type", "BPE") != "BPE" or any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        wrong.append("model type or added tokens")
    if wrong:
        raise ValueError(f"not plain byte-level BPE: {', '.join(wrong)}")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next free one from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """tokens: the bytes of each id; pairs: (left id, right id) -> (rank, merged id); specials: string -> id."""

    tokens: list[bytes]
    byte_ids: list[int]
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    specials: dict[str, int]
    pairs: dict[int, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            data = f.read(MAX_VOCABULARY_BYTES + 1)
        if len(data) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} holds more than {MAX_VOCABULARY_BYTES} bytes")
        return cls.of(json.loads(data))

    @classmethod
    def of(cls, spec: dict) -> Vocabulary:
        require_byte_level(spec)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        most = 1 + max([*vocab.values(), *specials.values()])
        if max(most, len(spec["model"]["merges"])) > MAX_IDS:
            raise ValueError(f"a vocabulary of more than {MAX_IDS} ids or merges")
        tokens = [b""] * most
        for token, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in token)
        for token, i in specials.items():
            tokens[i] = token.encode()
        pairs = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault(vocab[left] << 20 | vocab[right], (rank, vocab[left + right]))
        keys = np.array(sorted(pairs), np.int64)
        found = np.array([pairs[k] for k in keys.tolist()], np.int64).reshape(-1, 2)
        singles = {b: vocab[c] for c, b in letters.items()}
        return cls(tokens, [singles[b] for b in range(256)], keys, found[:, 0].copy(), found[:, 1].copy(), specials)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, cache_words: int = CACHE_WORDS):
        self.v = vocabulary
        self.singles = np.array(vocabulary.byte_ids, np.int64)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.specials, key=len, reverse=True)))) if vocabulary.specials else None
        size = 1 << 19
        while size < 8 * len(vocabulary.keys):
            size *= 2
        self.mask = size - 1
        self.slots = self._table(size)

    def _table(self, size: int) -> np.ndarray:
        """Open addressing over the pairs: a slot holds an index of a pair, or -1. The longest probe is kept."""
        slots = np.full(size, -1, np.int32)
        left = np.arange(len(self.v.keys))
        at = self._home(self.v.keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = slots[at] < 0
            slots[at[free]] = left[free]
            lost = slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask
        return slots

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The index of each pair, or -1."""
        keys = left << 20 | right
        at = self._home(keys)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.v.keys[slot] == keys[todo])
            out[todo[hit]] = slot[hit]
            more = ~hit & (slot >= 0)
            todo, at = todo[more], (at[more] + 1) & self.mask
            if not len(todo):
                break
        return out

    def _merge_short(self, words: list[bytes]) -> list[bytes]:
        """Words of at most SHORT bytes, all at once: a row of parts and a row of ranks for each word."""
        n = np.array([len(w) for w in words])
        width = int(n.max())
        flat = self.singles[np.frombuffer(b"".join(words), np.uint8)]
        parts = np.zeros((len(words), width + 1), np.int64)
        inside = np.arange(width)[None, :] < n[:, None]
        parts[:, :width][inside] = flat
        ranks = np.full((len(words), width + 1), _NO_RANK)
        pairs = np.arange(width)[None, :] < n[:, None] - 1
        rows, cols = np.nonzero(pairs)
        index = self._lookup(parts[rows, cols], parts[rows, cols + 1])
        known = index >= 0
        ranks[rows[known], cols[known]] = self.v.ranks[index[known]] << 20 | index[known]
        live = np.arange(len(words))
        places = np.arange(width)
        while len(live):
            own = ranks[live]
            at = own.argmin(axis=1)
            best = own[np.arange(len(live)), at]
            going = best < _NO_RANK
            live, at, best = live[going], at[going], best[going]
            if not len(live):
                break
            # delete the boundary after `at`: everything behind moves one place to the left
            take = places[None, :] + (places[None, :] > at[:, None])
            rows = live[:, None]
            shifted = parts[rows, take]
            shifted[np.arange(len(live)), at] = self.v.merged[best & 0xFFFFF]
            parts[live, :width] = shifted
            moved = ranks[rows, np.minimum(places[None, :] + (places[None, :] >= at[:, None]), width)]
            n[live] -= 1
            for side in (at - 1, at):
                fresh = (side >= 0) & (side + 1 < n[live])
                out = np.full(len(live), _NO_RANK)
                which = np.flatnonzero(fresh)
                index = self._lookup(shifted[which, side[which]], shifted[which, side[which] + 1])
                known = index >= 0
                out[which[known]] = self.v.ranks[index[known]] << 20 | index[known]
                has = side >= 0
                moved[np.flatnonzero(has), side[has]] = out[has]
            ranks[live, :width] = moved
        ids = parts[np.arange(width + 1)[None, :] < n[:, None]].astype("<i4").tobytes()
        ends = (np.cumsum(n) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, word: bytes) -> bytes:
        """One long word: parts in a linked list, their pairs in a heap."""
        if not self.v.pairs:
            self.v.pairs = dict(zip(self.v.keys.tolist(), zip(self.v.ranks.tolist(), self.v.merged.tolist())))
        pairs = self.v.pairs
        ids = [self.v.byte_ids[b] for b in word]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []
        for i in range(n - 1):
            found = pairs.get(ids[i] << 20 | ids[i + 1])
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            if not alive[i] or ids[i] != left or (j := after[i]) >= n or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = merged, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (found := pairs.get(ids[a] << 20 | ids[b])):
                    heapq.heappush(heap, (found[0], a, ids[a], ids[b], found[1]))
        return np.array([x for x, ok in zip(ids, alive) if ok], "<i4").tobytes()

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            by_width.setdefault(next((k for k in (4, 8, 12, 16, 24, SHORT) if len(w) <= k), 0), []).append(i)
        for width, which in by_width.items():
            merged = self._merge_short([raw[i] for i in which]) if width else [self._merge_long(raw[i]) for i in which]
            for i, ids in zip(which, merged):
                self.cache[words[i]] = ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces = [self._pieces(t) if t else [] for t in texts]
        out = []
        for group in _groups(pieces, 200_000):
            used = {w for words in group for w in words if isinstance(w, str)}
            new = used - self.cache.keys()
            if len(self.cache) + len(new) > self.cache_words:
                self.older, self.cache = self.cache, {}
                new = used
            known = {w: self.older[w] for w in new if w in self.older}
            self.cache.update(known)
            new = new - known.keys()
            if new:
                self._learn(list(new))
            get = self.cache.__getitem__
            for words in group:
                joined = b"".join(map(get, words)) if words.__class__ is list else b"".join(w if isinstance(w, bytes) else get(w) for w in words)
                out.append(np.frombuffer(joined, "<i4"))
        return out

    def _pieces(self, text: str):
        """The words of a text; a tuple, with the ids of special tokens as bytes among the words, where it has any."""
        if self.special is None or not self.special.search(text):
            return split_words(text)
        found, at = [], 0
        for m in self.special.finditer(text):
            found += split_words(text[at : m.start()])
            found.append(np.array([self.v.specials[m[0]]], "<i4").tobytes())
            at = m.end()
        return (*found, *split_words(text[at:]))


def _groups(pieces: list, limit: int) -> Iterator[list]:
    """Consecutive texts with about `limit` words together."""
    group, n = [], 0
    for words in pieces:
        if group and n + len(words) > limit:
            yield group
            group, n = [], 0
        group.append(words)
        n += len(words)
    if group:
        yield group


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    return b"".join(map(vocabulary.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def share(spark: SparkSession, vocab_path: str):
    """The vocabulary, read by the driver and sent once to each executor; its size is checked."""
    return spark.sparkContext.broadcast(Vocabulary.read(vocab_path))


_encoders: dict[int, Encoder] = {}


def task_encoder(shared) -> Encoder:
    """One encoder, with its cache, for all tasks that a worker process runs after each other."""
    v = shared.value
    if id(v) not in _encoders:
        _encoders.clear()
        _encoders[id(v)] = Encoder(v)
    return _encoders[id(v)]


def list_array(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))


def encode(docs: DataFrame, vocab_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) for each document."""
    arrow_batches(docs.sparkSession)
    shared = share(docs.sparkSession, vocab_path)
    slim = docs.select(F.col(id), text_or_empty(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(encoder.encode(part.column(1).to_pylist()))], names=[id, "ids"])

    return slim.mapInArrow(run, f"`{id}` {slim.schema[0].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, vocab_path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) for each row of ids; null ids give an empty text."""
    shared = share(encoded.sparkSession, vocab_path)
    slim = encoded.select(F.col(id), F.coalesce(F.col(ids), F.expr("cast(array() as array<int>)")).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            texts = [decode(shared.value, column[i].values.to_numpy()) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id, "text"])

    return slim.mapInArrow(run, f"`{id}` {slim.schema[0].dataType.simpleString()}, text string")


def add_ids(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """The documents, columns as they were, and two columns more: the ids and their number. Every row's ids are decoded and
    compared with its text; a difference raises. A null text stays null and has no ids. Where the table has a column of
    the name `ids` or `n_tokens`, the new one's name gets underscores behind it."""
    arrow_batches(docs.sparkSession)
    shared = share(docs.sparkSession, vocab_path)
    names = docs.columns
    at = names.index(text)
    coded = docs.select([F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(shared)
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                texts = part.column(at).to_pylist()
                found = encoder.encode(texts)
                for value, own in zip(texts, found):
                    if decode(encoder.v, own) != (value or ""):
                        raise ValueError(f"ids do not decode to their text: {value[:80]!r}")
                yield pa.RecordBatch.from_arrays([*part.columns, list_array(found), pa.array([len(x) for x in found], pa.int64())], names=[*part.schema.names, "ids", "n_tokens"])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    more = free_names(names, ids, n_tokens)
    return coded.mapInArrow(run, f"{schema}, ids array<int>, n_tokens long").toDF(*names, *more)


def round_trip(docs: DataFrame, vocab_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_text, decoded): the ids in decimal, joined by commas, and the text that they decode to."""
    arrow_batches(docs.sparkSession)
    shared = share(docs.sparkSession, vocab_path)
    slim = docs.select(F.col(id), text_or_empty(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(shared)
        decimal = [str(i) for i in range(len(encoder.v.tokens))].__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids = encoder.encode(part.column(1).to_pylist())
                columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([",".join(map(decimal, x.tolist())) for x in ids], pa.string()), pa.array([decode(encoder.v, x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id, "n_tokens", "ids_text", "decoded"])

    return slim.mapInArrow(run, f"`{id}` {slim.schema[0].dataType.simpleString()}, n_tokens long, ids_text string, decoded string")
