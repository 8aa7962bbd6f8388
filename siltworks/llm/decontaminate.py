"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the normalised test items. Each document's words are
streamed through it; the length of the longest match that ends at a word says which windows of
test items end there, and the hit words follow. Spans are removed, and documents dropped, by
limits on the span's length and on the share of a document that is hit.

Words: A-Z lower-cased, then runs of digits, a-z and characters above 0x7F. A window is `window`
consecutive words of an item; an item of fewer words, but not none, is one window.

Defined cases: a null or empty text has no words and no hits; an item without words is never
found; one with a null id is hit and cut, but not in lists of items; repeated items are all found;
an empty table of items leaves documents as they are; repeated documents are each judged; a text of any length is streamed whole,
one in memory at a time; columns besides id and text are kept as they are by `remove_spans` and ignored by `find`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches, fresh_path, stored, text_or_empty

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of test items in one automaton; more items are dealt to several, one pass over the documents for each.
SHARD_WORDS = 300_000

FOUND = "n_words long, n_hit long, longest long, items array<string>, word_spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode().lower()) if text else []


class SuffixAutomaton:
    """All runs of words of several items, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]) for name, words in items if words]
        for _, word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        #: For a state that holds runs of `window` words, the items that have them.
        self.items: list[set[str]] = [set() for _ in self.next]
        #: For a state, whole short items that are runs of it or end every run of it: (words, item).
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for name, word_ids in coded:
            state = 0
            for w in word_ids:
                state = self.next[state][w]
                at = self._window_state(state)
                if at:
                    self.items[at].add(name)
            if len(word_ids) < window:
                self.short[state].append((len(word_ids), name))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.short[self.link[state]]
            if above:
                self.short[state] = self.short[state] + above

    def _extend(self, last: int, w: int) -> int:
        """Adds one word after the run of state `last`; a run that is there already is used again."""
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at != -1:
            below = self.next[at][w]
            self.link[new] = below if self.length[below] == self.length[at] + 1 else self._split(at, w, below)
        return new

    def _split(self, at: int, w: int, below: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[below]), self.link[below])
        self.link[below] = copy
        while at != -1 and self.next[at].get(w) == below:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _window_state(self, state: int) -> int:
        """The state among a run's endings that holds its last `window` words; 0 if it is shorter."""
        if self.length[state] < self.window:
            return 0
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit words as merged intervals, the items found, and the length of the longest match."""
        window, nexts, links, lengths, shorts = self.window, self.next, self.link, self.length, self.short
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = matched = longest = 0
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                state = matched = 0
                continue
            following = nexts[state].get(w)
            while following is None and state:
                state = links[state]
                matched = lengths[state]
                following = nexts[state].get(w)
            if following is None:
                continue
            state = following
            matched += 1
            if matched > longest:
                longest = matched
            if matched >= window or shorts[state]:
                cover = 0
                if matched >= window:
                    cover = window
                    found |= self.items[self._window_state(state)]
                for n, name in shorts[state]:
                    if n <= matched:
                        found.add(name)
                        cover = max(cover, n)
                if cover:
                    begin = i + 1 - cover
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i + 1))
        return spans, found, longest


def _parts(items: DataFrame, item_id: str, text: str, shard_words: int) -> list[DataFrame]:
    """The items in parts of about `shard_words` words: few items in one, more in as many as are needed."""
    # an item without id is hit and cut as any other; only lists of items leave it out
    rows = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    n = max(1, -(-int(total) // shard_words))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k) for k in range(n)]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


_MATCH = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.string())), ("word_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _match(n_words: int, spans: list[tuple[int, int]], items: set[str], longest: int) -> dict:
    return {"n_words": n_words, "n_hit": sum(e - b for b, e in spans), "longest": longest, "items": sorted(items - {None}), "word_spans": [{"start": b, "end": e} for b, e in spans]}


def _add_match(rows: DataFrame, keep: int, matches: Callable[[pa.RecordBatch], list[dict]]) -> DataFrame:
    """The first `keep` columns of the rows and a column `match`, a struct of FOUND."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(matches(batch), _MATCH)], names=[*batch.schema.names[:keep], "match"])

    kind = f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>"
    return rows.mapInArrow(add, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:keep]] + [f"match {kind}"]))


def _scanned(rows: DataFrame, keep: int, at: int, shared: Broadcast) -> DataFrame:
    """The first `keep` columns and the matches of the texts, column number `at`, with one automaton."""

    def matches(batch: pa.RecordBatch) -> list[dict]:
        automaton, out = shared.value, []
        for value in batch.column(at).to_pylist():
            words = words_of(value)
            spans, items, longest = automaton.scan(words)
            out.append(_match(len(words), spans, items, longest))
        return out

    return _add_match(rows, keep, matches)


def _with_matches(docs: DataFrame, keep: int, items: DataFrame, item_id: str, item_text: str, text: str, window: int, shard_words: int) -> DataFrame:
    """The first `keep` columns of the documents, which are c0, c1, ..., with a column `match`, a struct of FOUND.

    With several automata the documents are written once with a number for each row; each pass reads the texts and writes row numbers
    and matches only, and the matches of all passes meet their document at the end.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    parts = _parts(items, item_id, item_text, shard_words)
    width, at = len(docs.columns), docs.columns.index(text)

    def automaton(part: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(SuffixAutomaton([(r.name, words_of(r.text)) for r in part.toLocalIterator()], window))

    if len(parts) == 1:
        return _scanned(docs, keep, at, automaton(parts[0]))
    rows = stored(docs.withColumn("at_row", F.monotonically_increasing_id()), "decontaminate-rows")
    path = fresh_path(spark, "decontaminate-matches")
    for part in parts:
        shared = automaton(part)
        _scanned(rows.select("at_row", text), 1, 1, shared).where("match.longest > 0").write.mode("append").parquet(path)
        shared.destroy()
    passes = spark.read.schema(f"at_row long, match struct<{FOUND.replace(' ', ':').replace(',:', ',')}>").parquet(path)
    all_of = lambda field: F.flatten(F.collect_list(f"match.{field}"))
    both = rows.join(passes.groupBy("at_row").agg(F.max("match.longest").alias("longest"), all_of("items").alias("items"), all_of("word_spans").alias("spans")), "at_row", "left")

    def merged(batch: pa.RecordBatch) -> list[dict]:
        texts, longest, found, spans = (batch.column(i).to_pylist() for i in (at, width, width + 1, width + 2))
        return [_match(len(words_of(t)), _merge([(x["start"], x["end"]) for x in s or ()]), set(f or ()), n or 0) for t, n, f, s in zip(texts, longest, found, spans)]

    return _add_match(both.select(*docs.columns, "longest", "items", "spans"), keep, merged)


def find(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each document: its id, n_words, n_hit, longest match, the items found and the hit word spans."""
    slim = docs.select(F.col(id).alias("c0"), text_or_empty(text).alias("c1"))
    found = _with_matches(slim, 1, items, item_id, item_text, "c1", window, shard_words)
    return found.select(F.col("c0").alias(id), "match.*")


def cut(text: str, word_spans: list[dict], min_words: int) -> str:
    """The text without the spans of at least `min_words` words; what stands between the words of a span goes too."""
    spans = [s for s in word_spans if s["end"] - s["start"] >= min_words]
    if not spans:
        return text
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    kept.append(raw[at:])
    return b"".join(kept).decode()


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, min_words: int = 1, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents, columns as they were, with hit spans of at least `min_words` words cut out of the text.

    A document of which more than `max_coverage` of the words are hit is dropped. Null texts stay null.
    """
    names = docs.columns
    at = names.index(text)
    coded = docs.select([F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    found = _with_matches(coded, len(names), items, item_id, item_text, f"c{at}", window, shard_words)
    found = found.where(F.col("match.n_hit") <= F.lit(max_coverage) * F.col("match.n_words"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names)).field("word_spans").to_pylist()
            texts = batch.column(at)
            if any(spans):
                texts = pa.array([cut(t, s, min_words) if t and s else t for t, s in zip(texts.to_pylist(), spans)], texts.type)
            columns = batch.columns[: len(names)]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(names)])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return found.mapInArrow(rewrite, schema).toDF(*names)
