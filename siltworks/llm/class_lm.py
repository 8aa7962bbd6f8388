"""Brown class-based bigram scoring: P(w | previous) = P(class(w) | class(previous)) * P(w | class(w)).

All training documents are counted. The exchange has two steps:

1. Units are the `n_units` most frequent words, each alone, and all other words by a hash of their last letters in
   `n_endings` groups. Unit bigrams are counted over the whole corpus by the executors; their table has at most
   (n_units + n_endings + 1)**2 cells. Units move, one after the other, to the class that raises the likelihood of the
   class bigrams most, until few move.
2. Every other word among the `n_known` most frequent leaves its ending's group: Spark counts the classes before and
   behind each, over the whole corpus, and each word moves, in tasks, to its own best class by the same gain against
   the table of class bigrams. Class bigrams are then counted again.

Words beyond `n_known`, and unknown ones, keep their ending's class; README gives their share of the tokens.

Emission: P(w | c) = (count(w) + 1) / (N_c + V_c + 1), with one more place for all words of the class that
training lacks. Transition: (n(a, b) + k * P(b)) / (n(a) + k), P(b) = (n(b) + 1) / (n + classes).

Word counts meet the texts in two ways. The counts of the most frequent `n_known` words are sent to
the executors, a fixed number. All other words of a document go as (document, word hash, times) into a
join with the whole count table, grouped by document afterwards.

A document is its words, A-Z lower-cased, then one end token; before the first word stands an end.
Words are told apart by 128 bits of hash.

Defined cases: a null or empty text is the end token alone; a null id counts as the text '' when
documents are split; rows with the same id are documents of their own; a text of any length is
scored whole; other columns are ignored; an
empty table gives an empty result; without training documents every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import WORD_BYTES, span_hashes, signed, text_chunks, word_spans
from .shared import arrow_batches, stored, text_or_empty

N_UNITS = 1200
N_ENDINGS = 300
N_CLASSES = 48
#: Words whose counts are sent to the executors: 24 bytes each.
N_KNOWN = 500_000
#: Weight of the class unigram in transitions.
SMOOTHING = 20.0
SWEEPS = 6

#: The end token's hashes.
END = (np.uint64(1), np.uint64(1))


def held_out(id: str, folds: int = 7, fold: int = 2):
    """crc32 of the id as text, modulo `folds`, is `fold`: such documents are not trained on."""
    return (F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds) == fold


class Tokens:
    """The tokens of a chunk of texts: for each, two hashes, its ending's group, and its row; ends included, in order."""

    def __init__(self, chunk, n_endings: int):
        starts, ends, offsets = word_spans(chunk, WORD_BYTES)
        n, rows = len(starts), chunk.rows
        per = np.diff(offsets)
        self.row = np.repeat(np.arange(rows), per + 1)
        self.end = np.cumsum(per + 1) - 1
        word = np.ones(n + rows, bool)
        word[self.end] = False
        self.h1 = np.full(n + rows, END[0], np.uint64)
        self.h2 = np.full(n + rows, END[1], np.uint64)
        self.h1[word] = span_hashes(chunk.data, starts, ends, 0, lower=True)
        self.h2[word] = span_hashes(chunk.data, starts, ends, 1, lower=True)
        self.ending = np.zeros(n + rows, np.int64)
        self.ending[word] = (span_hashes(chunk.data, np.maximum(starts, ends - 3), ends, 0, lower=True) % np.uint64(n_endings)).astype(np.int64)
        self.n = per + 1


def _unique_counts(h1: np.ndarray, h2: np.ndarray, weights: np.ndarray | None = None):
    """Sorted by the first hash; the few words that share it may come in several pieces, which Spark adds up."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(a))) if weights is None else np.add.reduceat(weights[order], at) if len(at) else at
    return a[at], b[at], counts, order[at]


def word_counts(docs: DataFrame, text: str = "text", n_endings: int = N_ENDINGS) -> DataFrame:
    """(h1, h2, ending, c): how often each token, ends included, is in `docs`."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        held = 0

        def out():
            parts = [np.concatenate(x) for x in zip(*waiting)]
            a, b, c, at = _unique_counts(parts[0], parts[1], parts[3])
            return pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b)), pa.array(parts[2][at].astype(np.int32)), pa.array(c.astype(np.int64))], names=["h1", "h2", "ending", "c"])

        for batch in batches:
            for chunk in text_chunks(batch.column(0)):
                t = Tokens(chunk, n_endings)
                a, b, c, at = _unique_counts(t.h1, t.h2)
                waiting.append((a, b, t.ending[at], c.astype(np.int64)))
                held += len(a)
                if held > 1_000_000:
                    yield out()
                    waiting, held = [], 0
        if waiting:
            yield out()

    parts = docs.select(text_or_empty(text).alias("t")).mapInArrow(run, "h1 long, h2 long, ending int, c long")
    return parts.groupBy("h1", "h2").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


@dataclass
class Lookup:
    """Sorted hashes of frequent words, with what is known of each."""

    h1: np.ndarray
    h2: np.ndarray
    counts: np.ndarray
    #: Unit of each, or -1 for its ending's.
    units: np.ndarray
    #: Class of each, or -1 while it is its unit's.
    classes: np.ndarray

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Index of each word, or -1."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, -1)


def _units(t: Tokens, known: np.ndarray, lookup: Lookup, n_units: int) -> np.ndarray:
    """Unit of each token: 0 for the end, then frequent words, then endings."""
    unit = 1 + n_units + t.ending
    alone = known >= 0
    alone[alone] = lookup.units[known[alone]] >= 0
    unit[alone] = lookup.units[known[alone]]
    unit[t.end] = 0
    return unit


def unit_bigrams(docs: DataFrame, shared, text: str, n_units: int, n_endings: int) -> np.ndarray:
    """The table of unit bigrams over all of `docs`, summed by Spark."""
    size = 1 + n_units + n_endings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for chunk in text_chunks(batch.column(0)):
                t = Tokens(chunk, n_endings)
                unit = _units(t, shared.value.find(t.h1, t.h2), shared.value, n_units)
                before = np.empty_like(unit)
                before[1:] = unit[:-1]
                before[0] = 0
                pairs, counts = np.unique(before * size + unit, return_counts=True)
                total[pairs] += counts
        there = np.flatnonzero(total)
        for a in range(0, len(there), 100_000):
            some = there[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    table = np.zeros(size * size)
    sums = docs.select(text_or_empty(text).alias("t")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for batch in sums.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table.reshape(size, size)


def exchange(table: np.ndarray, n_classes: int = N_CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each unit. Unit 0, the end, keeps class 0 for itself.

    Units start in classes by turns of their frequency. The gain of a move is the change of
    sum n(a, b) log n(a, b) - sum n(a) log n(a) - sum n(b) log n(b) over classes.
    """
    size = len(table)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    frequent = np.argsort(-table.sum(0)[1:], kind="stable") + 1
    classes = np.zeros(size, np.int64)
    classes[frequent] = 1 + np.arange(size - 1) % (n_classes - 1)
    member = np.zeros((size, n_classes))
    member[np.arange(size), classes] = 1
    to_class = table @ member  # unit -> class after it
    from_class = table.T @ member  # class before -> unit
    joint = member.T @ to_class
    left, right = joint.sum(1), joint.sum(0)
    ahead, behind, own = table.sum(1), table.sum(0), np.diag(table)
    for _ in range(sweeps):
        moved = 0
        for u in frequent.tolist():
            if not behind[u]:
                continue
            a = classes[u]
            # without the unit, in its old class
            out, into, self_ = to_class[u].copy(), from_class[u].copy(), own[u]
            out[a] -= self_
            into[a] -= self_
            base = joint.copy()
            base[a] -= out
            base[:, a] -= into
            base[a, a] -= self_
            l, r = left.copy(), right.copy()
            l[a] -= ahead[u]
            r[a] -= behind[u]
            # with it in each class b: row b gains `out`, column b gains `into`, and (b, b) gains both and the unit's own
            rows = f(base + out[None, :]).sum(1) - f(base).sum(1)
            columns = f(base + into[:, None]).sum(0) - f(base).sum(0)
            d = np.diag(base)
            corner = f(d + out + into + self_) - f(d + out) - f(d + into) + f(d)
            gain = rows + columns + corner - (f(l + ahead[u]) - f(l)) - (f(r + behind[u]) - f(r))
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if b != a and gain[b] > gain[a] + 1e-9:
                moved += 1
                classes[u] = b
                to_class[:, a] -= table[:, u]
                to_class[:, b] += table[:, u]
                from_class[:, a] -= table[u]
                from_class[:, b] += table[u]
                base[b] += out
                base[:, b] += into
                base[b, b] += self_
                joint = base
                left, right = l, r
                left[b] += ahead[u]
                right[b] += behind[u]
        if moved * 200 < size:
            break
    return classes


def _classes(t: Tokens, known: np.ndarray, lookup: Lookup, of_endings: np.ndarray) -> np.ndarray:
    """Class of each token: 0 for the end, its own for a known word, its ending's for another."""
    c = of_endings[t.ending]
    some = known >= 0
    c[some] = lookup.classes[known[some]]
    c[t.end] = 0
    return c


def _shifted(c: np.ndarray) -> np.ndarray:
    """What stands before each token; texts end with an end, which also stands before their first token."""
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[:1] = 0
    return before


def word_contexts(docs: DataFrame, shared, of_endings: np.ndarray, text: str, n_classes: int) -> DataFrame:
    """(at, n): for the words of the lookup that are no units, how often each class stands before one (column 0..), behind it
    (n_classes..), and the word itself before it (2 * n_classes); at = word * (2 * n_classes + 1) + column."""
    columns = 2 * n_classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held = 0

        def out():
            at, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])

        for batch in batches:
            for chunk in text_chunks(batch.column(0)):
                t = Tokens(chunk, len(of_endings))
                at = shared.value.find(t.h1, t.h2)
                c = _classes(t, at, shared.value, of_endings)
                own = at >= 0
                own[own] = shared.value.units[at[own]] < 0
                own[t.end] = False
                some = np.flatnonzero(own)  # never a text's last token, which is an end
                word = at[some] * columns
                again = some[(some > 0) & (at[some] == at[some - 1]) & own[some - 1]]
                waiting += [word + _shifted(c)[some], word + n_classes + c[some + 1], at[again] * columns + 2 * n_classes]
                held += 2 * len(some)
                if held > 2_000_000:
                    yield out()
                    waiting, held = [], 0
        if held:
            yield out()

    return docs.select(text_or_empty(text).alias("t")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


def best_classes(into: np.ndarray, out: np.ndarray, self_: np.ndarray, own: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The best class of each word, all others staying: `into` and `out` (words x classes) count the classes before and behind
    it, `self_` itself before it, `own` is its class now, and `joint` the class bigrams."""
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    best = own.copy()
    left, right = joint.sum(1), joint.sum(0)
    for w in range(len(own)):
        a, i, o, s = own[w], into[w].astype(float), out[w].astype(float), float(self_[w])
        o_all, i_all = o.sum(), i.sum()
        o[a] -= s
        i[a] -= s
        base = joint.copy()
        base[a] -= o
        base[:, a] -= i
        base[a, a] -= s
        l, r = left.copy(), right.copy()
        l[a] -= o_all
        r[a] -= i_all
        # only classes that the word meets change their cells
        after, before = np.flatnonzero(o), np.flatnonzero(i)
        rows = (f(base[:, after] + o[after]) - f(base[:, after])).sum(1)
        columns = (f(base[before] + i[before, None]) - f(base[before])).sum(0)
        d = np.diag(base)
        corner = f(d + o + i + s) - f(d + o) - f(d + i) + f(d)
        gain = rows + columns + corner - (f(l + o_all) - f(l)) - (f(r + i_all) - f(r))
        gain[0] = -np.inf
        b = int(np.argmax(gain))
        if gain[b] > gain[a] + 1e-9:
            best[w] = b
    return best


def exchange_words(contexts: DataFrame, lookup: Lookup, joint: np.ndarray, n_classes: int) -> np.ndarray:
    """The classes of the lookup's words after each that is no unit has moved to its own best class."""
    columns = 2 * n_classes + 1
    shared = contexts.sparkSession.sparkContext.broadcast((lookup.classes, joint))

    def move(part: pa.Table) -> pa.Table:
        at, n = part.column("at").to_numpy(), part.column("n").to_numpy()
        words, row = np.unique(at // columns, return_inverse=True)
        table = np.zeros((len(words), columns))
        table[row, at % columns] = n
        classes, bigrams = shared.value
        best = best_classes(table[:, :n_classes], table[:, n_classes : 2 * n_classes], table[:, -1], classes[words], bigrams)
        return pa.table({"word": words, "class": best.astype(np.int32)})

    moved = contexts.groupBy(F.floor(F.col("at") / (columns * 500)).alias("part")).applyInArrow(lambda part: move(part), "word long, class int").toArrow()
    classes = lookup.classes.copy()
    classes[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
    return classes


def class_bigrams(docs: DataFrame, shared, of_endings: np.ndarray, text: str, n_classes: int) -> np.ndarray:
    """The table of class bigrams over all of `docs`, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes * n_classes, np.int64)
        for batch in batches:
            for chunk in text_chunks(batch.column(0)):
                t = Tokens(chunk, len(of_endings))
                c = _classes(t, shared.value.find(t.h1, t.h2), shared.value, of_endings)
                total += np.bincount(_shifted(c) * n_classes + c, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["pair", "n"])

    table = np.zeros(n_classes * n_classes)
    sums = docs.select(text_or_empty(text).alias("t")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    return table.reshape(n_classes, n_classes)


@dataclass
class Model:
    """What scoring needs: frequent words with their classes, the class of each ending, and log10 tables."""

    lookup: Lookup
    of_endings: np.ndarray
    transition: np.ndarray
    #: log10 of the denominator of emissions in each class.
    emission_base: np.ndarray
    train_tokens: int
    vocabulary: int
    #: Tokens of the words that have a class of their own, the ends included.
    own_tokens: int


def train(counts: DataFrame, docs: DataFrame, text: str = "text", n_units: int = N_UNITS, n_endings: int = N_ENDINGS, n_classes: int = N_CLASSES, n_known: int = N_KNOWN) -> Model:
    """`counts` is the stored table of word_counts(docs)."""
    spark = docs.sparkSession
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    end = (F.col("h1") == int(END[0])) & (F.col("h2") == int(END[1]))
    # the most frequent words, at most n_known: those above a count that a histogram gives
    bucket = F.floor(F.log2(F.col("c").cast("double")) * 16)
    least, held = None, 0
    for r in counts.where(~end).groupBy(bucket.alias("b")).count().orderBy(F.desc("b")).collect():
        held += r["count"]
        if held > n_known:
            break
        least = r.b
    top = counts.where(~end & ((bucket >= least) if least is not None else F.lit(False))).toArrow()
    top = top.sort_by([("c", "descending"), ("h1", "ascending"), ("h2", "ascending")])
    h1, h2 = (top.column(k).to_numpy().astype(np.int64).view(np.uint64) for k in ("h1", "h2"))
    units = np.full(len(h1), -1, np.int64)
    units[:n_units] = 1 + np.arange(min(n_units, len(h1)))
    order = np.lexsort((h2, h1))
    lookup = Lookup(h1[order], h2[order], top.column("c").to_numpy()[order], units[order], np.full(len(h1), -1, np.int64))
    table = unit_bigrams(docs, spark.sparkContext.broadcast(lookup), text, n_units, n_endings)
    of_units = exchange(table, n_classes)
    of_endings = of_units[1 + n_units :].copy()
    ending = top.column("ending").to_numpy()[order]
    lookup.classes = np.where(lookup.units >= 0, of_units[lookup.units], of_endings[ending])
    if (lookup.units < 0).any():
        member = np.zeros((len(of_units), n_classes))
        member[np.arange(len(of_units)), of_units] = 1
        contexts = word_contexts(docs, spark.sparkContext.broadcast(lookup), of_endings, text, n_classes)
        lookup = replace(lookup, classes=exchange_words(contexts, lookup, member.T @ table @ member, n_classes))
    joint = class_bigrams(docs, spark.sparkContext.broadcast(lookup), of_endings, text, n_classes)
    unigram = (joint.sum(0) + 1) / (joint.sum() + n_classes)
    transition = np.log10((joint + SMOOTHING * unigram[None, :]) / (joint.sum(1, keepdims=True) + SMOOTHING))
    # words of each class: known ones by their own, all others by their ending
    distinct = np.bincount(lookup.classes, minlength=n_classes).astype(float)
    others = np.zeros(n_endings)
    for r in counts.where(~end).groupBy("ending").agg(F.count(F.lit(1)).alias("v")).collect():
        others[r.ending] = r.v
    others -= np.bincount(ending, minlength=n_endings)
    np.add.at(distinct, of_endings, others)
    distinct[0] = 1 if total.n else 0
    return Model(lookup, of_endings, transition, np.log10(joint.sum(0) + distinct + 1), int(total.n), int(total.v), int(lookup.counts.sum()) + int(joint[:, 0].sum()))


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, documents, tokens, perplexity) of the rows of `fit_and_score`: 10 to the mean of -log10 P of a token."""
    sums = scored.groupBy("held_out").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("score").alias("s"))
    return sums.select("held_out", "documents", "tokens", F.pow(F.lit(10.0), -F.col("s") / F.col("tokens")).alias("perplexity"))


def score(docs: DataFrame, model: Model, counts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for each row of `docs`."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    ends = counts.where((F.col("h1") == int(END[0])) & (F.col("h2") == int(END[1]))).first()
    n_ends = ends.c if ends else 0
    slim = docs.select(F.col(id).alias("id"), text_or_empty(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        row_key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                t = Tokens(chunk, len(m.of_endings))
                at = m.lookup.find(t.h1, t.h2)
                c = _classes(t, at, m.lookup, m.of_endings)
                before = _shifted(c)
                c_of = np.where(at >= 0, m.lookup.counts[at] if len(m.lookup.counts) else 0, 0)
                c_of[t.end] = n_ends
                common = at >= 0
                common[t.end] = True
                rows = chunk.rows
                classes = np.bincount(t.row, m.transition[before, c] - m.emission_base[c], rows)
                sums = np.bincount(t.row[common], np.log10(c_of[common] + 1.0), rows)
                known = np.bincount(t.row[common & (c_of > 0)], minlength=rows)
                # the other words, once for each document
                rare = np.flatnonzero(~common)
                order = rare[np.lexsort((t.h1[rare], t.row[rare]))]
                r, a, b = t.row[order], t.h1[order], t.h2[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(r)))
                bounds = np.searchsorted(r[first], np.arange(rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (signed(a[first]), signed(b[first]), times.astype(np.int32))]
                keys = row_key + np.arange(rows)
                row_key += rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, rows), pa.array(keys), pa.array(t.n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(sums), pa.array(classes), *lists],
                    names=["id", "k", "n_tokens", "known", "sums", "classes", "r1", "r2", "times"],
                )

    schema = f"id {slim.schema['id'].dataType.simpleString()}, k long, n_tokens long, known long, sums double, classes double, r1 array<long>, r2 array<long>, times array<int>"
    scored = stored(slim.mapInArrow(run, schema), "class-scores")
    rare = scored.where(F.size("r1") > 0).select("k", F.explode(F.arrays_zip("r1", "r2", "times")).alias("w"))
    rare = rare.select("k", F.col("w.r1").alias("h1"), F.col("w.r2").alias("h2"), "w.times")
    met = rare.join(counts.select("h1", "h2", "c"), ["h1", "h2"])
    more = met.groupBy("k").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("n_more"))
    both = scored.drop("r1", "r2", "times").join(more, "k", "left")
    sums = F.col("sums") + F.coalesce("more", F.lit(0.0))
    return both.select(
        F.col("id").alias(id),
        "n_tokens",
        (F.col("known") + F.coalesce("n_more", F.lit(0))).alias("n_known"),
        (sums - F.col("n_tokens") * F.log10(F.lit(float(model.train_tokens + model.vocabulary + 1)))).alias("base_score"),
        (sums + F.col("classes")).alias("score"),
    )


def fit_and_score(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, **how) -> DataFrame:
    """Scores all documents by a model of those that are not held out; adds held_out and train_tokens."""
    training = docs.where(~held_out(id, folds, fold))
    counts = stored(word_counts(training, text, how.get("n_endings", N_ENDINGS)), "word-counts")
    model = train(counts, training, text, **how)
    scored = score(docs, model, counts, id, text)
    return scored.withColumn("held_out", held_out(id, folds, fold)).withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))
