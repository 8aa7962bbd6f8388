"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a DataFrame expression over the words and lines of a text; a rule is a row of the
table (name, numerator, denominator, least, most). `compile_rules` turns the table into columns, so a
scan with its projection is the whole job: no shuffle and no user function.

Words are runs of characters other than blank and 0x09-0x0D; lines are cut at line feeds.

Defined cases: a null or empty text has no words, all its counts are 0, and it fails the base rule;
each row is judged alone, so ties and repeated rows do not matter; other columns are kept, and a column
of the name `into` is replaced by `measure` and `judge`, kept by `filter_documents`. The stop words are
those of four languages: prose in another language fails the rule `stop_words`, so give such a corpus
a table of its own. Repeated windows are found by 64-bit hashes of their
words within one text; a text of any length is measured whole, in one task; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names, text_or_empty

#: Words of a window that counts as repeated when it is found again in the text.
WINDOW = 8
#: Frequent short words of English, French, Spanish and German.
STOP_WORDS = (
    "the and of to in is for that with on by are this was it as at be or from "
    "de la le les et des en un une du dans que qui pour est par sur au pas ne "
    "el los las y del se con una por no su al lo es "
    "der die das und von zu den mit ist im ein eine nicht auf dem sich für des auch"
).split()


@dataclass(frozen=True)
class Rule:
    """least <= numerator / denominator <= most, both optional; a denominator of 0 fails no ratio."""

    name: str
    numerator: str
    denominator: str | None = None
    least: float | None = None
    most: float | None = None

    def passes(self, measure: Callable[[str], Column]) -> Column:
        top, base = measure(self.numerator), measure(self.denominator) if self.denominator else F.lit(1)
        ok = F.lit(True)
        if self.least is not None:
            ok = ok & (top >= F.lit(self.least) * base)
        if self.most is not None:
            ok = ok & (top <= F.lit(self.most) * base)
        return ok


#: Production thresholds. They are wide: a rule is there to reject junk, not unusual prose.
RULES = (
    Rule("words", "n_words", least=20),
    Rule("mean_word_length", "word_chars", "n_words", least=2.0, most=20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.3),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("alphabetic_words", "n_letter_words", "n_words", least=0.5),
)

_SPLIT = "[ \\t-\\r]+"


def _counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words),
        "word_chars": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike("\\p{L}"))),
    }


def _window_keys(words: str, window: int) -> Column:
    """A hash for each window of a text; none where there is one window or none."""
    n = f"size({words})"
    return F.expr(f"CASE WHEN {n} <= {window} THEN array() ELSE transform(array(transform({words}, w -> xxhash64(w))), h -> transform(sequence(1, size(h) - {window - 1}), i -> xxhash64(slice(h, i, {window}))))[0] END")


def _covered(keys: str, window: int) -> Column:
    """Words covered by windows whose key is found twice or more. Only where a key repeats are the keys sorted with
    their places; the places of equal neighbours, in order, cover their words up to the next place."""
    pairs = f"array_sort(transform({keys}, (k, i) -> struct(k AS k, i AS i)))"
    twice = "(j > 0 AND s[greatest(j - 1, 0)].k = p.k) OR (j + 1 < size(s) AND s[least(j + 1, size(s) - 1)].k = p.k)"
    places = f"transform(array({pairs}), s -> array_sort(transform(filter(transform(s, (p, j) -> struct(p.i AS i, {twice} AS twice)), q -> q.twice), q -> q.i)))[0]"
    steps = f"transform(s, (p, j) -> CASE WHEN j + 1 < size(s) THEN least({window}, s[least(j + 1, size(s) - 1)] - p) ELSE {window} END)"
    return F.expr(f"CASE WHEN size({keys}) = size(array_distinct({keys})) THEN 0 ELSE transform(array({places}), s -> aggregate({steps}, 0, (a, x) -> a + x))[0] END")


def measure(docs: DataFrame, text: str = "text", window: int = WINDOW, into: str = "_quality") -> DataFrame:
    """The documents with one more column `into` (instead of one of that name), a struct of all measures.

    The steps are projections over one row each; Spark runs them with the scan.
    """
    names = [c for c in docs.columns if c != into]
    own = [f"c{i}" for i in range(len(names))]
    step = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, own)], text_or_empty(f"`{text}`").alias("t"))
    step = step.select(*own, "t", F.filter(F.split("t", _SPLIT), lambda w: w != "").alias("words"), F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"))
    counts = _counts(F.col("t"), F.col("words"), F.col("lines"))
    step = step.select(*own, *[c.cast("long").alias(f"m_{k}") for k, c in counts.items()], _window_keys("words", window).alias("keys"))
    step = step.select(*own, *[f"m_{k}" for k in counts], _covered("keys", window).cast("long").alias("m_n_repeat_words"))
    struct = F.struct(*[F.col(f"m_{k}").alias(k) for k in (*counts, "n_repeat_words")])
    return step.select(*[F.col(c).alias(n) for n, c in zip(names, own)], struct.alias(into))


def base_failed(m: str = "_quality") -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    return (F.col(f"{m}.n_words") < 20) | (F.col(f"{m}.n_repeat_words") * 100 > F.col(f"{m}.n_words") * 30)


def compile_rules(rules: tuple[Rule, ...] = RULES, m: str = "_quality") -> tuple[Column, Column]:
    """(all rules hold, names of the rules that fail) as columns over the measures."""
    passes = [(r.name, r.passes(lambda name: F.col(f"{m}.{name}"))) for r in rules]
    ok = F.lit(True)
    for _, p in passes:
        ok = ok & p
    return ok, F.array_compact(F.array(*[F.when(~p, F.lit(n)) for n, p in passes]))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "_quality") -> DataFrame:
    """The documents with the struct `into`: all measures, base_failed, kept and the names of the failed rules."""
    measured = measure(docs, text, into=into)
    ok, failed = compile_rules(rules, into)
    base = base_failed(into)
    return measured.withColumn(into, F.col(into).withField("base_failed", base).withField("kept", ~base & ok).withField("failed_rules", failed))


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the base rule and all rules keep, with their columns as they were.

    The verdict stands in an array of one, which `explode` opens: a filter is not pushed through it, so that no
    measure is computed again in the filter.
    """
    (into,) = free_names(docs.columns, "_quality")
    names = [f"c{i}" for i in range(len(docs.columns))]
    judged = judge(docs, text, rules, into).toDF(*names, "verdict")
    opened = judged.select(*names, F.explode(F.array("verdict.kept")).alias("kept"))
    return opened.where("kept").select(*names).toDF(*docs.columns)
