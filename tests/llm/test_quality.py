import re
from collections import Counter

from siltworks.llm.quality import RULES, Rule, filter_documents, judge

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_documents_against_brute_force(docs, rows):
    got = judge(docs)
    assert got.columns == [*docs.columns, "_quality"]
    have = Counter((r.doc_id, q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) for r in got.collect() for q in [r._quality])
    assert have == Counter((i, *brute(t)) for i, t in rows)
    assert all(not r._quality.kept or not (r._quality.base_failed or r._quality.failed_rules) for r in got.collect())


def test_windows_next_to_each_other(spark):
    texts = [" ".join("abcdefgh" * 2), " ".join("abcdefghi" * 2 + "abcdefgh"), "x " * 40, "a b c d e f g h", "a b c d e f g h " * 3 + "q r s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r._quality.n_repeat_words for r in judge(docs).collect()} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_filter(spark, docs, none):
    kept = filter_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    strict = filter_documents(docs, rules=(*RULES, Rule("none", "n_words", least=10**9)))
    assert strict.count() == 0 and filter_documents(none).count() == 0


def test_plan_has_no_user_function(docs):
    plan = judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_very_long_clean_text(spark):
    text = " ".join(f"the word{i} of" for i in range(340_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    q = judge(docs).first()._quality
    assert (q.n_words, q.kept, q.failed_rules) == (1_020_000, True, [])


def test_clashing_name_is_kept(spark):
    text = " ".join(f"the word{i} of" for i in range(30))
    docs = spark.createDataFrame([(1, text, "own"), (2, "junk", "own")], "doc_id long, text string, _quality string")
    kept = filter_documents(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, "own")]


def test_stop_words_are_a_ratio(spark):
    text = "the of " + " ".join(f"word{i}" for i in range(400))
    q = judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()._quality
    assert q.failed_rules == ["stop_words"]
