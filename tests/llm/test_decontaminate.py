import random
import re

from siltworks.llm.decontaminate import SuffixAutomaton, find, remove_spans, words_of


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    words, hit, found = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if own else []:
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(name)
    return len(words), len(hit), sorted(found)


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = lambda n: " ".join(rng.choice("abc") for _ in range(rng.randrange(n)))
        items = [(str(i), text(9)) for i in range(4)]
        automaton = SuffixAutomaton([(n, words_of(t)) for n, t in items], 4)
        doc = text(30)
        spans, found, _ = automaton.scan(words_of(doc))
        assert (len(words_of(doc)), sum(b - a for a, b in spans), sorted(found)) == brute(doc, items, 4)


def test_find_on_documents(spark, docs, rows):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plain = [(str(r.item_id), r.text) for r in items.collect()]
    short = [("900", "Two three"), ("901", None), ("902", "")]
    items = items.union(spark.createDataFrame([(int(a), b) for a, b in short], "item_id long, text string"))
    texts = dict(rows)
    want = {}
    for doc_id, text in texts.items():
        joined = " " + " ".join(plain_words(text)) + " "
        near = [(n, t) for n, t in plain + short if t and any(f" {' '.join(plain_words(t)[i : i + 10])} " in joined for i in range(max(1, len(plain_words(t)) - 9)))]
        want[doc_id] = brute(text, near, 10)
    for shard_words in (10**6, 700):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in find(docs, items, shard_words=shard_words).collect()}
        assert got == want
    assert any(w[1] for w in want.values())


def test_remove_spans(spark, none):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Keep this. Alpha, beta; gamma delta! And this is all kept here.", 5), (2, "alpha beta gamma delta", 5), (3, None, 5)], "doc_id long, text string, start int")
    kept = {r.doc_id: r.text for r in remove_spans(docs, items, window=3).collect()}
    assert kept == {1: "Keep this. ! And this is all kept here.", 3: None}
    assert remove_spans(docs, items.limit(0)).count() == 3
    assert remove_spans(none, items).count() == 0
    assert find(none, items).count() == 0


def test_item_without_id(spark):
    items = spark.createDataFrame([(None, "alpha beta gamma delta"), (None, "short one"), (7, "beta gamma delta alpha")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Keep this. Alpha, beta; gamma delta! And a short one here, all kept here.")], "doc_id long, text string")
    for shard_words in (10**6, 4):
        found = find(docs, items, window=3, shard_words=shard_words).first()
        assert (found.n_hit, found["items"]) == (6, ["7"])
        assert remove_spans(docs, items, window=3, shard_words=shard_words).first().text == "Keep this. ! And a  here, all kept here."


def test_repeated_items_are_taken_once(spark):
    from siltworks.llm import decontaminate

    items = spark.createDataFrame([(1, "alpha beta gamma delta")] * 500 + [(2, "one two three four")], "item_id long, text string")
    parts = decontaminate._parts(items, "item_id", "text", 6)
    assert len(parts) == 2 and sum(p.count() for p in parts) == 2
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta y one two three four")], "doc_id long, text string")
    assert find(docs, items, window=3, shard_words=6).first()["items"] == ["1", "2"]
