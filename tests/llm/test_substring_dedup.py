import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltworks.llm.sketch import Sketch
from siltworks.llm.substring_dedup import dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, words in texts:
        if i is not None:
            for j in range(len(words) - window + 1):
                key = tuple(words[j : j + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, words in texts:
        gone = set()
        if i is not None:
            for j in range(len(words) - window + 1):
                if first[tuple(words[j : j + window])] < i:
                    gone |= set(range(j, j + window))
        out[i, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)] += 1
    return out


def found(frame, **how):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup(frame, **how).collect())


def test_documents_against_brute_force(docs, rows):
    want = brute(rows, 50)
    assert sum(n > 0 for _, _, n, _ in want) > 3
    assert found(docs) == want


def test_passages_within_passages(spark, none):
    rng = random.Random(8)
    words = [f"w{i}é" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(4, 40))] for _ in range(12)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p[a : rng.randrange(a, len(p)) + 1] + [rng.choice(words) for _ in range(rng.randrange(3))]
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice([" ", "\n", "\t "]).join(text)))
    rows += rows[:10]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for window, gram in ((6, 3), (9, 10), (2, 1), (15, 4)):
        assert found(frame, window=window, gram=gram) == brute(rows, window)
    assert dedup(none).count() == 0


def test_sketch_too_wide_to_broadcast(docs, rows, monkeypatch):
    """The same result, with the sketch dealt over the executors; and the filter still filters."""
    from siltworks.llm import sketch as sk

    monkeypatch.setattr(sk, "MAX_WIDTH", 1)
    monkeypatch.setattr("siltworks.llm.substring_dedup.width_for", lambda keys: 4 * sk.BLOCK)
    seen = []
    deal = sk.dealt

    def dealt(rows, *how):
        out = deal(rows, *how)
        seen.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(sk, "dealt", dealt)
    assert found(docs) == brute(rows, 50)
    assert seen and all(0 < kept < 0.9 * n for n, kept in seen), seen


def test_one_passage_in_most_documents_is_no_slot_of_its_own(spark, monkeypatch):
    """With a wide sketch, each least hash is dealt to its slot once, so no task gets most rows."""
    from siltworks.llm import sketch as sk

    monkeypatch.setattr(sk, "MAX_WIDTH", 1)
    monkeypatch.setattr("siltworks.llm.substring_dedup.width_for", lambda keys: 4 * sk.BLOCK)
    seen = []
    deal = sk.dealt

    def dealt(rows, *how):
        seen.append(rows.agg(F.count("*").alias("rows"), F.count_distinct("m").alias("keys"), F.sum("n_rows").alias("n"), F.max("n_rows").alias("most")).first())
        return deal(rows, *how)

    monkeypatch.setattr(sk, "dealt", dealt)
    passage = " ".join(f"w{i}" for i in range(80))
    data = [(i, (passage if i % 10 else "") + " " + " ".join(f"x{i}y{k}" for k in range(70))) for i in range(300)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    assert found(frame) == brute(data, 50)
    assert seen[0].rows == seen[0]["keys"] and seen[0].most >= 250 and seen[0].n > 1.5 * seen[0].rows


def test_text_ids(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([("b", passage), ("a", passage), (None, passage)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in dedup(frame).collect()} == {"a": 0, "b": 60, None: 0}


def test_estimates_are_never_too_low(spark):
    from siltworks.llm.sketch import BLOCK, BLOCK_SCHEMA, Counting

    keys = np.random.default_rng(0).integers(0, 50_000, 200_000).astype(np.uint64)
    frame = spark.createDataFrame([(int(k),) for k in keys[:20_000]], "k long").repartition(5)

    def count(batches):
        c = Counting(BLOCK)
        for b in batches:
            c.add(b.column(0).to_numpy().astype(np.uint64))
        yield from c.blocks()

    sketch = Sketch.gathered(frame.mapInArrow(count, BLOCK_SCHEMA), BLOCK)
    values, counts = np.unique(keys[:20_000], return_counts=True)
    assert (sketch.estimate(values) >= np.minimum(counts, 255)).all()
    assert (sketch.estimate(values) == counts).mean() > 0.9


def test_hot_groups_are_joined_apart(spark, monkeypatch, tmp_path):
    from siltworks.llm import shared

    rng = random.Random(4)
    data = [(rng.choice(["hot"] * 5 + [f"k{rng.randrange(9)}"]), i) for i in range(400)]
    spark.createDataFrame(data, "k string, v int").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n_rows").selectExpr("k", "n_rows", "length(k) AS g").where("k <> 'k3'")
    want = sorted((k, v, len(k)) for k, v in data if k != "k3")
    for most in (1, 4, 2000):
        monkeypatch.setattr(shared, "HOT_KEYS", most)
        assert sorted(map(tuple, shared.join_groups(rows, groups, ["k"]).select("k", "v", "g").collect())) == want
