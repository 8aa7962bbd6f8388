import random

import numpy as np
import pytest
from siltworks.llm import minhash as mh
from siltworks.llm.components import components


def shingle_set(text, counts=True):
    """The shingles of a text; where they are counted, the n-th time of one is an element of its own."""
    words = (text or "").encode().split()
    seen, out = {}, set()
    for i in range(max(1, len(words) - 4) if words else 0):
        key = tuple(words[i : i + 5])
        seen[key] = seen.get(key, 0) + 1
        out.add((key, seen[key] if counts else 1))
    return frozenset(out)


def brute(rows, least=0.8, counts=True):
    rows = [(i, shingle_set(t, counts)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    blank = [i for i, s in rows if not s]
    for i in blank:
        parent[i] = min(blank)
    where = {}
    for j, (_, s) in enumerate(rows):
        for x in s:
            where.setdefault(x, []).append(j)
    pairs = {(a, b) for js in where.values() for n, b in enumerate(js) for a in js[:n]}
    for a, b in pairs:
        (i, s), (j, t) = rows[a], rows[b]
        n = len(s & t)
        if n >= least * (len(s) + len(t) - n):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: root(i) for i in parent}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for n, top in ((5, 1), (300, 1), (3000, 1), (40, 30), (300, 4)):
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        x, y = (rng.integers(0, top + 1, n).astype(float) * rng.choice([1, 0.37]) for _ in range(2))
        x[0] = y[0] = 1
        if top == 1:
            x = y = None
            x, y = (rng.random(n) < 0.9).astype(float), (rng.random(n) < 0.9).astype(float)
            x[0] = y[0] = 1
        want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        e = np.concatenate([h[x > 0], h[y > 0]])
        s = mh.dart_signatures(e, np.concatenate([x[x > 0], y[y > 0]]), np.repeat([0, 1], [(x > 0).sum(), (y > 0).sum()]), 2, 1024)
        assert abs((s[0] == s[1]).mean() - want) < 0.07, (n, top, want)
        assert len(np.unique(s[0])) > 0.9 * min(1024, n)


def test_documents_against_brute_force(docs, rows):
    got = {r.doc_id: r.class_id for r in mh.classes(docs).collect() if r.doc_id is not None}
    want = brute(rows)
    assert got == want
    assert len(set(want.values())) < len(want)
    kept = mh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.where("doc_id IS NULL").count() == 1


def test_families(spark, none):
    rng = random.Random(6)
    rows, i = [], 0
    for size, edits in ((60, 3), (60, 8), (30, 1), (2, 2), (40, 0)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(120, 250))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(text)))
            i += 1
    rows += [(7, "another text of the same id"), (5001, "another text of the same id"), (5002, "short"), (5003, "short"), (5004, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for weights in ("binary", "counts"):
        want = brute(rows, counts=weights == "counts")
        want[5001] = want[7]
        got = {r.doc_id: r.class_id for r in mh.classes(frame, weights=weights).collect()}
        assert sum(got[k] != want[k] for k in want) == 0
    assert mh.classes(none).count() == 0 and mh.keep_one(none).count() == 0


def test_counts_weigh(spark):
    """A line that is said once or four times: alike as sets, not when counted."""
    line = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, line), (2, " ".join([line] * 4))], "doc_id long, text string")
    for weights, same in (("binary", True), ("counts", False)):
        got = {r.doc_id: r.class_id for r in mh.classes(frame, weights=weights).collect()}
        assert (got[1] == got[2]) == same


def test_rows_of_one_id_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, "another text of this id " * 3), (2, text), (3, "alone in the world today"), (None, "x"), (None, "x")]
    names = ["gone", "nth", "_gone", "_nth", "class_id", "node", "key", "id"]
    frame = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = mh.keep_one(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == sorted([(1, text), (1, "another text of this id " * 3), (3, "alone in the world today"), (0, "x"), (0, "x")])
    assert all([r[n] for n in names] == names for r in rows)


def test_text_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([("a", text), ("b", text + " more"), ("c", "alone"), (None, "x")], "doc_id string, text string")
    got = {r.doc_id: r.class_id for r in mh.classes(frame).collect()}
    assert got["a"] == got["b"] in ("a", "b") and got["c"] == "c" and got[None] is None
    assert mh.keep_one(frame).count() == 3


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(mh, "HOT", 3)
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (3, 1)], "k long, o long")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k long, v string")
    got = sorted((r.k, r.o, r.v) for r in mh._spread(left, right, "k", "o").collect())
    assert got == sorted([(1, i, "x") for i in range(50)] + [(2, 1, "y")])


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (300, 300)]
    got = {(r.a, r.b) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 51)} | {(200, 100), (150, 100)}


@pytest.mark.parametrize("block_nodes", [mh.BLOCK_NODES, 700])
def test_bucket_of_many_families(spark, monkeypatch, block_nodes):
    """Copies of one template, most pairs a little below the limit: their links are few and far apart in the buckets."""
    monkeypatch.setattr(mh, "BLOCK_NODES", block_nodes)
    rng = np.random.default_rng(11)
    n, length = 2500, 100
    # two places changed in each: pairs link only where places are close to each other
    base = [f"w{i}" for i in range(length)]
    place = np.sort(rng.choice(np.arange(5, length - 10), (n, 2)), axis=1)
    texts, sets = [], np.zeros((n, length - 4), bool)
    for i, (a, b) in enumerate(place.tolist()):
        text = list(base)
        text[a], text[b] = f"x{i}", f"y{i}"
        texts.append(" ".join(text))
        sets[i] = True
        for p in (a, b):
            sets[i, max(0, p - 4) : p + 1] = False
    # own shingles never match another text's
    shared = sets.astype(np.float32) @ sets.T.astype(np.float32)
    linked = (shared >= 0.8 * (2 * (length - 4) - shared) - 1e-6) | np.eye(n, dtype=bool)
    want = np.arange(n)
    while True:
        least = np.where(linked, want[None, :], n).min(axis=1)
        if (least == want).all():
            break
        want = least
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in mh.classes(frame).collect()}
    wrong = sum(got[i] != want[i] for i in range(n))
    assert wrong == 0, (wrong, len(set(want.tolist())), len(set(got.values())))


def test_shingles_of_close_pairs_only(spark, monkeypatch):
    """Texts that meet in buckets and are not alike are told apart by their signatures; their shingles are not made."""
    rng = random.Random(5)
    common = [f"w{i}" for i in range(60)]
    texts = [" ".join(common + [f"x{rng.randrange(10**9)}" for _ in range(30)]) for _ in range(60)]
    texts += [texts[0] + " more", *(" ".join(f"z{i}" for i in range(60)) + end for end in ("", " more"))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []
    elements = mh._elements
    monkeypatch.setattr(mh, "_elements", lambda docs, nodes, *how: (made.extend(r.node for r in nodes.collect()), elements(docs, nodes, *how))[1])
    nodes = mh.signatures(frame).withColumnRenamed("id", "node")
    assert mh._neighbour_pairs(mh._bucket_rows(nodes, mh.BANDS, mh.ROWS)).count() > 30
    got = {r.doc_id: r.class_id for r in mh.classes(frame).collect()}
    assert got == {i: {60: 0, 62: 61}.get(i, i) for i in range(63)}
    assert set(made) == {0, 60, 61, 62}
