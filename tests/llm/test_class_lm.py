import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from siltworks.llm import class_lm as lm
from siltworks.llm.hashing import text_chunks
from siltworks.llm.shared import stored

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(lower), None]


def is_held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize("n_known", [lm.N_KNOWN, 40])
def test_counts_and_base_score(docs, rows, n_known):
    counts = Counter(t for i, text in rows if not is_held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        want.append((str(i), len(own), is_held_out(i), len(own), sum(counts[t] > 0 for t in own), n, round(base, 4)))
    scored = lm.fit_and_score(docs, n_units=60, n_endings=30, n_classes=9, n_known=n_known).collect()
    got = [(str(r.doc_id), r.n_tokens, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored]
    assert sorted(got) == sorted(want)
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_is_the_models_probability(docs, rows):
    """Each text's score against the definition, from the words' classes and counts made by plain Python."""
    n_classes = 9
    training = docs.where(~lm.held_out("doc_id"))
    counts = stored(lm.word_counts(training, "text", 30), "test-counts")
    model = lm.train(counts, training, n_units=60, n_endings=30, n_classes=n_classes, n_known=400)
    assert (model.lookup.classes > 0).all() and (model.of_endings > 0).all()
    known = {(a, b): c for a, b, c in zip(model.lookup.h1.tolist(), model.lookup.h2.tolist(), model.lookup.classes.tolist())}

    def class_of(word):
        if word is None:
            return 0
        t = lm.Tokens(next(text_chunks(pa.array([word]))), 30)
        return known.get((int(t.h1[0]), int(t.h2[0])), int(model.of_endings[t.ending[0]]))

    of = {w: class_of(w) for w in {w for _, text in rows for w in tokens(text)}}
    trained = [tokens(text) for i, text in rows if not is_held_out(i)]
    times = Counter(w for words in trained for w in words)
    joint = np.zeros((n_classes, n_classes))
    for words in trained:
        for a, b in zip([None, *words], words):
            joint[of[a], of[b]] += 1
    unigram = (joint.sum(0) + 1) / (joint.sum() + n_classes)
    size = Counter(of[w] for w in times)
    want = []
    for i, text in rows:
        words = tokens(text)
        score = 0.0
        for a, b in zip([None, *words], words):
            p, c = of[a], of[b]
            score += math.log10((joint[p, c] + lm.SMOOTHING * unigram[c]) / (joint[p].sum() + lm.SMOOTHING))
            score += math.log10((times[b] + 1) / (joint[:, c].sum() + size[c] + 1))
        want.append((str(i), len(words), round(score, 3)))
    scored = lm.score(docs, model, counts)
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in scored.collect()) == sorted(want)


def test_held_out_perplexity_falls_by_the_words_step(docs):
    """Words with classes of their own, against their endings' classes."""
    found = {}
    for n_known in (60, 2000):
        scored = lm.fit_and_score(docs, n_units=60, n_endings=30, n_classes=16, n_known=n_known)
        found[n_known] = {r.held_out: r for r in lm.perplexity(scored).collect()}
    assert found[2000][False].perplexity < found[60][False].perplexity
    assert all(r.perplexity > 1 and r.tokens > r.documents for v in found.values() for r in v.values())


def test_best_class_has_the_highest_likelihood():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 12, 600)
    classes = np.append([0], 1 + np.arange(11) % 4)
    table = np.zeros((12, 12))
    np.add.at(table, (words[:-1], words[1:]), 1)

    def likelihood(c):
        member = np.eye(5)[c]
        joint = member.T @ table @ member
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(joint) - f(joint.sum(1)) - f(joint.sum(0))

    member = np.eye(5)[classes]
    into, out = table.T @ member, table @ member
    got = lm.best_classes(into[1:], out[1:], np.diag(table)[1:], classes[1:], member.T @ table @ member)
    for w in range(1, 12):
        tried = [likelihood(np.where(np.arange(12) == w, b, classes)) for b in range(1, 5)]
        assert math.isclose(tried[got[w - 1] - 1], max(tried)), w


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    kind = np.arange(60) % 3
    joint = np.array([[1, 9, 1], [1, 1, 9], [9, 1, 1.0]])
    table = rng.poisson(joint[kind][:, kind] * 20).astype(float)
    table = np.pad(table, ((1, 0), (1, 0)), constant_values=1)
    classes = lm.exchange(table, 4)[1:]
    assert len({(a, b) for a, b in zip(kind, classes)}) == 3


def test_edges(spark, docs, none):
    assert lm.fit_and_score(none, n_units=5, n_endings=3, n_classes=3).count() == 0
    alone = docs.where(lm.held_out("doc_id"))
    scored = lm.fit_and_score(alone, n_units=5, n_endings=3, n_classes=3)
    assert scored.agg(F.max("n_known"), F.max("train_tokens"), F.sum(F.isnan("score").cast("int"))).first()[:3] == (0, 0, 0)
