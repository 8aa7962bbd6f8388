import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from paths import DATA
from pyspark.sql import functions as F

from siltworks.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, max_n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(rows, items, max_n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    bucket = lambda g: crc32(g.encode()) % buckets
    own = [(i, t, *grams(t, max_n)) for i, t in rows]
    s, t = Counter(bucket(g) for r in own for g in r[3]), Counter(bucket(g) for x in items for g in grams(x, max_n)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text, n_words, found in own:
        weight = math.floor(sum(gain(bucket(g)) for g in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= max(1, min_words)), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for r in out:
        r.append(None)
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("options", [{}, {"max_n": 3, "buckets": 97, "percent": 50, "min_words": 0, "seed": 7}])
def test_like_brute_force(spark, docs, rows, options):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = resample.resample(docs, items, **options).collect()
    want = brute(rows, [r.text for r in items.collect()], **options)
    tell = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tell, got)) == sorted(map(tell, want))
    assert any(r["rank"] for r in got)


def test_overlapped_spans():
    scan = resample.patterns(2)
    n, crcs = resample.features("A-b  ü1;c\nd", scan)
    assert n == 5 and crcs.tolist() == [crc32(x.encode()) for x in ("a", "b", "ü1", "c", "d", "a b", "b ü1", "ü1 c", "c d")]


def test_empty_tables(spark, docs, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(none, empty).count() == 0
    out = resample.resample(docs, empty)
    assert out.count() == docs.count() and out.where(F.col("rank").isNotNull()).count() == out.where("n_words >= 20").count() // 10


def test_ties_and_drawn_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text, 1)] * 3 + [(k, text, 2) for k in range(100, 117)], "doc_id long, text string, rank int")
    items = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    got = resample.resample(docs, items, percent=50).where(F.col("rank").isNotNull()).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 11))
    ordered = sorted(got, key=lambda r: r["rank"])
    assert [r.score for r in ordered] == sorted((r.score for r in got), reverse=True)
    drawn = resample.draw(docs, items, percent=50)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {r.doc_id for r in got}
