import hashlib
import time
from collections import Counter

from pyspark.sql import functions as F

from siltworks.llm import line_dedup
from siltworks.llm.line_dedup import drop_lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_docs, min_chars):
    lines = [(t or "").split("\n") for _, t in rows]
    docs = Counter(k for own in lines for k in {key(x) for x in own})
    gone = {k for k, n in docs.items() if n >= min_docs and len(k) >= min_chars}
    return Counter((i, len(own), sum(key(x) in gone for x in own), "\n".join(x for x in own if key(x) not in gone)) for (i, _), own in zip(rows, lines))


def test_documents_against_brute_force(docs, rows):
    for min_docs, min_chars, batches, fanout in ((10, 1, 4, 2), (2, 4, 3, 3), (2, 1, 1, 2)):
        got = drop_lines(docs, min_docs=min_docs, min_chars=min_chars, batches=batches, fanout=fanout)
        assert got.columns == [*docs.columns, "_n_lines", "_n_dropped"]
        assert Counter((r.doc_id, r._n_lines, r._n_dropped, r.text or "") for r in got.collect()) == brute(rows, min_docs, min_chars)


def test_edges(spark, none):
    texts = ["", None, "A b \n x", "\ta B\r", "a b", "İx\nix", "é", "É"]
    rows = list(enumerate(texts)) + [(4, "a b"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r._n_lines, r._n_dropped, r.text or "") for r in drop_lines(docs, min_docs=2).collect())
    assert got == brute(rows, 2, 1)
    assert drop_lines(none).count() == 0


def test_tables_are_dropped_and_names_kept(spark):
    frame = spark.createDataFrame([(i, f"same line\nown {i}", "a", "b") for i in range(12)], "doc_id long, text string, _n_lines string, _n_dropped string")
    out = drop_lines(frame)
    assert out.columns == [*frame.columns, "_n_lines_", "_n_dropped_"]
    assert drop_lines(frame, counts=None).columns == frame.columns
    assert {(r.text, r["_n_lines"], r["_n_lines_"], r["_n_dropped_"]) for r in out.collect()} == {(f"own {i}", "a", 2, 1) for i in range(12)}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_text_of_a_million_lines(spark):
    """Half of the lines are common to ten documents; dropping them takes time linear in the lines."""
    n = 500_000
    common = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("common "), i.cast("string"))), "\n")
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("own "), F.col("id").cast("string"), F.lit(" "), i.cast("string"))), "\n")
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.concat_ws("\n", common, own)).otherwise(common).alias("text"))
    start = time.time()
    got = {r.doc_id: (r._n_lines, r._n_dropped, r.h) for r in line_dedup.drop_lines(docs).select("doc_id", "_n_lines", "_n_dropped", F.sha2("text", 256).alias("h")).collect()}
    kept = "\n".join(f"own 0 {i}" for i in range(n))
    assert got[0] == (2 * n, n, hashlib.sha256(kept.encode()).hexdigest())
    assert all(got[k] == (n, n, hashlib.sha256(b"").hexdigest()) for k in range(1, 10))
    assert time.time() - start < 240
