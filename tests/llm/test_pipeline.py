import corpus_pipeline
import test_decontaminate
import test_line_dedup
import test_minhash
import test_quality
from siltworks.llm.decontaminate import cut, words_of
from siltworks.llm.shared import stored


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    from siltworks.llm.quality import judge

    kept = {r.doc_id for r in judge(docs).collect() if r._quality.kept}
    assert not any(i in kept for i, t in rows if test_quality.brute(t)[5])
    rows = [(i, t) for i, t in rows if i in kept]
    rows = [(i, t) for i, _, _, t in test_line_dedup.brute(rows, 10, 1)]
    of = test_minhash.brute(rows)
    rows = [(i, t) for i, t in rows if of[i] == i]
    want = {}
    for i, t in rows:
        words = test_decontaminate.plain_words(t)
        joined = " " + " ".join(words) + " "
        near = [(n, x) for n, x in items if any(f" {' '.join(test_decontaminate.plain_words(x)[k : k + 10])} " in joined for k in range(max(1, len(test_decontaminate.plain_words(x)) - 9)))]
        hit = set()
        for _, x in near:
            own = test_decontaminate.plain_words(x)
            n = min(10, len(own))
            for a in range(len(own) - n + 1):
                for b in range(len(words) - n + 1):
                    if words[b : b + n] == own[a : a + n]:
                        hit |= set(range(b, b + n))
        if len(hit) > 0.5 * len(words):
            continue
        spans = []
        for k in sorted(hit):
            if spans and spans[-1]["end"] == k:
                spans[-1]["end"] = k + 1
            else:
                spans.append({"start": k, "end": k + 1})
        want[i] = cut(t, spans, 1)
        assert len(words_of(want[i])) == len(words) - len(hit)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "ids", "n_tokens"]
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and r.n_tokens == len(r.ids) for r in got.values())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns + (["ids", "n_tokens"] if name == "bpe_encoding" else [])
        assert out.count() == 0


def test_stages_with_nulls_repeated_rows_and_clashing_names(spark):
    """Every stage takes such a table; columns of any name come through as they were, and no text is lost but by its rule."""
    sf_dir = "/root/testdata/sf0.001"
    names = ["_quality", "_gone", "_nth", "_n_lines", "_n_dropped", "ids", "N_TOKENS", "class_id", "k1", "words"]
    text = " ".join(f"the word{i} of" for i in range(40))
    other = " ".join(f"the other{i} of" for i in range(40))
    rows = [(1, text, 5), (1, text, 5), (1, other, 5), (2, text, 5), (3, None, None), (4, "", 0), (None, other + " more", 1), (5, "the end of it " * 50_000, 1)]
    frame = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    docs = frame
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.columns[: len(frame.columns)] == frame.columns
    assert docs.columns == [*frame.columns, "ids_", "n_tokens_"]
    out = docs.collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted([(1, text), (1, other), (0, other + " more")])
    assert all([r[n] for n in names] == names and r["n_tokens_"] == len(r["ids_"]) > 0 for r in out)
    # near dedup and encoding keep null and empty texts
    kept = stored(corpus_pipeline.STAGES[2][1](spark, frame, sf_dir), "near")
    assert {r.doc_id for r in kept.collect()} == {None, 1, 3, 5}
    coded = corpus_pipeline.STAGES[4][1](spark, frame, sf_dir)
    assert {(r.doc_id, r.text, r["n_tokens_"]) for r in coded.collect() if not r.text} == {(3, None, 0), (4, "", 0)}
