import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltworks.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = ["a  b   c ", " \n\tx  y", "漢字 漢字がx 漢", "▁x y", "x ▁", "\x00 \x85 y", "  ", "a\x1c b \x1f  c", "<|endoftext|> <s> </s>", "é" * 200 + " ü", "don't we'll  'S 12 34,5", "   x"]


def whole(texts):
    """Both tokenizers over whole texts, and every pair of tokens whose bytes overlap."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    vocabularies = align.Vocabularies.read(A, B)
    found, counts = [], Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        tokens_a, tokens_b = [vocabularies.a_bytes[i] for i in ids_a], [vocabularies.b_bytes[i] for i in ids_b]
        raw = (" " + (text or "")).encode()
        if b"".join(tokens_a) != raw or b"".join(tokens_b) != raw:
            found.append(None)
            continue
        spans = []
        for tokens in (tokens_a, tokens_b):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        links = [(x, y) for (s, e), x in zip(spans[0], ids_a) for (u, v), y in zip(spans[1], ids_b) if s < v and u < e]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for (s, e), i in zip(own, ids) if low <= s < end) for own, ids in zip(spans, (ids_a, ids_b))))
            low = end
        counts.update(links)
        found.append((ids_a, ids_b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            ids_a, ids_b, groups, links = f
            out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [None, 40])
def test_like_whole_texts(spark, docs, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(align, "BLOCK_LINKS", limit)
    slim = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 2000)
    slim = slim.unionByName(spark.createDataFrame([(800000 + i, t) for i, t in enumerate(MORE)], "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in slim.columns if c not in ("doc_id", "text")])).repartition(3)
    rows = [(r.doc_id, r.text) for r in slim.collect()]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, whole([t for _, t in rows])))
    got = sorted((str(r[0]), *r[1:]) for r in align.align(slim, A, B).collect())
    assert got == want
    assert sum(w[1] > 0 for w in want) > 100


def test_long_and_repeated(docs):
    """The long text, the repeated rows and the row without id have their tokens."""
    got = {(r.doc_id, r.n_a) for r in align.align(docs, A, B, hashed=False).collect()}
    library = Tokenizer.from_file(A)
    assert {(900005, len(library.encode(" " + "word " * 30000).ids)), (None, len(library.encode(" a row without id").ids)), (900001, 0), (900002, 0)} <= got
    texts = align.align(docs.where("doc_id = 900004"), A, B, hashed=False).collect()
    assert len(texts) == 2 and texts[0].groups == texts[1].groups and texts[0].groups.count(";") == 2


def test_only_other_groups_are_pairs(docs):
    """Pairs that are shuffled are none of one token each with the same bytes."""
    v = align.Vocabularies.read(A, B)
    made = align.Aligner(v).align([" the", " xylophonist", "  a"])
    for u in made:
        assert u.n_links == len(u.same) // 4 + len(u.pairs) // 8
    assert len(made[0].same) == 4 and not made[0].pairs


def test_empty_table(none):
    out = align.align(none, A, B)
    assert out.count() == 0 and out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_vocabulary_with_words_behind_spaces_is_refused():
    class Pieces:
        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁a", "of▁the"][i]

        def encode(self, text, out_type):
            return ["▁a"]

        def piece_to_id(self, piece):
            return 0

        def is_unknown(self, i):
            return False

    with pytest.raises(ValueError):
        align.require_pieces(Pieces())
