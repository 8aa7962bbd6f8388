import random

import numpy as np
import pytest
from siltworks.llm import bpe
from siltworks.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(vocabulary_path())


def test_words_of_every_character_as_the_library(library):
    split = library.pre_tokenizer.pre_tokenize_str
    letters = {b: c for c, b in bpe.byte_letters().items()}
    assert letters[32] == "Ġ" and len(letters) == 256
    different = []
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        text = f"a{chr(code)}b {chr(code)}1"
        if chr(code).isspace() or chr(code).isalnum() or code < 0x3000 or code % 7 == 0:
            want = ["".join(letters[b] for b in w.encode()) for w in bpe.split_words(text)]
            if want != [w for w, _ in split(text)]:
                different.append(code)
    assert not different, [hex(c) for c in different[:50]]


def test_random_words_as_the_library(library, vocabulary):
    rng = random.Random(5)
    encoder = bpe.Encoder(vocabulary, cache_words=500)
    texts = ["".join(rng.choice("abcdeinrst '.,\n\té9ñ—中") for _ in range(rng.randrange(120))) for _ in range(1500)]
    texts += ["a" * 5000, "ab" * 700, "the" * 40, "é" * 300, "word" * 9, "<|endoftext|>", "x<|endoftext|><|endoftext|> y  ", "", " ", "\n\n \n", "it's we'll 'tis", "a  b   c \n d"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode(vocabulary, ids) == text == library.decode(ids.tolist(), skip_special_tokens=False)


def test_bytes_that_are_no_text(vocabulary):
    ids = np.array([vocabulary.byte_ids[b] for b in b"a\xff\xc3\xa9\xe2\x82"], np.int32)
    assert bpe.decode(vocabulary, ids) == "a�é�"


def test_documents_as_the_library(spark, docs, rows, none, library):
    got = bpe.encode(docs, vocabulary_path())
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == want
    back = bpe.decode_ids(got, vocabulary_path())
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t in rows)
    both = bpe.round_trip(docs, vocabulary_path())
    assert sorted((str(r.doc_id), r.ids_text) for r in both.collect()) == [(i, ",".join(map(str, x))) for i, x in want]
    assert bpe.encode(none, vocabulary_path()).count() == 0


def test_other_tokenizers_are_refused():
    import json

    from siltworks.llm.queries import vocabulary_path

    with open(vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.require_byte_level(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            bpe.require_byte_level(spec | change)


def test_add_ids_keeps_text_and_names(spark):
    from siltworks.llm.queries import vocabulary_path

    frame = spark.createDataFrame([(1, "one two", "x", 7), (2, None, "y", 8), (2, "", "z", 9)], "doc_id long, text string, ids string, N_TOKENS int")
    out = bpe.add_ids(frame, vocabulary_path())
    assert out.columns == [*frame.columns, "ids_", "n_tokens_"]
    assert sorted(((r.doc_id, r.text, r["ids"], r["N_TOKENS"], len(r["ids_"]), r["n_tokens_"]) for r in out.collect()), key=str) == [(1, "one two", "x", 7, 2, 2), (2, "", "z", 9, 0, 0), (2, None, "y", 8, 0, 0)]


def test_vocabularies_beyond_a_pair_key_are_refused():
    import json

    with open(vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"] = spec["model"]["vocab"] | {"zzzz": bpe.MAX_IDS}
    with pytest.raises(ValueError, match="ids or merges"):
        bpe.Vocabulary.of(spec)
