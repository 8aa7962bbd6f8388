import random
import zlib

import numpy as np
import pytest
from siltworks.llm import token_files as tf
from siltworks.llm.queries import vocabulary_path
from siltworks.llm.shared import fresh_path


def test_codes():
    rng = np.random.default_rng(1)
    for top in (2, 256, 257, 70_000, 2**32 - 1):
        for n in (1, 7, 8, 511, 512, 513, 3000):
            ids = (rng.random(n) ** 3 * top).astype(np.uint32)
            levels, bitmaps, ranks = tf.pack(ids)
            assert (tf.unpack(levels, bitmaps) == ids).all()
            assert [tf.token_at(levels, bitmaps, ranks, i) for i in range(n)] == ids.tolist()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_texts_as_the_library(library):
    rng = random.Random(9)
    with open(vocabulary_path(), encoding="utf-8") as f:
        encoder = tf.LibraryEncoder(f.read())
    for limit in (tf.CACHE_WORDS, 7):
        encoder.words.limit = limit
        for _ in range(3000):
            text = "".join(rng.choice(["a", "the", "é", "'s", ".", " ", " ", "\n", "\t", "9", "\u00a0", "\x1c", "<|endoftext|>" if rng.random() < 0.05 else "x"]) for _ in range(rng.randrange(14)))
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip(spark, docs, rows, none, library):
    path = fresh_path(spark, "token-test")
    tf.write(docs, path, vocabulary_path(), segment_ids=5000)
    assert spark.read.parquet(path).count() > 5
    coded = [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]
    coded.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    ids, want = [], []
    for i, x in coded:
        want.append((i, len(ids), len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        ids += x
    got = [(r.id, r.start, r.n_tokens, r.ids_crc32) for r in tf.read(spark, path).orderBy("start").collect()]
    assert got == want
    asked = [0, 1, 4999, 5000, 5001, len(ids) - 1, len(ids), -1, *range(7, len(ids), 997), 7]
    positions = spark.createDataFrame([(p,) for p in asked], "position long")
    assert {r.position: r.token for r in tf.tokens_at(spark, path, positions).collect()} == {p: ids[p] for p in asked if 0 <= p < len(ids)}
    empty = fresh_path(spark, "token-test")
    tf.write(none, empty, vocabulary_path())
    assert tf.read(spark, empty).count() == 0
