import pytest

#: Documents that every operator must take: null and empty texts, ties, repeated rows, a long text.
EDGES = [
    (900001, None),
    (900002, ""),
    (900003, " \t\n\r\x0b\x0c "),
    (900004, "one two three"),
    (900004, "one two three"),
    (None, "a row without id"),
    (900005, "word " * 30000),
    (900006, "é ü ſ K İ   \x1c\x85 ,;<|endoftext|>\\"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The documents of sf0.001 and the edge cases, with extra columns whose names clash with results."""
    from pyspark.sql import functions as F

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    edges = spark.createDataFrame(EDGES, "doc_id long, text string")
    both = base.unionByName(edges)
    for name in ("n_words", "c0", "start", "kind", "h1", "items"):
        both = both.withColumn(name, F.lit("x"))
    return both


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
