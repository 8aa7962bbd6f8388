"""A corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Quality rules reject junk; lines that many documents share are taken out; of each group of near copies the
document with the smallest id stays; passages of benchmark items are cut out, and documents that are mostly
such passages dropped; what is left is encoded, and its ids are checked to decode to the text. A stage's table is
removed when the next stage has been written.

Defined cases: a document with a null or empty text, or of fewer words than the quality rules ask for, is rejected by the first
stage; a null id has no near copies and stays; rows that repeat are near copies of which one stays; of ties the smaller id stays;
texts of any length go through every stage whole; columns besides id, text and n_chars are kept as they are, also where their names
clash with those of a stage's own (the last stage's get underscores behind); an empty table gives an empty table with the two columns
of the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import bpe, decontaminate, line_dedup, minhash, quality
from siltworks.llm.queries import vocabulary_path
from siltworks.llm.shared import fresh_path, remove


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def reject_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents keep their rows, also where no line is left."""
    return _recounted(line_dedup.drop_lines(docs, counts=None))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _recounted(decontaminate.remove_spans(docs, items))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds `ids` and `n_tokens`; ids that do not decode to their text raise."""
    return bpe.add_ids(docs, vocabulary_path())


STAGES = [
    ("quality_rules", reject_junk),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", cut_benchmarks),
    ("bpe_encoding", encode),
]

#: SQL can't express near-duplicate classes; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
