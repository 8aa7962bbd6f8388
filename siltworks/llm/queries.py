"""Thin queries that apply the operators, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, class_lm, decontaminate, html_text, line_dedup, minhash, oracles, quality, resample, secrets, substring_dedup, token_files
from .shared import documents, fresh_path, sha256_hex, text_or_empty


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find(documents(spark, sf_dir), items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(found, lambda s: s["kind"].isin(*secrets.BASE))
    return secrets.scan(documents(spark, sf_dir)).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        sha256_hex(secrets.span_text(base)).alias("base_sha256"),
        secrets.span_text(found).alias("spans"),
    )


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.fit_and_score(documents(spark, sf_dir)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(documents(spark, sf_dir), vocabulary_path())
    return coded.select("doc_id", "n_tokens", sha256_hex(F.col("ids_text")).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(documents(spark, sf_dir)).select("doc_id", *[f"_quality.{n}" for n in names])


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    back = chat.read_back(chat.format_windows(table.unionByName(more)))
    return back.select("conv_id", "n_turns", sha256_hex(F.col("turns")).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha256_hex(F.col("loss")).alias("loss_sha256"), "formatted_chars")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(documents(spark, sf_dir)).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write(documents(spark, sf_dir), path, vocabulary_path())
    return token_files.read(spark, path).withColumnRenamed("id", "doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(documents(spark, sf_dir))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), sha256_hex(text_or_empty("text")).alias("kept_sha256"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = align.align(documents(spark, sf_dir), vocabulary_path(), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample.resample(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secrets": op3_secrets,
    "op4_class_lm": op4_class_lm,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_minhash": op8_minhash,
    "op9_token_files": op9_token_files,
    "op10_line_dedup": op10_line_dedup,
    "op11_align": op11_align,
    "op12_html_text": op12_html_text,
    "op13_resample": op13_resample,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": oracles.OP1,
    "op2_substring_dedup": oracles.OP2,
    "op6_quality": oracles.OP6,
    "op10_line_dedup": oracles.OP10,
    "op12_html_text": oracles.OP12,
}
