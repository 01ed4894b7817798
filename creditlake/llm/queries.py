"""One query for each operator, over its whole table, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.llm import chat_format, divergence, embedding_dedup, exact_dedup, html_extract, jaccard_join, language_id, license_scan, mixing, packing, substring_dedup, token_counts, whitening


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_map(_table(spark, folder, "documents"))


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extracted(_table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, folder, "documents"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scanned(_table(spark, folder, "documents"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.without_repeats(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language_id.identified(docs, *language_id.learned(docs))


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, folder, "documents"))


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    added = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{hard}'), (-1L, 1L, 'assistant', '{hard}') AS t(conv_id, turn, role, text)")
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.digests(chat_format.formatted(rows.withColumns({"seq": F.lit(0), "kind": F.lit("message")})))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(_table(spark, folder, "documents"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_html_extract": op4_html_extract,
    "op5_source_mixing": op5_source_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_chat_format": op10_chat_format,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_counts": op13_token_counts,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op5_source_mixing": mixing.SQL,
    "op6_license_scan": license_scan.oracle(),
    "op7_substring_dedup": substring_dedup.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op10_chat_format": chat_format.SQL,
    "op12_source_divergence": divergence.SQL,
}
