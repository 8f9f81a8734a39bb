"""One query per operator, over its whole tables, and the SQL where one can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthframe.llm import (decontaminate, language, licenses, line_dedup, merkle, near_dedup, packing, quality_model, quality_rules, substring_dedup,
                            suffix_dedup, vector_dedup, whitening)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), VOCABULARY)


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.delete_copies(table(spark, folder, "documents"))
    counts = [F.col(f"line counts.{c}").alias(c) for c in ("n_lines", "n_removed", "n_runs")]
    return found.select("doc_id", *counts, F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.deduplicate(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, folder, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.deduplicate(table(spark, folder, "documents"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return quality_model.score(documents, quality_model.fit(documents, table(spark, folder, "labels")))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(table(spark, folder, "documents"), {"n_chars": F.col("n_chars") + 1}, changed)


def op12_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.deduplicate(table(spark, folder, "embeddings"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, folder, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.oracle(),
    "op6_quality_rules": quality_rules.oracle(),
    "op11_merkle_manifest": merkle.oracle(),
    "op12_vector_dedup": vector_dedup.oracle(),
}
