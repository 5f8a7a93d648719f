"""The corpus operators as queries over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import heap_lloyd, knn, langid, lm, mixing, quality, secret_scan, simhash, spiece, toxicity, url_rules, weighted_lloyd, winnowing
from .shared import table
from .twins import SQL


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(knn.integers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
    return quality.judge(table(spark, sf_dir, "documents")).select(*cols)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.apply_rules(table(spark, sf_dir, "pages"), url_rules.default_rules(spark))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label(table(spark, sf_dir, "documents"))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "n_slots", "first_slot")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_lloyd.codes(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_lloyd.clusters(weighted_lloyd.quantised(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_exact_top_k, op3_quality_rules, op4_url_filters, op5_simhash_near_dedup, op6_toxicity, op7_secret_scans, op8_language_id, op9_mixing_sources, op10_lm_scoring, op11_vector_codes, op12_decontamination, op13_centroid_clustering)
}

__all__ = ["QUERIES", "SQL"]
