"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents that it leaves.

Stages are written as Parquet and read again before the next one. The first four return the columns of
documents; the last returns each document's ids and what they decode to.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import mixing, quality, secret_scan, simhash, spiece
from ledgerspark.llm.shared import checkpoint_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limit leave the others."""
    return quality.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.deduplicated(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are masked."""
    return secret_scan.redacted(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each pass of the mix that takes them."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, text (decoded) of each document in the mix."""
    return spiece.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources", source_mix),
    ("SentencePiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: XXH64 shingles and SentencePiece ids are beyond SQL; tests/llm compare the stages with plain Python.
ORACLE_SQL = None
