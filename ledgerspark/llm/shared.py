"""Small helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir; only a local master that names none (tests) gets one of its own."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerspark-"))


def checkpoint_folder(spark: SparkSession) -> str:
    """Where written tables go: the folder in spark.checkpoint.dir."""
    with_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, whose texts may be long: Arrow batches hold at most ``rows`` rows from here on, so Python workers stay small."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there: lineage ends, lost executors cost a reread."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder as compressed Parquet, and read from there: for wide or many rows."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
