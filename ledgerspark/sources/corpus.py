"""Benchmark corpora: a folder a task, with its metadata and two transcripts; a corpus loads whole or not at all.

Folders that hold no file at all are not seen, as object stores don't have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The files of a task, categories, and what stands in for a field that isn't there.
METADATA, BASELINE, OPTIMIZED = "task.yml", "baseline-transcript.jsonl", "optimized-transcript.jsonl"
CATEGORIES = (
    "refactor", "debug", "feature", "test", "review", "docs", "migration", "onboarding", "optimization", "bugfix-cross-file", "exploration", "dependency-trace",
    "api-discovery", "test-failure-triage", "config-archaeology", "type-inference", "rename-everything", "dead-code", "security-review", "dependency-update",
)
DEFAULTS = {"category": "feature", "difficulty": "medium", "model_recommended": "claude-opus-4", "estimated_cost_band": "medium", "notes": ""}
OLDER = {"model_recommended": "model", "estimated_cost_band": "cost_band"}
QUICK = 3
PAIR = r"^([A-Za-z_][A-Za-z0-9_-]*)\s*:\s*(.*)$"


class IncompleteCorpus(ValueError):
    """Its message names every file that is missing."""


def pairs(text: Column) -> Column:
    """Array of (key, value) of flat YAML: one a line, ``#`` for remarks, quotes around a value taken off."""

    def value(line: Column) -> Column:
        raw = F.regexp_extract(line, PAIR, 2)
        bare = F.when(raw.rlike(r"""(?s)^".*"$|^'.*'$"""), F.regexp_replace(raw, r"""^["']|["']$""", "")).when(raw.isin("'", '"'), "").otherwise(raw)
        return F.when(bare.contains(" #"), F.trim(F.substring_index(bare, " #", 1))).otherwise(bare)

    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.transform(F.filter(lines, lambda x: x.rlike(PAIR)), lambda x: F.struct(F.regexp_extract(x, PAIR, 1).alias("key"), value(x).alias("value")))


def field(parsed: Column, key: str) -> Column:
    """The last value of a key, trimmed; null if it isn't there."""
    return F.trim(F.try_element_at(F.filter(parsed, lambda p: p["key"] == key), F.lit(-1))["value"])


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """task (folder name), file, path, size of each file right in a task's folder; no contents are read."""
    rows = spark.read.format("binaryFile").load(f"{folder}/*/*").select("path", F.col("length").alias("size"))
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -2).alias("task"), F.element_at(parts, -1).alias("file"), "path", "size")


def gaps(files: DataFrame) -> DataFrame:
    """task, file: what is missing. Of a task without metadata only that is told."""
    needed = files.select("task").distinct().withColumn("file", F.explode(F.array(*map(F.lit, (METADATA, BASELINE, OPTIMIZED)))))
    missing = needed.join(files, ["task", "file"], "left_anti")
    bare = F.max(F.col("file") == METADATA).over(W.partitionBy("task"))
    return missing.withColumn("bare", bare).filter(~F.col("bare") | (F.col("file") == METADATA)).drop("bare")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """A row a task: task, id, title, category, difficulty, model_recommended, estimated_cost_band, notes, baseline, optimized (paths), size (of both).

    Raises IncompleteCorpus if any task lacks a file.
    """
    files = listed(spark, folder)
    if missing := [f"{r.task}/{r.file}" for r in gaps(files).orderBy("task", "file").collect()]:
        raise IncompleteCorpus(f"{len(missing)} files are missing: {', '.join(missing)}")
    text = spark.read.text(f"{folder}/*/{METADATA}", wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("task"), pairs(F.col("value")).alias("pairs"))
    p = F.col("pairs")
    said = {c: F.coalesce(field(p, c), *([field(p, OLDER[c])] if c in OLDER else []), F.lit(d)) for c, d in DEFAULTS.items()}
    said["category"] = F.when(said["category"].isin(*CATEGORIES), said["category"]).otherwise(DEFAULTS["category"])
    name = F.coalesce(field(p, "id"), F.col("task"))
    meta = text.select("task", name.alias("id"), F.coalesce(field(p, "title"), name).alias("title"), *[c.alias(n) for n, c in said.items()])
    of = lambda file: F.max(F.when(F.col("file") == file, F.col("path")))
    paths = files.filter(F.col("file").isin(BASELINE, OPTIMIZED)).groupBy("task").agg(of(BASELINE).alias("baseline"), of(OPTIMIZED).alias("optimized"), F.sum("size").alias("size"))
    return meta.join(paths, "task").orderBy("task")


def quick(tasks: DataFrame, most: int = QUICK) -> DataFrame:
    """The tasks with the smallest transcripts."""
    return tasks.orderBy("size", "task").limit(most)
