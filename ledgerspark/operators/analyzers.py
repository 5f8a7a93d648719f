"""Per-session analyses: totals, duplicate reads, idle context, what could be saved, dearest calls, leaks.

requests: output of pricing.priced(). calls: file_id, turn_idx, call_idx (order within the file), name, path
(normal), raw_path, result_tokens. Every analysis is an aggregation or a window by file, so all of a
session's analyses share one partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import round_half_up
from .pricing import total_tokens
from .rewriters import rewritten

# Tools that read, that touch and that rewrite files; a call of the last kind could have sent a diff.
READS = ("Read", "read_file")
TOUCHES = ("Read", "Edit", "Write", "read_file", "edit_file")
EDITS = ("Edit", "Write", "edit_file", "write_file")
IDLE_TURNS = 5


def totals(requests: DataFrame) -> DataFrame:
    """Per file: sums of usage and dollars, requests, whether all lack usage, output ratio without cache reads."""
    out = requests.groupBy("file_id").agg(
        *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")],
        F.sum("usd").alias("usd"), F.count(F.lit(1)).alias("n_requests"), F.bool_and("missing_usage").alias("missing_all"),
        F.sum(F.when(~F.col("priced"), total_tokens()).otherwise(0)).alias("unpriced_tokens"),
    )
    fresh = F.col("input") + F.col("output") + F.col("cache_write")
    return out.withColumn("output_ratio", F.when(fresh > 0, F.col("output") / fresh).otherwise(F.lit(0.0)))


def not_empty(sessions: DataFrame) -> DataFrame:
    """Sessions with usage: not all of it missing, and some tokens."""
    return sessions.filter(~F.col("missing_all") & (total_tokens() > 0))


def cost_by_model(requests: DataFrame) -> DataFrame:
    by = requests.groupBy("file_id", F.coalesce("model", F.lit("(unknown)")).alias("model")).agg(F.sum("usd").alias("usd"), F.sum(total_tokens()).alias("tokens"))
    order = W.partitionBy("file_id").orderBy(F.desc("usd"), "model")
    return by.withColumn("rank", F.row_number().over(order))


def duplicate_reads(calls: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Per (file, path): reads, tokens of the reads after the first. A path already read in dropped copies (prior) counts one more."""
    reads = calls.filter(F.col("name").isin(*READS) & F.col("path").isNotNull())
    reads = reads.withColumn("n", F.row_number().over(W.partitionBy("file_id", "path").orderBy("call_idx")))
    by = reads.groupBy("file_id", "path").agg(
        F.count(F.lit(1)).alias("own"), F.sum("result_tokens").alias("all_tokens"), F.sum(F.when(F.col("n") > 1, F.col("result_tokens")).otherwise(0)).alias("later_tokens")
    )
    if prior is None:
        by = by.withColumn("before", F.lit(False))
    else:
        by = by.join(prior.select("file_id", "path").distinct().withColumn("before", F.lit(True)), ["file_id", "path"], "left").withColumn("before", F.coalesce("before", F.lit(False)))
    return by.select("file_id", "path", (F.col("own") + F.col("before").cast("int")).alias("reads"), F.when(F.col("before"), F.col("all_tokens")).otherwise(F.col("later_tokens")).alias("wasted_tokens"))


def idle_context(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """Per (file, path): files last touched five or more turns before the end; the cost is the first read's result, once."""
    last = requests.groupBy("file_id").agg(F.max("turn_idx").alias("last_turn"))
    touched = calls.filter(F.col("name").isin(*TOUCHES) & F.col("path").isNotNull())
    by = touched.groupBy("file_id", "path").agg(
        F.max_by("turn_idx", "call_idx").alias("last_ref"), F.min_by(F.when(F.col("name").isin(*READS), F.col("result_tokens")), F.when(F.col("name").isin(*READS), F.col("call_idx"))).alias("cost")
    )
    out = by.join(last, "file_id").withColumn("idle_turns", F.col("last_turn") - F.col("last_ref"))
    return out.filter((F.col("idle_turns") >= IDLE_TURNS) & F.col("cost").isNotNull()).select("file_id", "path", "idle_turns", F.col("cost").alias("idle_tokens"))


def recoverable(sums: DataFrame, duplicates: DataFrame, calls: DataFrame, requests: DataFrame) -> DataFrame:
    """Per file what could be saved: 22 % of writes, duplicate reads, 85 % of the output of editing calls (each call counts)."""
    edits = calls.filter(F.col("name").isin(*EDITS)).join(requests.select("file_id", "turn_idx", F.col("output").alias("turn_output")), ["file_id", "turn_idx"])
    edits = edits.groupBy("file_id").agg(F.sum("turn_output").alias("edit_output"))
    dup = duplicates.groupBy("file_id").agg(F.sum("wasted_tokens").alias("dup"))
    out = sums.join(dup, "file_id", "left").join(edits, "file_id", "left")
    manifest, once = round_half_up(F.col("cache_write") * 0.22), F.coalesce("dup", F.lit(0))
    diff = round_half_up(F.coalesce("edit_output", F.lit(0)) * 0.85)
    most = F.col("input") + F.col("cache_write") + F.col("output")
    return out.select(
        "file_id", manifest.cast("long").alias("manifest"), once.alias("read_once"), diff.cast("long").alias("diff_output"), F.least(manifest.cast("long") + once + diff.cast("long"), most).alias("total")
    )


def dearest_calls(calls: DataFrame, requests: DataFrame, most: int = 5) -> DataFrame:
    """Per file the calls with the largest even share of their request's tokens, and why."""
    n = F.count(F.lit(1)).over(W.partitionBy("file_id", "turn_idx"))
    reads = F.count(F.when(F.col("name") == "Read", 1)).over(W.partitionBy("file_id", "path"))
    c = calls.withColumn("n_calls", n).withColumn("n_reads", F.when((F.col("name") == "Read") & (F.col("path") == F.col("raw_path")), reads).otherwise(0))
    c = c.join(requests.select("file_id", "turn_idx", "input", "output", "cache_read", "cache_write"), ["file_id", "turn_idx"])
    reason = (
        F.when(F.col("cache_write") > F.col("input"), "cache-creation").when(F.col("output") > 1500, "long-output").when(F.col("input") > 10000, "large-input")
        .when(F.col("n_reads") > 1, "duplicate-read").otherwise("ordinary")
    )
    c = c.withColumn("tokens", round_half_up(total_tokens() / F.col("n_calls")).cast("long")).withColumn("reason", reason)
    order = W.partitionBy("file_id").orderBy(F.desc("tokens"), "call_idx")
    return c.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("file_id", "rank", "call_idx", "name", "reason", "tokens")


def leaks(summary: DataFrame, most: int = 3) -> DataFrame:
    """Per file the largest of four kinds of overhead that are above zero; summary has dup_tokens, idle_tokens, cache_write, input."""
    kinds = F.array(
        *[F.struct(F.lit(i).alias("place"), F.lit(t).alias("title"), F.col(c).cast("long").alias("tokens")) for i, (t, c) in enumerate(
            (("duplicate file reads", "dup_tokens"), ("idle context", "idle_tokens"), ("cache-creation overhead", "cache_write"), ("input tokens (system + prompts)", "input")))]
    )
    out = summary.select("file_id", F.explode(kinds).alias("k")).select("file_id", "k.*").filter("tokens > 0")
    order = W.partitionBy("file_id").orderBy(F.desc("tokens"), "place")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("place")


#: Files of which a symbol can be cut out, commands that search, and tokens saved by a refused and by a trimmed read.
TRIMMED, SEARCHES, REFUSED_SAVES, TRIM_SAVES = r"(?i)\.(?:[cm]?[jt]s|[jt]sx|pyi?)$", r"^\s*(?:grep|rg|ag)\b", 2000, 3000


def replay(calls: DataFrame) -> DataFrame:
    """Per call what a cache, a trimmer and the rewriters of commands would have saved: a read of a path read before, else the first read of a source file after any search; of other calls what their rewriter saves.

    calls also has pattern (of searches) and command (of shell calls).
    """
    search = ((F.col("name") == "Grep") & (F.length("pattern") > 0)) | ((F.col("name") == "Bash") & F.col("command").rlike(SEARCHES))
    seen = F.max(F.coalesce(search, F.lit(False)).cast("int")).over(W.partitionBy("file_id").orderBy("call_idx").rowsBetween(W.unboundedPreceding, 0))
    nth = F.row_number().over(W.partitionBy("file_id", "name", "path").orderBy("call_idx"))
    first = F.when((F.col("searched") == 1) & F.col("raw_path").rlike(TRIMMED), TRIM_SAVES).otherwise(0)
    reads = F.when(F.col("nth") > 1, REFUSED_SAVES).otherwise(first)
    saved = F.when((F.col("name") == "Read") & (F.length("path") > 0), reads).otherwise(F.coalesce("rewrite.saved_tokens", F.lit(0)))
    return rewritten(calls.withColumn("searched", seen).withColumn("nth", nth)).withColumn("saved", saved.cast("long"))


def top_files(files: DataFrame, cost: str, most: int = 10) -> DataFrame:
    """Per file_id the ``most`` paths of greatest cost that cost anything, with their rank; ties by path. files: output of duplicate_reads or idle_context."""
    order = W.partitionBy("file_id").orderBy(F.desc(cost), "path")
    return files.filter(F.col(cost) > 0).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
