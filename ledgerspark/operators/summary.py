"""One row per session, the fact table of the period reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import ratio_pct
from .analyzers import duplicate_reads, idle_context, not_empty, totals
from .pricing import total_tokens
from .requests import primary_model


def session_summary(requests: DataFrame, sessions: DataFrame, calls: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """file_id, session columns, sums, dollars, total_tokens, output_ratio_pct, dup_tokens, idle_tokens, primary_model.

    requests: output of pricing.priced(); sessions: file_id, project, started_at, ended_at, ...
    """
    out = not_empty(totals(requests)).withColumn("total_tokens", total_tokens())
    out = out.withColumn("output_ratio_pct", ratio_pct(F.col("output"), F.col("total_tokens")))
    out = out.join(sessions, "file_id").join(primary_model(requests), "file_id", "left")
    if calls is None:
        return out.withColumn("dup_tokens", F.lit(0).cast("long")).withColumn("idle_tokens", F.lit(0).cast("long"))
    dup = duplicate_reads(calls, prior).groupBy("file_id").agg(F.sum("wasted_tokens").alias("dup_tokens"), F.count(F.lit(1)).alias("distinct_files_read"))
    idle = idle_context(calls, requests).groupBy("file_id").agg(F.sum("idle_tokens").alias("idle_tokens"))
    out = out.join(dup, "file_id", "left").join(idle, "file_id", "left")
    return out.fillna(0, ["dup_tokens", "distinct_files_read", "idle_tokens"])
