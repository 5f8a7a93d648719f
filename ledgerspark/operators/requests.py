"""From log lines to requests: merging streamed lines, numbering turns, cross-session ownership.

Lines: file_id, line_no, request_key, model, ts, input, output, cache_read, cache_write, cache_write_1h,
missing_usage, version, entrypoint, sidechain and any other columns the first line of a request supplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

USAGE = ("input", "output", "cache_read", "cache_write", "cache_write_1h")
FIRST = ("model", "ts", "version", "entrypoint", "sidechain", "after_tool_result", "cache_split")


def request_key(message_id: Column, request_id: Column) -> Column:
    """Null without a message id; a missing request id counts as empty."""
    return F.when(F.length(message_id) > 0, F.concat_ws("|", message_id, F.coalesce(request_id, F.lit(""))))


def merge_lines(lines: DataFrame) -> DataFrame:
    """One row per request of a file: the greatest of each usage field, all else from its first line.

    Lines without a key are requests of their own. Lines are combined before they are shuffled by request, so a giant
    file spreads over many tasks; requests, which are fewer, are then numbered by file.
    """
    unit = F.coalesce(F.concat(F.lit("k"), F.col("request_key")), F.concat(F.lit("n"), F.col("line_no").cast("string")))
    firsts = [c for c in FIRST if c in lines.columns]
    merged = (
        lines.withColumn("unit", unit)
        .groupBy("file_id", "unit")
        .agg(
            F.min("line_no").alias("first_line"),
            F.first("request_key").alias("request_key"),
            *[F.max(c).alias(c) for c in USAGE],
            F.min_by(F.struct(*firsts), "line_no").alias("f"),
            F.bool_and("missing_usage").alias("missing_usage"),
        )
    )
    turn = F.row_number().over(W.partitionBy("file_id").orderBy("first_line")) - 1
    return merged.select("file_id", turn.alias("turn_idx"), "first_line", "request_key", *USAGE, "missing_usage", *[F.col(f"f.{c}").alias(c) for c in firsts])


def sessions_of(requests: DataFrame) -> DataFrame:
    """Per file: first and last request time, number of requests."""
    return requests.groupBy("file_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n_turns"))


def own_requests(requests: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Cross-session deduplication: of the copies of a request, the earliest session's first one stays.

    Sessions go by start, end (unknown ones last), number of requests and file; without ``sessions`` these follow from the
    requests, in windows over the partitioning in which turns were numbered. The request kept has the
    greatest of each usage field over all copies. A key that a third of all rows share is combined within each task first.
    Rows without a key all stay: each has a key of its own. Turns are numbered anew.
    """
    if sessions is None:
        file = W.partitionBy("file_id")
        placed = requests.withColumns({"started_at": F.min("ts").over(file), "ended_at": F.max("ts").over(file), "n_turns": F.count(F.lit(1)).over(file)})
    else:
        placed = requests.join(sessions.select("file_id", "started_at", "ended_at", "n_turns"), "file_id")
    rank = F.struct(
        F.col("started_at").isNull().alias("a"), "started_at", F.col("ended_at").isNull().alias("b"), "ended_at", "n_turns", "file_id", "turn_idx"
    )
    alone = F.struct(F.col("file_id").cast("string").alias("f"), F.col("turn_idx").cast("long").alias("t"))
    placed = placed.withColumn("_key", F.struct(F.col("request_key").alias("k"), F.when(F.col("request_key").isNull(), alone).alias("alone")))
    # the kept row goes through the aggregation whole, so nothing is joined back; equal keys are combined before the shuffle
    best = placed.groupBy("_key").agg(F.min_by(F.struct(*requests.columns), rank).alias("r"), *[F.max(c).alias(f"top_{c}") for c in USAGE])
    kept = best.select(*[F.col(f"top_{c}" if c in USAGE else f"r.{c}").alias(c) for c in requests.columns])
    some = sum((F.col(c) for c in USAGE[:4]), F.lit(0)) > 0
    kept = kept.withColumn("missing_usage", F.col("missing_usage") & ~some)
    return kept.withColumn("turn_idx", F.row_number().over(W.partitionBy("file_id").orderBy("turn_idx")) - 1)


def dropped_requests(requests: DataFrame, kept: DataFrame) -> DataFrame:
    """Per file, how many of its requests belong to another session."""
    a = requests.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_all"))
    b = kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_kept"))
    return a.join(b, "file_id", "left").select("file_id", "n_all", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), (F.col("n_all") - F.coalesce("n_kept", F.lit(0))).alias("n_copied"))


def prior_reads(calls: DataFrame, kept: DataFrame) -> DataFrame:
    """(file_id, path) that a file's dropped copies had read: calls (file_id, turn_key, path) without a kept request."""
    return calls.join(kept.select("file_id", F.col("request_key").alias("turn_key")), ["file_id", "turn_key"], "left_anti").select("file_id", "path").distinct()


def primary_model(requests: DataFrame) -> DataFrame:
    """file_id, primary_model (most requests, ties to the first seen), models (sorted)."""
    by = requests.filter("model is not null").groupBy("file_id", "model").agg(F.count(F.lit(1)).alias("n"), F.min("turn_idx").alias("first"))
    return by.groupBy("file_id").agg(F.max_by("model", F.struct("n", -F.col("first"))).alias("primary_model"), F.array_sort(F.collect_set("model")).alias("models"))


def _linked(edges: DataFrame, large: bool) -> DataFrame:
    """One half round: each node's neighbours above it (large), or the lower ones (small), are tied to the least of them and it."""
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))) if large else edges
    least = both.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("m")).select("node", F.least("node", "m").alias("m"))
    met = both.join(least, both["high"] == least["node"])
    if large:
        out = met.filter("low > node").select(F.col("low").alias("high"), F.col("m").alias("low"))
    else:
        out = met.select(F.col("low").alias("high"), F.col("m").alias("low")).unionByName(least.select(F.col("node").alias("high"), F.col("m").alias("low")))
    return out.filter("high <> low").distinct()


def families(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, family): connected components of lineage links (id, other); family is the least id.

    A half round ties each node to the least of its neighbours, first among larger, then among smaller ones, until every
    node hangs on its family's least: a number of rounds that grows as the logarithm of the longest chain. Each is written to
    the checkpoint folder; links that have not settled after ``rounds`` raise an error.
    """
    edges = edges.filter("id <> other").select(F.greatest("id", "other").alias("high"), F.least("id", "other").alias("low")).distinct()
    before = None
    for _ in range(rounds):
        edges = written(_linked(_linked(edges, True), False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"families did not settle in {rounds} rounds")
    return edges.select(F.col("high").alias("id"), F.col("low").alias("family")).unionByName(edges.select(F.col("low").alias("id"), F.col("low").alias("family")).distinct())
