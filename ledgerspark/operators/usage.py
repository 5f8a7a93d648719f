"""From logs to the fact table of the reports: requests that a session owns, priced by its day, summed up; the latest session."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import project_name
from ..session import written
from ..sources.usage_cache import Logs
from .pricing import calendar, priced
from .requests import own_requests, prior_reads
from .summary import session_summary


def combined_logs(*logs: Logs) -> Logs:
    """Logs of several agents as one; columns that an agent lacks are null."""
    both = lambda name: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [getattr(x, name) for x in logs])
    return Logs(*[both(name) for name in ("lines", "requests", "calls", "sessions")])


def session_facts(logs: Logs, prices: DataFrame, aliases: DataFrame | None = None, undated: tuple[str, ...] = ()) -> DataFrame:
    """session_summary() of every session with usage, after requests copied from earlier sessions have gone.

    Logs are parsed once for each of their tables, which are written. Each session is priced by the tables that held on the day it began. Calls go with their requests; what
    the copies had read counts as read before.
    """
    logs = replace(logs, requests=written(logs.requests), calls=written(logs.calls), sessions=written(logs.sessions))
    own = written(own_requests(logs.requests.withColumn("turn_was", F.col("turn_idx"))))
    start = F.to_date(F.try_to_timestamp("started_at"))
    days = logs.sessions.select("file_id", F.coalesce(start, F.lit("9999-12-30").cast("date")).alias("day"))  # undated: the newest tables
    paid = priced(own.join(days, "file_id"), calendar(prices, undated), aliases, F.col("day"))
    turns = own.select("file_id", F.col("turn_was").alias("turn_idx"), F.col("turn_idx").alias("turn"))
    calls = logs.calls.join(turns, ["file_id", "turn_idx"]).drop("turn_idx").withColumnRenamed("turn", "turn_idx")
    dropped = logs.calls.filter("path is not null").select("file_id", F.col("turn_idx").alias("turn_key"), "path")
    prior = prior_reads(dropped, own.select("file_id", F.col("turn_was").alias("request_key")))
    hash_ = F.col("project_hash") if "project_hash" in logs.sessions.columns else F.lit(None).cast("string")
    s = logs.sessions.withColumn("project", project_name(F.col("cwd"), hash_)).drop("primary_model", "models", "n_turns")
    return session_summary(paid, s, calls, prior)


def latest(facts: DataFrame, prefix: str | None = None, subagents: bool = False) -> DataFrame:
    """The newest session by file time (ties to the greater file), of those that have usage and are no subagent's; or all whose id starts with ``prefix``.

    More than one row for a prefix means that it is ambiguous.
    """
    if prefix:
        return facts.filter(F.col("session_id").startswith(prefix))
    own = facts if subagents or "is_subagent" not in facts.columns else facts.filter(~F.coalesce("is_subagent", F.lit(False)))
    return own.orderBy(F.desc("mtime"), F.desc("file_id")).limit(1)


def newest_sessions(facts: DataFrame, n: int = 10, most: int = 50) -> DataFrame:
    """The newest ``n`` sessions, ``most`` at the utmost."""
    return facts.orderBy(F.desc("mtime"), F.desc("file_id")).limit(max(1, min(n, most)))


def active_sessions(files: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """One row: how many log files were written to in the last minutes; files: path, mtime."""
    return files.agg(F.count_if(F.col("mtime") >= now - F.make_dt_interval(mins=F.lit(minutes))).alias("active"))

