"""What a session has searched for, as of each file it reads, and how well the file's symbols match that."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Signals that count for a read, the longest texts that are tried as patterns, the least confidence, a search as a shell command.
NEWEST, LONGEST, LEAST = 200, 200, 0.7
SEARCH = r"""^\s*(?:grep|rg|ag)\s+(?:--?[a-zA-Z][a-zA-Z0-9-]*(?:=\S+)?\s+)*['"]?([^\s'"]+)['"]?"""
DAY = 86_400_000


def derived(calls: DataFrame) -> DataFrame:
    """calls (name, pattern, command, ...) that carry a search, with kind (grep-pattern or glob-pattern) and pattern."""
    tool, said = F.col("name"), F.nullif(F.col("pattern"), F.lit(""))
    searched = F.nullif(F.regexp_extract("command", SEARCH, 1), F.lit(""))
    pattern = F.when(tool.isin("Grep", "Glob"), said).when(tool == "Bash", searched)
    kind = F.when(tool == "Glob", "glob-pattern").otherwise("grep-pattern")
    return calls.withColumns({"kind": kind, "pattern": pattern}).filter("pattern is not null")


def seen(signals: DataFrame, reads: DataFrame) -> DataFrame:
    """Both (session, at, line) in one table with n: how many signals the session has up to a row, itself included.

    Signals before the day are counted by aggregation, those of the day by a window, so that no session is one window.
    Of signals of one moment the earlier line counts as the newer one.
    """
    mine = signals.select("session", "at", "line", "kind", "pattern", F.lit(False).alias("is_read"))
    rows = mine.unionByName(reads.select("session", "at", "read_id", F.lit(True).alias("is_read")), allowMissingColumns=True).withColumn("day", F.floor(F.col("at") / DAY))
    by_day = mine.groupBy("session", F.floor(F.col("at") / DAY).alias("from_day")).agg(F.count(F.lit(1)).alias("of_day"))
    upto = W.partitionBy("session").orderBy("from_day")
    spans = by_day.withColumns({"upto": F.sum("of_day").over(upto), "next_day": F.lead("from_day").over(upto)})
    days = rows.select("session", "day").distinct()
    # the last day with signals before each day: a union in order of day, carried on; a row a session and day
    marks = days.select("session", "day", F.lit(None).cast("long").alias("sum")).unionByName(spans.select("session", (F.col("from_day") + 1).alias("day"), F.col("upto").alias("sum")))
    carry = W.partitionBy("session").orderBy("day").rangeBetween(W.unboundedPreceding, 0)
    before = marks.withColumn("before", F.coalesce(F.max("sum").over(carry), F.lit(0))).filter("sum is null").select("session", "day", "before")
    inside = W.partitionBy("session", "day").orderBy("at", "is_read", F.desc("line")).rowsBetween(W.unboundedPreceding, 0)
    counted = rows.withColumn("inside", F.count_if(~F.col("is_read")).over(inside))
    return counted.join(before, ["session", "day"]).withColumn("n", F.col("before") + F.col("inside")).drop("before", "inside", "day")


def as_of(signals: DataFrame, reads: DataFrame, newest: int = NEWEST) -> DataFrame:
    """read_id, n (greater: newer), pattern: the grep patterns among the newest signals of the session at or before each read.

    Signals are numbered and packed into blocks of ``newest``; a read needs its own block and the one before: an equi-join with two rows a read.
    """
    rows = seen(signals, reads)
    block = lambda c: F.floor((c - 1) / newest)
    blocks = rows.filter(~F.col("is_read")).groupBy("session", block(F.col("n")).alias("block")).agg(F.collect_list(F.when(F.col("kind") == "grep-pattern", F.struct("n", "pattern"))).alias("packed"))
    asked = rows.filter("is_read and n > 0").select("session", "read_id", F.col("n").alias("upto"))
    asked = asked.withColumn("block", F.explode(F.array(block(F.col("upto")), block(F.col("upto")) - 1))).filter("block >= 0")
    got = asked.join(blocks, ["session", "block"]).select("read_id", "upto", F.explode("packed").alias("s"))
    return got.filter((F.col("s.n") <= F.col("upto")) & (F.col("s.n") > F.col("upto") - newest)).select("read_id", "s.n", "s.pattern")


@lru_cache(4096)
def compiled(pattern: str):
    try:
        return re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return None


@F.pandas_udf(BooleanType())
def fits(symbol: pd.Series, pattern: pd.Series) -> pd.Series:
    """Whether a pattern that a user wrote is found in a symbol; patterns that don't compile are found nowhere."""
    return pd.Series([bool(p is not None and (c := compiled(p)) and c.search(s)) for s, p in zip(symbol, pattern, strict=True)])


def confidence(symbol: Column, pattern: Column) -> Column:
    """How well a symbol fits what was searched for, but for patterns: 1 the same, then other case, one within the other, one of its words."""
    s, p = F.lower(symbol), F.lower(pattern)
    ratio = F.least(F.length(s), F.length(p)) / F.greatest(F.length(s), F.length(p))
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(symbol, "([a-z])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")), r"[_\-]+")
    within = F.contains(s, p) | F.contains(p, s)
    return F.when((symbol == "") | (pattern == ""), 0.0).when(symbol == pattern, 1.0).when(s == p, 0.95).when(within, 0.7 + 0.1 * ratio).when(F.array_contains(words, p), 0.7).otherwise(0.0)


def scored(read_symbols: DataFrame, patterns: DataFrame) -> DataFrame:
    """read_id, symbol, confidence, pattern: each symbol of a read (read_id, symbol) and the best, then newest, of the read's patterns (as_of()).

    Each distinct pair of symbol and pattern is scored once; only those that fit in no other way are tried as patterns.
    """
    met = read_symbols.distinct().join(patterns, "read_id")
    pairs = met.select("symbol", "pattern").distinct().withColumn("plain", confidence(F.col("symbol"), F.col("pattern")))
    tried = (F.col("plain") == 0) & (F.length("pattern") <= LONGEST) & (F.length("symbol") <= LONGEST)
    found = pairs.withColumn("fits", fits("symbol", F.when(tried, F.col("pattern"))))
    known = found.select("symbol", "pattern", F.when(F.col("fits") & (F.col("symbol") != "") & (F.col("pattern") != ""), 0.7).otherwise(F.col("plain")).alias("c"))
    best = met.join(known, ["symbol", "pattern"]).filter("c > 0").groupBy("read_id", "symbol").agg(F.max(F.struct("c", "n", "pattern")).alias("b"))
    out = read_symbols.distinct().join(best, ["read_id", "symbol"], "left")
    return out.select("read_id", "symbol", F.coalesce("b.c", F.lit(0.0)).alias("confidence"), F.col("b.pattern").alias("pattern"))


def relevant(rows: DataFrame, least: float = LEAST) -> DataFrame:
    return rows.filter(F.col("confidence") >= least)
