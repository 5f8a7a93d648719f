"""URL rules by a sort-merge range join.

A host is written with its labels reversed, each closed by U+0001 (``net`` ``example`` -> ``net\\1example\\1``),
then U+0002 and the path. A rule for a host and all its subdomains is then an interval of keys: all that
start with its own labels. Keys and rules are dealt into key ranges by splitters taken from a bounded sample
(as a range partitioner does), rules into every range that their interval meets; each range is sorted, and
one sweep keeps a stack of the nested rules that are open at the current key. The longest open rule whose
path starts the URL's path gives the verdict; else the verdict is ``default``.

Splitters hold the page id too, so one host with a third of all pages spreads over many ranges.

Defined results: a null URL or one without ``://`` has an empty host and path, meets no rule and gets the
default verdict; repeated rows and ids each get their own row; of two fitting rules of equal length the one
with the longer host wins; of rules with the same text, block wins; no pages or no rules give no crash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, partitions

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Splitters are chosen from so many sampled keys for each range.
SAMPLE = 40


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by U+0001."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01")))


def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of key ranges -> pages with their rule. A rule row comes before the keys in its interval."""
    stack: list[tuple[str, str, str, str]] = []
    at = None
    for f in frames:
        out = []
        for rng, key, is_rule, page_id, host, path, kind in zip(f["rng"], f["key"], f["is_rule"], f["page_id"], f["host"], f["path"], f["kind"], strict=True):
            if rng != at:
                stack, at = [], rng
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if is_rule:
                stack.append((key, host, path, kind))
                continue
            best = None
            for _, h, p, v in stack:
                if path.startswith(p):
                    rank = (len(h) + len(p), len(h), v == "block")
                    if best is None or rank > best[0]:
                        best = (rank, h + p, v)
            out.append((page_id, host, path, best and best[1], best and best[2]))
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "found"])


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url); rules: host, path, kind."""
    spark = pages.sparkSession
    n = ranges or 4 * partitions(spark)
    host, path = host_and_path(F.col("url"))
    keyed = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    keyed = cut(keyed.withColumn("key", F.concat(host_key(F.col("host")), F.lit("\x02"), F.col("path"), F.lit("\x02"), F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"))))
    rows = keyed.count()
    share = min(1.0, 4 * n * SAMPLE / max(rows, 1))
    sampled = sorted(r[0] for r in keyed.select("key").sample(share, seed=7).orderBy(F.xxhash64("key")).limit(n * SAMPLE).collect())
    splitters = sorted({sampled[i] for i in range(SAMPLE, len(sampled), SAMPLE)})
    shared = spark.sparkContext.broadcast(splitters)  # n strings

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(shared.value, k)).astype("int32")

    known = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "kind").filter("host is not null").withColumn("key", host_key(F.col("host")))
    spread = known.withColumn("rng", F.explode(F.sequence(range_of("key"), range_of(F.concat("key", F.lit("\U0010ffff"))))))
    nothing = F.lit(None)
    events = keyed.withColumn("rng", range_of("key")).select("rng", "key", F.lit(False).alias("is_rule"), "page_id", "host", "path", nothing.cast("string").alias("kind")).unionByName(
        spread.select("rng", "key", F.lit(True).alias("is_rule"), nothing.cast("long").alias("page_id"), "host", "path", "kind")
    )
    events = events.repartition(n, "rng").sortWithinPartitions("rng", "key", F.col("is_rule").desc())
    found = events.mapInPandas(sweep, "page_id long, host string, path string, rule string, found string")
    return found.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, kind string")
