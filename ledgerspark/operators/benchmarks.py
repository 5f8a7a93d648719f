"""Paired benchmark runs: savings per task, over the suite, and of live runs by condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import round_half_up

PARTS = ("manifest", "output", "reads")


def saved(tasks: DataFrame) -> DataFrame:
    """tasks: task, base_x and opt_x for x of total, cache_write, output, dup_reads, usd -> savings and what they come from.

    The three parts are scaled to the whole saving; what rounding leaves goes to the largest, the earlier of equals.
    """
    out = tasks.withColumn("saved_tokens", F.greatest(F.lit(0), F.col("base_total") - F.col("opt_total")))
    pct = F.when(F.col("base_total") > 0, (F.col("base_total") - F.col("opt_total")) / F.col("base_total") * 100).otherwise(F.lit(0.0))
    out = out.withColumn("saved_pct", round_half_up(pct, 1)).withColumn("saved_usd", F.col("base_usd") - F.col("opt_usd"))
    raw = [F.greatest(F.lit(0), F.col(f"base_{x}") - F.col(f"opt_{x}")) for x in ("cache_write", "output", "dup_reads")]
    total = raw[0] + raw[1] + raw[2]
    scale = F.when(F.col("saved_tokens") > 0, F.col("saved_tokens") / total).otherwise(F.lit(1.0))
    for name, x in zip(PARTS, raw, strict=True):
        out = out.withColumn(name, F.when(total == 0, F.lit(0)).otherwise(F.floor(x * scale + 0.5)).cast("long"))
    a, b, c = map(F.col, PARTS)
    drift = F.when((total > 0) & (F.col("saved_tokens") > 0), F.col("saved_tokens") - (a + b + c)).otherwise(F.lit(0))
    first = (a >= b) & (a >= c)
    out = out.withColumn("_to", F.when(first, "manifest").when(b >= c, "output").otherwise("reads")).withColumn("_drift", drift)
    return out.withColumns({p: F.col(p) + F.when(F.col("_to") == p, F.col("_drift")).otherwise(F.lit(0)) for p in PARTS}).drop("_to", "_drift")


def suite(done: DataFrame) -> DataFrame:
    """One row over the tasks of saved()."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_parts = zero(F.sum(F.col(PARTS[0]) + F.col(PARTS[1]) + F.col(PARTS[2])))
    share = lambda p: F.when(all_parts > 0, round_half_up(zero(F.sum(p)) / all_parts * 100, 1)).otherwise(F.lit(0.0))
    return done.agg(
        F.count(F.lit(1)).alias("tasks"),
        *[round_half_up(zero(f("saved_pct")), 1).alias(f"{name}_saved_pct") for name, f in (("median", F.median), ("mean", F.avg), ("min", F.min), ("max", F.max))],
        zero(F.sum("base_total")).alias("base_total"), zero(F.sum("opt_total")).alias("opt_total"), F.greatest(F.lit(0), zero(F.sum("base_total") - F.sum("opt_total"))).alias("saved_tokens"),
        zero(F.sum("saved_usd")).alias("saved_usd"), *[zero(F.sum(p)).alias(p) for p in PARTS], *[share(p).alias(f"{p}_pct") for p in PARTS],
    )


def live(rows: DataFrame, base: str = "off", others: tuple[str, ...] = ("on", "rtk")) -> DataFrame:
    """rows: task, condition, total_tokens, usd -> per task the runs and medians of each condition, and what others save."""
    of: dict[str, Column] = {}
    for c in (base, *others):
        here = F.col("condition") == c
        of |= {f"{c}_runs": F.count_if(here), f"{c}_tokens": F.median(F.when(here, F.col("total_tokens"))), f"{c}_usd": F.median(F.when(here, F.col("usd")))}
    out = rows.filter("total_tokens > 0").groupBy("task").agg(*[x.alias(k) for k, x in of.items()])
    b = F.col(f"{base}_tokens")
    saved = {f"{c}_saved_pct": F.coalesce(F.floor((b - F.col(f"{c}_tokens")) / b * 100 + 0.5), F.lit(0)).cast("long") for c in others}
    return out.withColumns(saved)
