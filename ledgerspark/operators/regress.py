"""Version regressions: detectors over request sequences, compared with all other versions.

rows: file_id, turn_idx, session, version, model, entry, side, ts (ms), inp, cr, cw, c5, c1, out, ctx, after_tool.
Sequences are windows by file; tables are one row per version, so what follows them is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import round_half_up, upper_median, version_in_range, version_parts

MIN_N = 20
#: Known regressions (id, checks, first and last affected version, fixed in).
KNOWN = (
    ("R1", ("uncached-input",), "2.1.257", "2.1.259", "2.1.260"),
    ("R2", ("warm-cache-miss",), "2.1.69", "2.1.89", "2.1.90"),
    ("R3", ("post-idle-cold", "warm-cache-miss"), "2.1.85", "2.1.100", "2.1.101"),
    ("R4", ("ttl-5m",), "2.1.0", "2.1.128", "2.1.129"),
    ("R5", ("hourly-rebuild",), "2.1.0", "2.1.247", "2.1.248"),
)


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, list(c), a, b, f) for i, c, a, b, f in KNOWN], "id string, checks array<string>, first string, last string, fixed string")


def sample_rows(requests: DataFrame) -> DataFrame:
    """requests -> rows: those with usage, a version and a real model."""
    r = requests.filter(~F.col("missing_usage") & F.col("version").isNotNull() & (F.coalesce("model", F.lit("")) != "<synthetic>"))
    five = F.when(F.col("cache_split"), F.greatest(F.lit(0), F.col("cache_write") - F.col("cache_write_1h"))).otherwise(0)
    return r.select(
        "file_id", "turn_idx", F.col("file_id").cast("string").alias("session"), "version", F.coalesce("model", F.lit("?")).alias("model"), F.col("entrypoint").alias("entry"), F.col("sidechain").alias("side"),
        F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("ts"), F.col("input").alias("inp"), F.col("cache_read").alias("cr"), F.col("cache_write").alias("cw"), five.alias("c5"),
        F.col("cache_write_1h").alias("c1"), F.col("output").alias("out"), (F.col("input") + F.col("cache_read") + F.col("cache_write")).alias("ctx"), F.col("after_tool_result").alias("after_tool"),
    )


def automated() -> Column:
    """Side conversations and programmatic use."""
    return F.coalesce(F.col("side"), F.lit(False)) | F.coalesce(F.col("entry").startswith("sdk"), F.lit(False))


def interactive(rows: DataFrame) -> DataFrame:
    return rows.filter(~automated())


def _order():
    return W.partitionBy("file_id").orderBy("ts", "turn_idx")


def rates(samples: DataFrame, least: int) -> DataFrame:
    """samples (version, value): rate by version with enough samples, against all samples of other versions."""
    by = samples.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.count_if("value").alias("hits"))
    every = W.partitionBy()  # one row per version
    rest = F.sum("n").over(every) - F.col("n")
    base = F.when(rest > 0, (F.sum("hits").over(every) - F.col("hits")) / rest).otherwise(F.lit(0.0))
    out = by.withColumn("rate", F.col("hits") / F.col("n")).withColumn("baseline", base).withColumn("baseline_n", rest)
    return out.filter(F.col("n") >= least).drop("hits")


def warm_cache_miss(rows: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Requests within five minutes of the one before, with a large context kept: how many read under 30 % of it from cache."""
    r = interactive(rows).withColumn("p_ts", F.lag("ts").over(_order())).withColumn("p_ctx", F.lag("ctx").over(_order()))
    gap = (F.col("ts") - F.col("p_ts")) / 60_000
    s = r.filter((gap >= 0) & (gap <= 5) & (F.col("ctx") >= 30_000) & (F.col("ctx") >= F.col("p_ctx") * 0.6)).select("version", (F.col("cr") < F.col("ctx") * 0.3).alias("value"))
    return rates(s, min_n).withColumn("flagged", (F.col("rate") >= 0.25) & (F.col("rate") >= 3 * F.greatest(F.col("baseline"), F.lit(0.01))))


def post_idle_cold(rows: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """After an hour idle, how often both next requests still read under 30 % from cache."""
    r = interactive(rows)
    for name, k in (("a", 1), ("b", 2)):
        for c in ("ts", "ctx", "cr"):
            r = r.withColumn(f"{name}_{c}", F.lead(c, k).over(_order()))
    r = r.withColumn("p_ts", F.lag("ts").over(_order()))
    near = ((F.col("a_ts") - F.col("ts")) / 60_000 <= 5) & ((F.col("b_ts") - F.col("a_ts")) / 60_000 <= 5) & (F.col("a_ctx") >= 30_000) & (F.col("b_ctx") >= 30_000)
    s = r.filter(((F.col("ts") - F.col("p_ts")) / 60_000 >= 60) & near)
    s = s.select("version", ((F.col("a_cr") < F.col("a_ctx") * 0.3) & (F.col("b_cr") < F.col("b_ctx") * 0.3)).alias("value"))
    return rates(s, max(5, min_n // 4)).withColumn("flagged", (F.col("rate") >= 0.5) & (F.col("rate") >= 3 * F.greatest(F.col("baseline"), F.lit(0.02))))


def short_ttl(rows: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Share of cache writes with the five-minute lifetime; the baseline weighs the other listed versions by requests."""
    by = interactive(rows).filter(F.col("c5") + F.col("c1") > 0).groupBy("version").agg(F.sum("c5").alias("c5"), F.sum("c1").alias("c1"), F.count(F.lit(1)).alias("n"))
    by = by.filter(F.col("n") >= min_n).withColumn("share_5m", F.col("c5") / (F.col("c5") + F.col("c1")))
    every = W.partitionBy()
    rest = F.sum("n").over(every) - F.col("n")
    base = F.when(rest > 0, (F.sum(F.col("share_5m") * F.col("n")).over(every) - F.col("share_5m") * F.col("n")) / rest).otherwise(F.lit(0.0))
    return by.withColumn("baseline", base).withColumn("flagged", (F.col("share_5m") >= 0.5) & (F.col("baseline") <= 0.2) & (rest >= min_n)).drop("c5", "c1")


def uncached_input(rows: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Upper median of uncached input after tool results by model and version, against its sibling versions' upper median."""
    g = interactive(rows).filter(F.coalesce(F.col("after_tool"), F.lit(False)) & (F.col("ctx") >= 20_000)).groupBy("model", "version").agg(F.count(F.lit(1)).alias("n"), upper_median(F.col("inp")).alias("median"))
    g = g.filter(F.col("n") >= max(5, min_n // 4))
    o = g.select(F.col("model").alias("m"), F.col("version").alias("v"), F.col("median").alias("other"))
    base = g.join(o, (g["model"] == o["m"]) & (g["version"] != o["v"])).groupBy("model", "version").agg(upper_median(F.col("other")).alias("baseline"))
    out = g.join(base, ["model", "version"], "left")
    return out.withColumn("flagged", (F.col("median") >= 500) & (F.col("baseline").isNull() | (F.col("baseline") < 100)))


def hourly_rebuild(rows: DataFrame) -> DataFrame:
    """Gaps between full cache rebuilds of a file, and how many last 50 to 70 minutes."""
    r = interactive(rows).withColumn("p_ts", F.lag("ts").over(_order())).withColumn("p_ctx", F.lag("ctx").over(_order()))
    e = r.filter(((F.col("ts") - F.col("p_ts")) / 60_000 <= 5) & (F.col("p_ctx") >= 50_000) & (F.col("ctx") >= F.col("p_ctx") * 0.6) & (F.col("cr") < F.col("p_ctx") * 0.2))
    gap = (F.col("ts") - F.lag("ts").over(_order())) / 60_000
    out = e.withColumn("gap", gap).groupBy("version").agg(F.count("gap").alias("n"), F.count_if((F.col("gap") >= 50) & (F.col("gap") <= 70)).alias("hourly"))
    return out.withColumn("flagged", (F.col("n") >= 4) & (F.col("hourly") * 2 >= F.col("n")))


def merge_ranges(table: DataFrame) -> DataFrame:
    """Flagged versions that are neighbours among a table's versions, as ranges: gaps and islands over one row per version."""
    v = table.groupBy("version").agg(F.bool_or("flagged").alias("flagged")).withColumn("parts", version_parts(F.col("version")))
    v = v.withColumn("i", F.row_number().over(W.orderBy("parts", "version"))).filter("flagged")
    v = v.withColumn("island", F.col("i") - F.row_number().over(W.orderBy("i")))
    return v.groupBy("island").agg(F.min_by("version", "i").alias("from"), F.max_by("version", "i").alias("to"), F.count(F.lit(1)).alias("versions")).drop("island")


def match_known(ranges: DataFrame, catalog: DataFrame, check: str) -> DataFrame:
    """Ranges with the known regressions of a check that overlap them; the catalog is a handful of rows."""
    k = F.broadcast(catalog.filter(F.array_contains("checks", check)))
    on = (version_parts(F.col("from")) <= version_parts(F.col("last"))) & (version_parts(F.col("to")) >= version_parts(F.col("first")))
    return ranges.join(k, on, "left").groupBy("from", "to", "versions").agg(F.array_sort(F.collect_set("id")).alias("known"))


def covered(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Known regressions whose versions the logs hold."""
    v = rows.select("version").distinct()
    return catalog.join(v, version_in_range(F.col("version"), F.col("first"), F.col("last")), "left_semi").select("id")


def coverage(rows: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """One row: interactive requests, those left out, files, versions, and whether two versions have enough."""
    auto = automated()
    per = rows.groupBy("version").agg(F.count_if(~auto).alias("n"))
    v = per.filter("n > 0").agg(F.count(F.lit(1)).alias("versions"), F.min_by("version", version_parts(F.col("version"))).alias("first_version"), F.max_by("version", version_parts(F.col("version"))).alias("last_version"), (F.count_if(F.col("n") >= min_n) >= 2).alias("comparable"))
    r = rows.agg(F.count_if(~auto).alias("requests"), F.count_if(auto).alias("excluded"), F.count_distinct(F.when(~auto, F.col("file_id"))).alias("sessions"))
    return r.crossJoin(v)  # one row each


def limit_burn(shares: DataFrame, least_work: int = 200_000) -> DataFrame:
    """Percent of a limit per million tokens of work by version, model, plan and window; flagged at twice its peers' upper median."""
    g = shares.groupBy("version", "model", "plan_type", "limit_id", "window_minutes").agg(F.sum("percent").alias("percent"), F.sum("work").alias("work"))
    g = g.filter(F.col("work") >= least_work).withColumn("burn", F.col("percent") / F.col("work") * 1_000_000)
    peer = g.select(F.col("version").alias("v"), F.col("model").alias("m"), F.col("plan_type").alias("p"), F.col("limit_id").alias("l"), F.col("window_minutes").alias("w"), F.col("burn").alias("b"))
    on = F.col("model").eqNullSafe(F.col("m")) & F.col("plan_type").eqNullSafe(F.col("p")) & (F.col("limit_id") == F.col("l")) & (F.col("window_minutes") == F.col("w")) & (F.col("version") != F.col("v"))
    base = g.join(peer, on).groupBy("version", "model", "plan_type", "limit_id", "window_minutes").agg(upper_median(F.col("b")).alias("baseline"))
    keys = ["version", "model", "plan_type", "limit_id", "window_minutes"]
    out = g.alias("g").join(base.alias("b"), [F.col(f"g.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select("g.*", "baseline")
    return out.withColumn("factor", round_half_up(F.col("burn") / F.col("baseline"), 1)).withColumn("flagged", F.coalesce(F.col("burn") >= 2 * F.col("baseline"), F.lit(False)))
