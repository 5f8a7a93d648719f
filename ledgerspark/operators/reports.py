"""Period reports over session summaries: file_id, project, started_at (timestamp), usd, total_tokens, output, ...

Each is a DataFrame with one row for each line of the report. Calendars come from sequence(), so empty days
are rows too; medians and slopes follow the definitions of the reports, not those of the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import days_between, days_left_in_month, median_of, percent_change, ratio_pct, round_half_up

DAY = "INTERVAL 1 DAY"
MOST_DAYS = 366


# -- windows ---------------------------------------------------------------------------------------------


def parse_since(text: str, today: Column, earliest: Column) -> tuple[Column, Column]:
    """Half-open [since, until) in days for ``Nd`` (today included), ``all`` or a date; until is tomorrow."""
    until = F.date_add(today, 1)
    if text == "all":
        return earliest, until
    if text[-1:] == "d" and text[:-1].isdigit():
        n = int(text[:-1])
        if not 1 <= n <= 36500:
            raise ValueError(f"days must be 1 to 36500: {text}")
        return F.date_sub(today, n - 1), until
    return F.to_date(F.lit(text)), until


def trend_days(text: str) -> int:
    """Length of a trend window ``Nd``, ``Nw`` or ``Nm`` in days; both ends count, so N + 1 days are shown."""
    unit = {"d": 1, "w": 7, "m": 30}[text[-1]]
    return int(text[:-1]) * unit


def trend_window(text: str, today: Column) -> tuple[Column, Column]:
    """First and last day of a trend window."""
    return F.date_sub(today, trend_days(text)), today


def in_window(sessions: DataFrame, since: Column, until: Column) -> DataFrame:
    return sessions.filter((F.col("started_at") >= since) & (F.col("started_at") < until))


# -- stats -----------------------------------------------------------------------------------------------


def window_totals(sessions: DataFrame) -> DataFrame:
    out = sessions.agg(F.count(F.lit(1)).alias("sessions"), *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write", "total_tokens")], F.sum("usd").alias("usd"))
    return out.withColumn("output_ratio_pct", ratio_pct(F.col("output"), F.col("total_tokens")))


def dominant_model(sessions: DataFrame) -> DataFrame:
    """Model of most sessions; of equals the one seen first, newest session first."""
    by = sessions.filter("primary_model is not null").groupBy("primary_model").agg(F.count(F.lit(1)).alias("sessions"), F.max(F.struct("started_at", "file_id")).alias("newest"))
    return by.orderBy(F.desc("sessions"), F.desc("newest")).limit(1).select("primary_model", "sessions")


def by_project(sessions: DataFrame) -> DataFrame:
    """Sessions, tokens, dollars and share of dollars by project."""
    by = sessions.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.sum("total_tokens").alias("total_tokens"), F.sum("usd").alias("usd"))
    whole = F.sum("usd").over(W.partitionBy())  # over one row per project
    return by.withColumn("pct", ratio_pct(F.col("usd"), whole))


def rollup_costs(sessions: DataFrame, *keys: str) -> DataFrame:
    return sessions.rollup(*keys).agg(F.count(F.lit(1)).alias("sessions"), F.sum("total_tokens").alias("total_tokens"), F.grouping_id().alias("level"))


def dearest_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    if not 1 <= n <= 100:
        raise ValueError("1 to 100 sessions")
    return sessions.orderBy(F.desc("total_tokens"), F.desc("usd"), F.desc("started_at"), "file_id").limit(n)


def daily(sessions: DataFrame, first: Column | None = None, last: Column | None = None, most: int | None = MOST_DAYS) -> DataFrame:
    """Sessions, tokens and dollars by UTC day, empty days included; only the newest ``most`` days (None: all)."""
    by = sessions.groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("total_tokens").alias("total_tokens"), F.sum("usd").alias("usd"))
    span = by.agg((first if first is not None else F.min("day")).alias("a"), (last if last is not None else F.max("day")).alias("b"))
    if most is not None:
        span = span.withColumn("a", F.greatest(F.col("a"), F.date_sub("b", most - 1)))
    span = span.filter("b >= a")
    days = span.select(F.explode(F.sequence("a", "b", F.expr(DAY))).alias("day"))
    return days.join(by, "day", "left").fillna(0, ["sessions", "total_tokens", "usd"])


def savings(sessions: DataFrame, price: Column) -> DataFrame:
    """Recoverable dollars: duplicates and idle context at the cache-read rate, 30 % of writes at the write rate."""
    s = sessions.agg(F.sum("dup_tokens").alias("dup_tokens"), F.sum("idle_tokens").alias("idle_tokens"), F.sum("cache_write").alias("cache_write"))
    usd = lambda tokens, rate: tokens * price[rate] / 1_000_000
    s = s.withColumn("dup_usd", usd(F.col("dup_tokens"), "cache_read")).withColumn("idle_usd", usd(F.col("idle_tokens"), "cache_read"))
    s = s.withColumn("write_usd", usd(round_half_up(F.col("cache_write") * 0.3), "cache_write"))
    return s.withColumn("total_usd", F.col("dup_usd") + F.col("idle_usd") + F.col("write_usd"))


# -- trend -----------------------------------------------------------------------------------------------


#: Metrics of a trend, each the sum of one column over that of another (null: over sessions), and which way is better; statuses and bounds.
METRICS = {"output-ratio": ("output", "total_tokens", "up"), "cost-per-session": ("usd", None, "down"), "recoverable-tokens-per-session": ("dup_tokens", None, "down")}
TOO_FEW, STABLE, BETTER, WORSE = "insufficient-data", "stable", "improving", "regressing"
LEAST_DAYS, FLAT = 5, 0.001


def trend_series(sessions: DataFrame, metric: str, since: Column, until: Column) -> DataFrame:
    """day, sessions, numerator, denominator, value for every day from since to until, both included; days without sessions have zeros."""
    over, under, _ = METRICS[metric]
    by = sessions.groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("sessions"), F.sum(over).cast("double").alias("numerator"), (F.sum(under) if under else F.count(F.lit(1))).cast("double").alias("denominator"))
    days = sessions.sparkSession.range(1).select(F.explode(F.sequence(since, until, F.expr(DAY))).alias("day"))
    out = days.join(by, "day", "left").fillna(0, ["sessions", "numerator", "denominator"])
    return out.withColumn("value", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")).otherwise(F.lit(0.0)))


def trend(series: DataFrame, metric: str) -> DataFrame:
    """One row: metric, points (days with sessions), median, slope and verdict over these days of a trend_series().

    The slope's x is the ordinal of the day among the days with sessions, not its date.
    """
    some = series.filter("sessions > 0").withColumn("x", F.row_number().over(W.orderBy("day")) - 1)  # one row per day
    out = some.agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.median("value"), F.lit(0.0)).alias("median"), F.regr_slope("value", "x").alias("raw"))
    out = out.withColumn("slope", F.when(F.col("points") < LEAST_DAYS, F.lit(0.0)).otherwise(F.coalesce("raw", F.lit(0.0))))
    good = F.col("slope") > 0 if METRICS[metric][2] == "up" else F.col("slope") < 0
    verdict = F.when(F.col("points") < LEAST_DAYS, TOO_FEW).when(F.abs("slope") < FLAT, STABLE).when(good, BETTER).otherwise(WORSE)
    return out.select(F.lit(metric).alias("metric"), "points", "median", "slope", verdict.alias("verdict"))


def trends(sessions: DataFrame, since: Column, until: Column, metrics: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """trend() of each metric."""
    return reduce(DataFrame.unionByName, [trend(trend_series(sessions, m, since, until), m) for m in metrics])


def downsample(points: DataFrame, width: int) -> DataFrame:
    """points (i from 0, value) summed into ``width`` buckets; fewer points stay as they are."""
    n = F.count(F.lit(1)).over(W.partitionBy())  # one row per day
    bucket = F.when(n <= width, F.col("i")).otherwise(F.least(F.floor(F.col("i") / (n / F.lit(float(width)))), F.lit(width - 1))).cast("long")
    return points.withColumn("bucket", bucket).groupBy("bucket").agg(F.sum("value").alias("value"))


# -- today -----------------------------------------------------------------------------------------------


def baseline_tier(days_available: Column) -> Column:
    """Days of the baseline: the longest of 30, 14, 7, 3 that the history covers, else what there is."""
    return F.when(days_available >= 30, 30).when(days_available >= 14, 14).when(days_available >= 7, 7).when(days_available >= 3, 3).otherwise(F.lit(None).cast("int"))


def today_block(sessions: DataFrame, day: Column) -> DataFrame:
    some = sessions.filter(F.to_date("started_at") == day)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("usd", "total_tokens", "output")]
    out = some.agg(F.count(F.lit(1)).alias("sessions"), *sums)
    return out.withColumn("output_ratio_pct", F.when(F.col("total_tokens") > 0, F.col("output") / F.col("total_tokens") * 100).otherwise(F.lit(0.0)))


def today_top_leak(sessions: DataFrame, duplicates: DataFrame, day: Column) -> DataFrame:
    """At most one row: the file whose repeated reads cost a session of the day most; path, re_reads (all its reads but the first) and usd.

    duplicates: file_id, path, reads, wasted_tokens, usd (what the repeats cost): a session's dearest one stands for it. Of
    equals the first session by start and file is taken, and in it the first path.
    """
    own = sessions.filter(F.to_date("started_at") == day).select("file_id", "started_at")
    return duplicates.filter("reads > 1").join(own, "file_id").orderBy(F.desc("usd"), "started_at", "file_id", "path").limit(1).select("file_id", "path", (F.col("reads") - 1).alias("re_reads"), "usd")


def today_baseline(sessions: DataFrame, first: Column) -> DataFrame:
    """Medians over the days that have sessions: dollars, tokens, and the mean of the sessions' output ratios."""
    ratio = F.when(F.col("total_tokens") > 0, F.col("output") / F.col("total_tokens")).otherwise(F.lit(0.0))
    by = sessions.filter(F.to_date("started_at") >= first).groupBy(F.to_date("started_at").alias("day"))
    by = by.agg(F.sum("usd").alias("usd"), F.sum("total_tokens").alias("tokens"), (F.avg(ratio) * 100).alias("ratio"))
    zero = lambda c: F.coalesce(F.median(c), F.lit(0.0))
    return by.agg(F.count(F.lit(1)).alias("days"), zero("usd").alias("median_usd"), zero("tokens").alias("median_tokens"), zero("ratio").alias("median_output_ratio_pct"))


# The statuses of forecast and impact, their bounds in days and the factors of drift below are fixed values.

# -- forecast --------------------------------------------------------------------------------------------


def forecast(sessions: DataFrame, now: Column) -> DataFrame:
    """One row: status, trajectory over the last 14 or 7 rolling days, month-end projection with its band, last month.

    Status, in order: no-data, near-month-end, no-recent-activity, insufficient-data, ok; figures are null unless ok.
    """
    spans = sessions.agg(F.count(F.lit(1)).alias("n"), F.min("started_at").alias("first"), F.max("started_at").alias("last")).withColumn("now", now)
    spans = spans.withColumn("left", days_left_in_month(F.to_date("now"))).withColumn("available", F.floor((F.unix_micros("now") - F.unix_micros("first")) / 86_400_000_000))
    status = (
        F.when(F.col("n") == 0, "no-data").when(F.col("left") <= 1, "near-month-end").when(F.col("last") < F.col("now") - F.expr("INTERVAL 14 DAYS"), "no-recent-activity")
        .when(F.col("available") < 7, "insufficient-data").otherwise("ok")
    )
    spans = spans.withColumn("status", status).withColumn("window", F.when(F.col("available") >= 14, 14).otherwise(7))
    slots = spans.select(F.explode(F.sequence(F.lit(0), F.col("window") - 1)).alias("slot"))
    s = sessions.crossJoin(F.broadcast(spans.select("now", "window")))  # one row
    at = (F.unix_micros("started_at") - F.unix_micros("now")) / 86_400_000_000 + F.col("window")
    by = s.filter(at >= 0).groupBy(F.least(F.floor(at).cast("int"), F.col("window") - 1).alias("slot")).agg(F.sum("usd").alias("usd"), F.count(F.lit(1)).alias("n_slot"))
    per = slots.join(by, "slot", "left").fillna(0, ["usd", "n_slot"])
    path = per.agg(F.avg("usd").alias("avg_usd"), F.median("usd").alias("median_usd"), F.coalesce(F.stddev_samp("usd"), F.lit(0.0)).alias("sigma"), F.sum("n_slot").alias("sampled"))
    month = F.trunc(F.to_date("now"), "MM")
    this = F.to_date("started_at") >= month
    prior = (F.to_date("started_at") >= F.add_months(month, -1)) & ~this
    months = s.agg(F.coalesce(F.sum(F.when(this, F.col("usd"))), F.lit(0.0)).alias("so_far"), F.sum(F.when(prior, F.col("usd"))).alias("last_month"))
    out = spans.crossJoin(path).crossJoin(months)  # one row each
    projected = F.col("so_far") + F.col("avg_usd") * F.col("left")
    out = out.withColumn("projected", projected)
    band = F.greatest(F.lit(0.0), F.least(F.col("sigma") * F.col("left"), F.greatest(F.lit(0.0), F.col("projected") * 0.2)))
    out = out.withColumn("low", F.greatest(F.lit(0.0), F.col("projected") - band)).withColumn("high", F.col("projected") + band)
    out = out.withColumn("vs_last_month_pct", F.when(F.col("last_month").isNotNull(), F.when(F.col("last_month") > 0, (F.col("projected") - F.col("last_month")) / F.col("last_month") * 100).otherwise(F.lit(0.0))))
    ok = F.col("status") == "ok"
    cols = ("window", "sampled", "avg_usd", "median_usd", "so_far", "projected", "low", "high", "last_month", "vs_last_month_pct")
    return out.select("status", "left", *[F.when(ok, F.col(c)).alias(c) for c in cols])


# -- impact ----------------------------------------------------------------------------------------------


def impact(sessions: DataFrame, pivot: Column, now: Column, min_post_days: int = 3) -> DataFrame:
    """One row: sums before and after a date, their differences (null unless measured) and a status."""
    after = F.col("started_at") >= F.col("pivot")
    s = sessions.withColumn("pivot", pivot)
    lost = F.col("dup_tokens") + F.col("idle_tokens") + F.col("cache_write")

    def sums(name: str, when: Column) -> list[Column]:
        pick = lambda c: F.sum(F.when(when, c))
        zero = F.lit(0)
        return [
            F.count_if(when).alias(f"{name}_sessions"), F.coalesce(pick(F.col("total_tokens")), zero).alias(f"{name}_tokens"),
            F.coalesce(round_half_up(pick(F.col("usd")), 2), F.lit(0.0)).alias(f"{name}_usd"), F.coalesce(round_half_up(pick(F.col("usd")) / F.count_if(when), 2), F.lit(0.0)).alias(f"{name}_avg_usd"),
            F.coalesce(F.when(pick(F.col("total_tokens")) > 0, round_half_up(pick(F.col("output")) / pick(F.col("total_tokens")) * 100, 1)), F.lit(0.0)).alias(f"{name}_ratio"),
            F.coalesce(pick(lost), zero).alias(f"{name}_recoverable"),
        ]

    ms = lambda c: F.unix_micros(c) / 1000
    out = s.agg(*sums("before", ~after), *sums("after", after), F.min("started_at").alias("first"))
    out = out.withColumn("pivot", pivot).withColumn("now", now)
    out = out.withColumn("pre_days", F.when(F.col("before_sessions") > 0, days_between(ms(F.col("first")), ms(F.col("pivot")))).otherwise(0))
    out = out.withColumn("post_days", days_between(ms(F.col("pivot")), ms(F.col("now"))))
    status = (
        F.when(F.col("pivot").isNull(), "no-install-marker").when(F.col("post_days") < min_post_days, "insufficient-post-data")
        .when((F.col("before_sessions") == 0) & (F.col("after_sessions") == 0), "no-install-marker").when(F.col("before_sessions") == 0, "no-baseline")
        .when(F.col("after_sessions") == 0, "no-post-sessions").when((F.col("pre_days") > 0) & (F.col("post_days") / F.col("pre_days") < 0.25), "insufficient-post-data").otherwise("measured")
    )
    out = out.withColumn("status", status)
    measured = F.col("status") == "measured"
    change = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(round_half_up(a / F.col(b) * 100, 1))
    tokens, usd = F.col("after_tokens") - F.col("before_tokens"), round_half_up(F.col("after_usd") - F.col("before_usd"), 2)
    avg = round_half_up(F.col("after_avg_usd") - F.col("before_avg_usd"), 2)
    deltas = {
        "token_delta": tokens, "token_delta_pct": change(tokens, "before_tokens"), "usd_delta": usd, "usd_delta_pct": change(usd, "before_usd"),
        "avg_usd_delta": avg, "avg_usd_delta_pct": change(avg, "before_avg_usd"), "ratio_delta_pp": round_half_up(F.col("after_ratio") - F.col("before_ratio"), 1),
    }
    return out.select("status", "pre_days", "post_days", *[f"{n}_{c}" for n in ("before", "after") for c in ("sessions", "tokens", "usd", "avg_usd", "ratio", "recoverable")], *[F.when(measured, c).alias(k) for k, c in deltas.items()])


# -- drift -----------------------------------------------------------------------------------------------


def drift_metrics(sessions: DataFrame) -> DataFrame:
    cached = F.col("cache_read") + F.col("input") + F.col("cache_write")
    return sessions.select(
        "file_id", "project", "ended_at", F.when(F.col("n_requests") > 0, F.col("total_tokens") / F.col("n_requests")).otherwise(F.lit(0.0)).alias("tokens_per_turn"),
        F.when(cached > 0, F.col("cache_read") / cached).otherwise(F.lit(0.0)).alias("cache_hit_rate"), "dup_tokens",
    )


def earlier_anywhere(metrics: DataFrame, names: tuple[str, ...], keep: int) -> DataFrame:
    """metrics with ``before``: the newest ``keep`` sessions of any project before each one, as an array, oldest first.

    Within a day a window gives them; the days before give at most ``keep`` each, and ``keep`` days that have
    sessions are enough, so what is ordered over all days is one small row a day.
    """
    m = metrics.withColumn("day", F.to_date("ended_at")).withColumn("own", F.struct(*names))
    inside = W.partitionBy("day").orderBy("ended_at", "file_id")
    m = m.withColumn("same_day", F.collect_list("own").over(inside.rowsBetween(-keep, -1)))
    last = m.withColumn("n", F.row_number().over(W.partitionBy("day").orderBy(F.desc("ended_at"), F.desc("file_id")))).filter(F.col("n") <= keep)
    last = last.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), F.col("own").alias("own")))), lambda x: x["own"]).alias("own"))
    days = last.select("day", F.flatten(F.collect_list("own").over(W.orderBy("day").rowsBetween(-keep, -1))).alias("days_before"))
    both = m.join(days, "day", "left").withColumn("every", F.concat(F.coalesce("days_before", F.array().cast(m.schema["same_day"].dataType)), "same_day"))
    return both.withColumn("before", F.slice("every", F.greatest(F.size("every") - keep + 1, F.lit(1)), keep)).drop("day", "own", "same_day", "days_before", "every")


def drift(metrics: DataFrame, keep: int = 6, least: int = 3) -> DataFrame:
    """Each project's newest session against the medians of its ``keep`` sessions before, or of the ``keep`` before it anywhere if those are under ``least``."""
    newest = W.partitionBy("project").orderBy(F.desc("ended_at"), F.desc("file_id"))
    names = ("tokens_per_turn", "cache_hit_rate", "dup_tokens")
    m = earlier_anywhere(metrics, names, keep).withColumn("n", F.row_number().over(newest))
    own = m.filter((F.col("n") > 1) & (F.col("n") <= keep + 1)).groupBy("project").agg(F.count(F.lit(1)).alias("own_count"), *[F.median(c).alias(f"own_{c}") for c in names])
    j = m.filter("n = 1").join(own, "project", "left")
    mine = F.coalesce("own_count", F.lit(0)) >= least
    for c in names:
        j = j.withColumn(f"base_{c}", F.when(mine, F.col(f"own_{c}")).otherwise(median_of(F.transform("before", lambda x: x[c].cast("double")))))  # noqa: B023
    j = j.withColumn("base_count", F.when(mine, F.col("own_count")).otherwise(F.size("before").cast("long"))).withColumn("scope", F.when(mine, "project").otherwise("all"))
    enough = F.col("base_count") >= least
    return j.select(
        "project", "file_id", *names, "scope", "base_count", *[f"base_{c}" for c in names],
        (enough & (F.col("tokens_per_turn") > F.col("base_tokens_per_turn") * 1.3)).alias("context_up"),
        (enough & (F.col("base_cache_hit_rate") >= 0.2) & (F.col("cache_hit_rate") < F.col("base_cache_hit_rate") - 0.15)).alias("cache_down"),
        (enough & (F.col("dup_tokens") > F.col("base_dup_tokens") * 2) & (F.col("dup_tokens") > 5000)).alias("rereads_up"),
    )


def pressure(lines: DataFrame, window: int = 200_000) -> DataFrame:
    """Tokens in use after the last usage line of each file, its output included, and their band."""
    used = F.col("input") + F.col("cache_read") + F.col("cache_write") + F.col("output")
    last = lines.groupBy("file_id").agg(F.max_by(used, "line_no").alias("context"))
    share = F.col("context") / window
    return last.withColumn("share", share).withColumn("band", F.when(share >= 0.9, "p90").when(share >= 0.7, "p70").when(share >= 0.5, "p50").otherwise("none"))


def combined(sections: DataFrame) -> DataFrame:
    """Totals over agents, one line each and one for all."""
    return sections.rollup("agent").agg(F.sum("sessions").alias("sessions"), F.sum("total_tokens").alias("total_tokens"), F.sum("usd").alias("usd"))


def change_table(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison by key; a missing side counts as 0."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    out = a.join(b, key, "full_outer").fillna(0, ["before", "after"])
    return out.withColumn("delta", F.col("after") - F.col("before")).withColumn("pct", percent_change(F.col("after"), F.col("before")))
