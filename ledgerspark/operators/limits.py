"""Usage limits: periods of a limit window from its readings, and the requests that used them up.

readings: at, session_id, limit_id, plan_type, window_minutes, used_percent, resets_at (times in ms).
requests: at, session_id, cwd, model, tokens.

Whether a reading opens a period depends on the reset and the percent that its limit has reached, so periods are a fold in
time order, and what a stretch of readings does to later ones is all in that state. So readings are cut into segments of
``SEGMENT_MS``, and all segments are folded at once, each from the state it is believed to start in. What a segment does to
a state is summed up in one row: its greatest reset (a state far beyond it passes through), its first reading (which tells
whether it goes on with the period before), the reset it ends with and the greatest percent since it last opened a period.
Composing these rows in order of time gives every segment's start; segments that had been folded from another start are
folded again, until none is left. A reading that is accepted sets the reset whatever came before, so the second time is mostly
the last. Only the rows that sum up segments are ordered by limit; period numbers follow from sums over them.

All that follows is keyed by period. Requests meet periods through buckets of an hour, not a range join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import last_segment, median_of, round_half_up
from ..session import stored, written

EARLY_MS, MINUTE_MS, HOUR_MS, SEGMENT_MS = 15 * 60_000, 60_000, 3_600_000, 86_400_000
REVIEW_MODEL = "codex-auto-review"
KEY = ["limit_id", "window_minutes"]
SEGMENT = [*KEY, "segment"]
#: Accepted readings: nth within the segment, how many periods the segment has opened so far, the reading's own percent, and the state after it.
FOLDED = "limit_id string, window_minutes long, segment long, nth long, opened long, at long, percent double, used_percent double, resets_at long, plan_type string"
STARTS = "limit_id string, window_minutes long, segment long, start_reset long, start_used double, periods_before long"


def opens(minutes: int, at: int, percent: float, resets: int, reset: int | None, used: float) -> bool | None:
    """Whether a reading opens a period when the limit stands at (reset, used); null if it is passed over, as it tells of an earlier window."""
    if reset is None:
        return True
    later = resets - reset
    if later < -EARLY_MS:
        return None
    dropped = later > EARLY_MS and percent < used
    return at > reset or dropped or abs(later) > max(EARLY_MS, minutes * MINUTE_MS // 100)


def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Readings sorted by segment and time, each with its segment's first state (start_reset, start_used) -> FOLDED."""
    names = ("limit_id", "window_minutes", "segment", "at", "used_percent", "resets_at", "plan_type", "start_reset", "start_used")
    last, reset, used, nth, opened = None, None, 0.0, 0, 0
    for f in frames:
        out = []
        for limit, minutes, segment, at, percent, resets, plan, start, start_used in zip(*[f[n] for n in names], strict=True):
            if (limit, minutes, segment) != last:
                last, nth, opened = (limit, minutes, segment), 0, 0
                reset, used = (None, 0.0) if pd.isna(start) else (int(start), start_used)
            new = opens(minutes, at, percent, resets, reset, used)
            if new is None:
                continue
            reset, used = resets, percent if new else max(used, percent)
            nth, opened = nth + 1, opened + new
            out.append((limit, minutes, segment, nth, opened, at, percent, used, reset, plan))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in FOLDED.split(", ")])


def folded(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """FOLDED of the segments in starts."""
    some = rows.join(starts, SEGMENT)
    return some.repartition(*SEGMENT).sortWithinPartitions(*SEGMENT, "at", "resets_at", "used_percent", "session_id").mapInPandas(fold, FOLDED)


def composed(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
    """STARTS of a limit's segments, from the rows that sum them up. A segment that was folded from the start it gets here ends as it did; of others, the end is a forecast."""
    reset, used, before, out = None, 0.0, 0, []
    for x in f.sort_values("segment").itertuples(index=False):
        out.append((*key, x.segment, reset, used, before))
        none = pd.isna(x.end_reset)
        if (None if pd.isna(x.start_reset) else int(x.start_reset), x.start_used) == (reset, used):
            reset, used, before = (reset, used, before) if none else (int(x.end_reset), x.end_used, before + int(x.opened))
        elif not none and (reset is None or reset - x.most_reset <= EARLY_MS):
            goes_on = not x.later and opens(key[1], x.first_at, x.first_percent, x.first_reset, reset, used) is False
            reset, used, before = int(x.end_reset), max(used, x.own) if goes_on else x.own, before + int(x.opened)
    return pd.DataFrame(out, columns=[x.split()[0] for x in STARTS.split(", ")]).astype({"start_reset": "Int64"})


def summed_up(segments: DataFrame, starts: DataFrame, done: DataFrame) -> DataFrame:
    """A row for each segment: its first reading and greatest reset, the start from which it was last folded, and how it ended then."""
    last = W.partitionBy(*SEGMENT)
    own = done.withColumns({"all": F.max("opened").over(last), "first": F.min("opened").over(last)})
    ends = own.groupBy(*SEGMENT).agg(
        F.max_by("resets_at", "nth").alias("end_reset"), F.max_by("used_percent", "nth").alias("end_used"), F.max(F.when(F.col("opened") == F.col("all"), F.col("percent"))).alias("own"),
        F.max("opened").alias("opened"), (F.max("all") > F.max("first")).alias("later"),
    )
    return segments.join(starts.select(*SEGMENT, "start_reset", "start_used"), SEGMENT).join(ends, SEGMENT, "left")


def points(readings: DataFrame, segment_ms: int = SEGMENT_MS) -> DataFrame:
    """Accepted readings with their period, counted from 0, and the running greatest percent; those after their own reset are stale and go first."""
    rows = readings.filter("at <= resets_at").select("limit_id", F.col("window_minutes").cast("long"), F.floor(F.col("at") / segment_ms).alias("segment"), "at", F.col("used_percent").cast("double"), "resets_at", "plan_type", "session_id")
    rows = written(rows)
    first = F.min(F.struct("at", "resets_at", "used_percent"))
    segments = written(rows.groupBy(*SEGMENT).agg(F.max("resets_at").alias("most_reset"), first["at"].alias("first_at"), first["resets_at"].alias("first_reset"), first["used_percent"].alias("first_percent")))
    starts = segments.select(*SEGMENT, F.lit(None).cast("long").alias("start_reset"), F.lit(0.0).alias("start_used"))
    done = stored(folded(rows, starts))
    while True:
        now = stored(summed_up(segments, starts, done).groupBy(*KEY).applyInPandas(composed, STARTS))
        was = starts.select(*SEGMENT, F.struct("start_reset", "start_used").alias("was"))
        wrong = stored(now.join(was, SEGMENT).filter(~F.struct("start_reset", "start_used").eqNullSafe(F.col("was"))).drop("was", "periods_before"))
        if wrong.isEmpty():
            break
        done = stored(done.join(wrong.select(*SEGMENT), SEGMENT, "left_anti").unionByName(folded(rows, wrong)))
        starts = now
    period = (F.col("periods_before") + F.col("opened") - 1).cast("int").alias("period")
    return done.join(now.select(*SEGMENT, "periods_before"), SEGMENT).select(*KEY, period, "at", "used_percent", "resets_at", "plan_type")


def periods(pts: DataFrame) -> DataFrame:
    """One row per period: start (clamped to the first reading and the period before), reset, percent, newest reading."""
    p = pts.groupBy(*KEY, "period").agg(
        F.min("at").alias("first_at"), F.max("at").alias("newest_at"), F.max("used_percent").alias("used_percent"),
        F.max_by("resets_at", F.struct("at", "used_percent", "resets_at")).alias("resets_at"), F.max_by("plan_type", F.struct("at", "used_percent", "resets_at")).alias("plan_type"),
    )
    before = F.lag("newest_at").over(W.partitionBy(*KEY).orderBy("period"))
    start = F.greatest(F.least(F.col("resets_at") - F.col("window_minutes") * MINUTE_MS, F.col("first_at")), before)
    return p.withColumn("started_at", start).drop("first_at")


def in_periods(requests: DataFrame, pers: DataFrame) -> DataFrame:
    """requests with tokens in (start, newest reading] of each period; joined by the hour, so no nested loops and no key as large as a day."""
    hours = pers.withColumn("hour", F.explode(F.sequence(F.floor(F.col("started_at") / HOUR_MS), F.floor(F.col("newest_at") / HOUR_MS))))
    r = requests.filter("tokens > 0").withColumn("hour", F.floor(F.col("at") / HOUR_MS))
    met = r.join(hours.select(*KEY, "period", "hour", "started_at", "newest_at"), "hour")
    return met.filter((F.col("at") > F.col("started_at")) & (F.col("at") <= F.col("newest_at"))).drop("hour", "started_at", "newest_at")


def rises(pts: DataFrame) -> DataFrame:
    """Readings at which a period's percent went up, and by how much."""
    # equal times count together: only the last percent of a time can be a rise's end
    steps = pts.groupBy(*KEY, "period", "at").agg(F.max("used_percent").alias("used_percent"))
    before = F.lag("used_percent", 1, 0.0).over(W.partitionBy(*KEY, "period").orderBy("at"))
    return steps.withColumn("rise", F.col("used_percent") - before).filter("rise > 0").drop("used_percent")


def attribute(requests: DataFrame, pts: DataFrame) -> DataFrame:
    """Each request's share of the percent in its period: a rise is split over the requests since the rise before, by tokens."""
    pers = periods(pts)
    inside = in_periods(requests, pers)
    steps = rises(pts)
    names = ["session_id", "cwd", "model", "tokens"]
    line = inside.select(*KEY, "period", "at", *names, F.lit(None).cast("double").alias("rise"), F.lit(0).alias("order")).unionByName(
        steps.select(*KEY, "period", "at", *[F.lit(None).cast(inside.schema[c].dataType).alias(c) for c in names], "rise", F.lit(1).alias("order"))
    )
    # from the newest back, the last rise seen is the next one in time; a frame that ends at the period's end would be read anew for each request
    ahead = W.partitionBy(*KEY, "period").orderBy(F.desc("at"), F.desc("order")).rowsBetween(W.unboundedPreceding, 0)
    line = line.withColumn("to_at", F.last(F.when(F.col("order") == 1, F.col("at")), ignorenulls=True).over(ahead))
    line = line.withColumn("to_rise", F.last("rise", ignorenulls=True).over(ahead))
    whole = F.sum(F.when(F.col("order") == 0, F.col("tokens"))).over(W.partitionBy(*KEY, "period", "to_at"))
    share = F.when(F.col("to_at").isNotNull(), F.col("to_rise") * F.col("tokens") / whole).otherwise(F.lit(0.0))
    return line.withColumn("whole", whole).withColumn("percent", share).filter(F.col("order") == 0).drop("rise", "order", "to_at", "to_rise", "whole")


def unattributed(requests: DataFrame, pts: DataFrame) -> DataFrame:
    """Per period: percent that no request accounts for."""
    given = attribute(requests, pts).groupBy(*KEY, "period").agg(F.sum("percent").alias("given"))
    total = rises(pts).groupBy(*KEY, "period").agg(F.sum("rise").alias("total"))
    return total.join(given, [*KEY, "period"], "left").select(*KEY, "period", (F.col("total") - F.coalesce("given", F.lit(0.0))).alias("unattributed_percent"))


def usage_by_session(shares: DataFrame, include: Column | None = None) -> DataFrame:
    """Percent and tokens by session and period; automatic reviews are one line of their own."""
    s = shares if include is None else shares.filter(include)
    review = F.coalesce(F.col("model") == REVIEW_MODEL, F.lit(False))
    s = s.withColumn("line", F.when(review, F.lit("(automatic reviews)")).otherwise(F.col("session_id")))
    return s.groupBy(*KEY, "period", "line").agg(F.min(last_segment(F.col("cwd"))).alias("project"), F.sum("percent").alias("percent"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"))


def pace(pers: DataFrame, now: Column) -> DataFrame:
    """How the newest period of each window will end at its pace so far: kind and, where it runs out, when."""
    newest = pers.withColumn("n", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("period")))).filter("n = 1").drop("n")
    latest = F.greatest(now, F.col("newest_at"))
    elapsed = latest - F.col("started_at")
    at = latest + (F.lit(100.0) - F.col("used_percent")) * elapsed / F.when(F.col("used_percent") > 0, F.col("used_percent"))
    kind = (
        F.when(F.col("resets_at") <= now, "reset-since").when(F.col("used_percent") >= 100, "reached").when(elapsed < 3_600_000, "too-early")
        .when((F.col("used_percent") <= 0) | (at > F.col("resets_at")), "lasts").otherwise("runs-out")
    )
    return newest.withColumn("kind", kind).withColumn("runs_out_at", F.when(F.col("kind") == "runs-out", F.floor(at)))


def named_window(paces: DataFrame) -> DataFrame:
    """The window to show first: reached, else the earliest to run out, else the highest percent; of equals the shorter."""
    order = F.struct(
        F.when(F.col("kind") == "reached", 0).when(F.col("kind") == "runs-out", 1).otherwise(2).alias("a"), F.coalesce("runs_out_at", F.lit(0)).alias("b"),
        F.when(F.col("kind").isin("reached", "runs-out"), F.lit(0.0)).otherwise(-F.col("used_percent")).alias("c"), "window_minutes", "limit_id",
    )
    return paces.orderBy(order).limit(1)


def tokens_per_percent(pers: DataFrame, requests: DataFrame, as_of: Column, since: Column) -> DataFrame:
    """Finished periods with at least 20 % used, 90 % of it by one model: tokens per percent."""
    last = F.max("period").over(W.partitionBy(*KEY))
    done = pers.withColumn("last", last).filter(((F.col("period") < F.col("last")) | (F.col("resets_at") < as_of)) & (F.col("started_at") >= since) & (F.col("used_percent") >= 20))
    by = in_periods(requests, done).groupBy(*KEY, "period", "model").agg(F.sum("tokens").alias("t"), F.min("at").alias("first"))
    by = by.groupBy(*KEY, "period").agg(F.sum("t").alias("total"), F.max(F.when(F.col("model").isNotNull(), F.struct("t", -F.col("first"), "model"))).alias("top"))
    by = by.filter(F.col("top").isNotNull() & (F.col("top.t") / F.col("total") >= 0.9))
    out = done.join(by, [*KEY, "period"])
    return out.select(*KEY, "period", F.col("top.model").alias("model"), F.col("started_at").alias("period_start"), (F.col("total") / F.col("used_percent")).alias("tokens_per_percent"))


def possible_cuts(series: DataFrame) -> DataFrame:
    """Per window the first period with half or less of the median of two or more earlier ones of its model."""
    earlier = F.collect_list("tokens_per_percent").over(W.partitionBy(*KEY, "model").orderBy("period").rowsBetween(W.unboundedPreceding, -1))
    s = series.withColumn("earlier", earlier).withColumn("baseline", median_of(F.col("earlier")))
    hit = s.filter((F.size("earlier") >= 2) & (F.col("tokens_per_percent") <= F.col("baseline") * 0.5))
    hit = hit.withColumn("factor", round_half_up(F.col("baseline") / F.col("tokens_per_percent"), 1))
    first = F.row_number().over(W.partitionBy(*KEY).orderBy("period"))
    return hit.withColumn("n", first).filter("n = 1").drop("n", "earlier")
