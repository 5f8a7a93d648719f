"""Values worked out by hand, not from the queries' SQL: reads and edits, replays, pressure, drift, prices, families, logs to sessions."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import analyzers, limits, pricing, regress, reports, requests, stores, usage
from ledgerspark.sources import assistant_logs, rollouts
from ledgerspark.streaming import live

from .test_sources import EDIT, READ, assistant, counted, rollout, user, write
from .test_sources import usage as tokens
from .test_streaming_stores import run

CALLS = "file_id string, turn_idx long, call_idx long, name string, path string, raw_path string, result_tokens long, pattern string, command string"


def calls(spark, *rows):
    return spark.createDataFrame([("s", t, k, n, p, p, tok, pat, cmd) for k, (t, n, p, tok, pat, cmd) in enumerate(rows)], CALLS)


def test_only_reading_tools_read(spark):
    c = calls(spark, (0, "Read", "/a", 10, None, None), (1, "NotebookRead", "/a", 10, None, None), (2, "Read", "/a", 7, None, None), (3, "read_file", "/b", 5, None, None))
    got = {r.path: (r.reads, r.wasted_tokens) for r in analyzers.duplicate_reads(c).collect()}
    assert got == {"/a": (2, 7), "/b": (1, 0)}
    prior = spark.createDataFrame([("s", "/b")], "file_id string, path string")
    assert {r.path: (r.reads, r.wasted_tokens) for r in analyzers.duplicate_reads(c, prior).collect()}["/b"] == (2, 5)
    assert [r.path for r in analyzers.top_files(analyzers.duplicate_reads(c), "wasted_tokens").collect()] == ["/a"]


def test_paths_come_from_each_tools_own_field(spark):
    from ledgerspark.functions.core import read_path

    rows = [("Read", '{"file_path": "/a", "path": "/z"}'), ("read_file", '{"file_path": "/z", "path": "/b"}'), ("Read", '{"path": "/z"}'), ("NotebookEdit", '{"notebook_path": "/z"}'), ("Grep", '{"path": "/z"}'), ("Edit", '{"file_path": ""}')]
    df = spark.createDataFrame(rows, "name string, v string")
    assert [r[0] for r in df.select(read_path(F.col("name"), F.try_parse_json("v"))).collect()] == ["/a", "/b", None, None, None, None]


def test_idle_files_that_cost_nothing_are_idle_too(spark):
    c = calls(spark, (0, "Read", "/a", 1200, None, None), (0, "Read", "/b", 0, None, None), (0, "Edit", "/c", 3, None, None), (1, "Read", "/d", 9, None, None))
    r = spark.createDataFrame([("s", t) for t in range(6)], "file_id string, turn_idx long")
    assert sorted((x.path, x.idle_turns, x.idle_tokens) for x in analyzers.idle_context(c, r).collect()) == [("/a", 5, 1200), ("/b", 5, 0)]


def test_savings_of_edits_count_each_call(spark):
    c = calls(spark, (0, "Edit", "/a", 1, None, None), (0, "Write", "/b", 1, None, None), (1, "MultiEdit", "/a", 1, None, None), (1, "NotebookEdit", "/a", 1, None, None))
    r = spark.createDataFrame([("s", 0, 100), ("s", 1, 1000)], "file_id string, turn_idx long, output long")
    sums = spark.createDataFrame([("s", 10_000, 1100, 50)], "file_id string, input long, output long, cache_write long")
    got = analyzers.recoverable(sums, analyzers.duplicate_reads(c), c, r).first()
    assert (got.manifest, got.read_once, got.diff_output, got.total) == (11, 0, 170, 181)


def test_replay(spark):
    rows = [
        (0, "Read", "/x.py", 1, None, None, 0), (1, "Glob", None, 1, "*.py", None, 1500), (2, "Read", "/y.py", 1, None, None, 0), (3, "Grep", None, 1, "", None, 0), (4, "Read", "/z.py", 1, None, None, 0),
        (5, "Bash", None, 1, None, "  rg needle", 1500), (6, "Read", "/n.md", 1, None, None, 0), (7, "Read", "/v.TSX", 1, None, None, 3000), (8, "Read", "/v.TSX", 1, None, None, 2000), (9, "Read", "/x.py", 1, None, None, 2000), (10, "Bash", None, 1, None, "ls | grep x", 0),
    ]
    got = [r.saved for r in analyzers.replay(calls(spark, *[r[:6] for r in rows])).orderBy("call_idx").collect()]
    assert got == [r[6] for r in rows]


def test_pressure_counts_output(spark):
    rows = [("a", 1, 100_000, 0, 0, 0), ("a", 2, 10_000, 60_000, 20_000, 9_999), ("b", 1, 0, 100_000, 30_000, 10_000), ("c", 1, 170_000, 0, 0, 10_000), ("d", 1, 90_000, 0, 0, 10_000)]
    df = spark.createDataFrame(rows, "file_id string, line_no long, input long, cache_read long, cache_write long, output long")
    assert {r.file_id: (r.context, r.band) for r in reports.pressure(df).collect()} == {"a": (99_999, "none"), "b": (140_000, "p70"), "c": (180_000, "p90"), "d": (100_000, "p50")}


@pytest.mark.parametrize("values, width, want", [([1.0, 2.0, 3.0, 4.0, 5.0], 2, [6.0, 9.0]), ([1.0, 2.0], 5, [1.0, 2.0]), ([1.0] * 7, 3, [3.0, 2.0, 2.0])])
def test_downsample_sums(spark, values, width, want):
    df = spark.createDataFrame(list(enumerate(values)), "i long, value double")
    assert [r.value for r in reports.downsample(df, width).orderBy("bucket").collect()] == want


def test_drift_falls_back_to_what_came_before(spark):
    day = lambda k: datetime(2026, 1, 1 + k // 3, k % 3)
    rows = [(f"s{k:02d}", "lone" if k == 9 else "young" if k == 11 else "many", day(k), float(k), 0.0, 0) for k in range(12)]
    m = spark.createDataFrame(rows, "file_id string, project string, ended_at timestamp, tokens_per_turn double, cache_hit_rate double, dup_tokens long")
    got = {r.project: (r.file_id, r.scope, r.base_count, r.base_tokens_per_turn) for r in reports.drift(m).collect()}
    assert got == {"many": ("s10", "project", 6, 5.5), "lone": ("s09", "all", 6, 5.5), "young": ("s11", "all", 6, 7.5)}  # of s03 to s08; s05 to s10


PRICES = [(date(2026, 1, 1), "a", "m", 1.0), (date(2026, 1, 1), "a", "old", 9.0), (date(2026, 3, 1), "a", "m", 2.0), (date(2026, 3, 1), "a", "new", 5.0), (date(2026, 1, 1), "b", "g", 7.0), (date(2026, 6, 1), "b", "g", 8.0), (date(2026, 6, 1), "b", "m", 99.0)]


def test_prices_hold_by_day(spark):
    p = spark.createDataFrame(PRICES, "as_of date, provider string, model string, input double")
    on = lambda d: {(r.provider, r.model): r.input for r in pricing.prices_on(p, F.lit(d), undated=("b",)).collect()}
    early, late = {("a", "m"): 1.0, ("a", "old"): 9.0, ("a", "new"): 5.0, ("b", "g"): 8.0}, {("a", "m"): 2.0, ("a", "new"): 5.0, ("b", "g"): 8.0}
    assert on(date(2025, 1, 1)) == on(date(2026, 1, 1)) == on(date(2026, 2, 28)) == early
    assert on(date(2026, 3, 1)) == on(date(2030, 1, 1)) == late


def test_requests_are_priced_by_their_own_day(spark):
    rates = ("input", "output", "cache_read", "cache_write", "cache_write_1h")
    none = dict.fromkeys(["cache_write_1h", "long_over", *(f"long_{r}" for r in rates)])
    schema = "as_of date, provider string, model string, " + ", ".join(f"{r} double" for r in rates) + ", long_over long, " + ", ".join(f"long_{r} double" for r in rates)
    p = spark.createDataFrame([{"as_of": d, "provider": q, "model": m, "input": x, "output": 0.0, "cache_read": 0.0, "cache_write": 0.0} | none for d, q, m, x in PRICES], schema)
    r = spark.createDataFrame([(k, m, d, 1_000_000, 0, 0, 0, 0) for k, (m, d) in enumerate([("m", date(2026, 2, 1)), ("m-20260101", date(2026, 3, 1)), ("nick", date(2026, 3, 1)), (None, date(2026, 3, 1)), ("old", date(2026, 4, 1)), ("g", date(2020, 1, 1))])], "k int, model string, day date, input long, output long, cache_read long, cache_write long, cache_write_1h long")
    aliases = spark.createDataFrame([("nick", "new")], "alias string, model string")
    got = pricing.priced(r, pricing.calendar(p, undated=("b",)), aliases, F.col("day")).orderBy("k").collect()
    assert [(x.usd, x.priced) for x in got] == [(1.0, True), (2.0, True), (5.0, True), (0.0, False), (0.0, False), (8.0, True)]


def price_table(day, **models):
    return json.dumps({"as_of": day, "source_url": "x", "models": models}, indent=1)


ROW = {"input_per_mtok": 3, "output_per_mtok": 15, "cache_read_per_mtok": 0.3, "cache_creation_per_mtok": 3.75}


def test_price_files(spark, tmp_path):
    long = {"over_tokens": 200000, "input_per_mtok": 6, "output_per_mtok": 30, "cache_read_per_mtok": 0.6, "cache_creation_per_mtok": 7.5, "cache_creation_1h_per_mtok": 13}
    (tmp_path / "2026-01-01.json").write_text(price_table("2026-01-01", m=ROW | {"cache_creation_1h_per_mtok": 6, "long_prompt": long}, n=ROW))
    (tmp_path / "openai-2026-02-01.json").write_text(price_table("2026-02-01", g=ROW))
    p = pricing.price_files(spark, str(tmp_path))
    m, n, g = p.orderBy(F.desc("provider"), F.desc("model")).collect()[::-1]
    assert (m.provider, n.provider, g.provider, g.as_of) == ("anthropic", "anthropic", "openai", date(2026, 2, 1))
    assert (m.input, m.output, m.cache_read, m.cache_write, m.cache_write_1h, m.long_over, m.long_input, m.long_cache_write_1h) == (3.0, 15.0, 0.3, 3.75, 6.0, 200_000, 6.0, 13.0)
    assert (n.cache_write_1h, n.long_over, n.long_input) == (None, None, None)
    # a long prompt with one-hour writes; a short one of a model without an hourly rate; the undated provider before its table
    r = spark.createDataFrame([(0, "m", 200_001, 1000, 0, 1000, 400), (1, "n", 1000, 0, 0, 1000, 400), (2, "g", 1000, 0, 0, 0, 0)], "k int, model string, input long, output long, cache_read long, cache_write long, cache_write_1h long")
    got = pricing.priced(r, pricing.prices_on(p, F.to_date(F.lit("2026-01-05")), pricing.UNDATED)).orderBy("k").collect()
    want = [(200_001 * 6 + 1000 * 30 + 600 * 7.5 + 400 * 13) / 1e6, (1000 * 3 + 600 * 3.75 + 400 * 6) / 1e6, 0.003]
    assert [x.priced for x in got] == [True] * 3 and [x.usd for x in got] == pytest.approx(want)


@pytest.mark.parametrize("row", [{k: x for k, x in ROW.items() if k != "output_per_mtok"}, ROW | {"long_prompt": {"over_tokens": 5} | ROW | {"input_per_mtok": None}}, ROW | {"long_prompt": dict(ROW)}])
def test_a_price_row_without_its_rates_is_an_error(spark, tmp_path, row):
    (tmp_path / "2026-01-01.json").write_text(price_table("2026-01-01", m=row))
    with pytest.raises(Exception, match="lacks rates: m"):
        pricing.price_files(spark, str(tmp_path)).collect()


def test_a_row_without_rates_prices_nothing(spark):
    r = spark.createDataFrame([("m", 10, 0, 0, 0, 0)], "model string, input long, output long, cache_read long, cache_write long, cache_write_1h long")
    names = ("cache_write_1h", "long_over", *(f"long_{x}" for x in pricing.RATES))
    p = spark.createDataFrame([("p", "m")], "provider string, model string").withColumns({x: F.lit(None).cast("double") for x in (*pricing.NEEDED, *names)})
    got = pricing.priced(r, p).first()
    assert (got.usd, got.priced) == (0.0, False)


def plain_points(rows):
    """The fold as one loop."""
    out, state = [], {}
    for limit, minutes, at, percent, resets in sorted(rows):
        if at > resets:
            continue
        period, reset, used = state.get((limit, minutes), (-1, None, 0.0))
        if reset is not None and reset - resets > 900_000:
            continue
        new = reset is None or abs(resets - reset) > max(900_000, minutes * 600) or at > reset or (resets - reset > 900_000 and percent < used)
        state[limit, minutes] = period, reset, used = period + new, resets, percent if new else max(used, percent)
        out.append((limit, minutes, period, at, used, reset))
    return sorted(out)


@pytest.mark.parametrize("segment_ms", [21_600_000, 10**12])
def test_limit_points_do_not_depend_on_how_readings_are_cut(spark, segment_ms):
    import random

    r, hour = random.Random(segment_ms), 3_600_000
    rows = []
    for limit, minutes in (("a", 300), ("b", 10080), ("a", 10080)):
        for _ in range(90):
            at = r.randrange(12 * 24 * hour)
            shift = r.choice([0, 0, 0, 60_000, -60_000, 1_200_000, -1_200_000, minutes * 60_000, -minutes * 60_000, 40 * 24 * hour if r.random() < 0.05 else 0])
            rows.append((limit, minutes, at, float(r.randrange(101)), (at // (minutes * 60_000) + 1) * minutes * 60_000 + shift))
    df = spark.createDataFrame(rows, "limit_id string, window_minutes long, at long, used_percent double, resets_at long").withColumns({"session_id": F.lit("s"), "plan_type": F.lit("p")})
    got = limits.points(df, segment_ms).select("limit_id", "window_minutes", "period", "at", "used_percent", "resets_at")
    assert sorted(map(tuple, got.collect())) == plain_points(rows)
    assert limits.points(df.limit(0)).count() == 0


PTS = "limit_id string, window_minutes long, period int, at long, used_percent double, resets_at long, plan_type string"
LIMIT_REQUESTS = "at long, session_id string, cwd string, model string, tokens long"


def one_period(spark):
    """A period whose percent rises at 10, 20 and 30, and requests at, between and after the rises."""
    pts = spark.createDataFrame([("l", 300, 0, at, used, 10**7, "p") for at, used in ((0, 0.0), (10, 4.0), (10, 3.0), (15, 4.0), (20, 9.0), (30, 10.0), (40, 10.0))], PTS)
    return pts, spark.createDataFrame([(at, s, f"/w/{s}", m, n) for at, s, m, n in ((5, "a", "m", 30), (10, "b", "m", 10), (11, "a", "m", 5), (20, "a", "codex-auto-review", 15), (25, "c", "m", 0), (35, "b", "m", 8), (41, "b", "m", 9))], LIMIT_REQUESTS)


def test_shares_of_a_limit_come_from_frames_that_grow(spark):
    pts, req = one_period(spark)
    shares = limits.attribute(req, pts)
    got = sorted((r.at, r.session_id, r.tokens, r.percent) for r in shares.collect())
    assert got == [(5, "a", 30, 3.0), (10, "b", 10, 1.0), (11, "a", 5, 1.25), (20, "a", 15, 3.75), (35, "b", 8, 0.0)]
    # a frame from a request to the end of its period is read anew for each of them
    plan = shares._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$(), currentrow$()" in plan and "currentrow$(), unboundedfollowing$()" not in plan


def test_what_no_request_accounts_for_comes_from_frames_that_grow(spark):
    pts, req = one_period(spark)
    left = limits.unattributed(req, pts)
    assert [(r.period, r.unattributed_percent) for r in left.collect()] == [(0, 1.0)]
    assert "currentrow$(), unboundedfollowing$()" not in left._jdf.queryExecution().optimizedPlan().toString()


def test_usage_by_session_comes_from_frames_that_grow(spark):
    pts, req = one_period(spark)
    used = limits.usage_by_session(limits.attribute(req, pts))
    got = sorted((r.line, r.project, r.percent, r.tokens, r.requests) for r in used.collect())
    assert got == [("(automatic reviews)", "a", 3.75, 15, 1), ("a", "a", 4.25, 35, 2), ("b", "b", 1.0, 18, 2)]
    assert "currentrow$(), unboundedfollowing$()" not in used._jdf.queryExecution().optimizedPlan().toString()


def test_trend(spark):
    day0 = datetime(2026, 1, 1)
    rows = [(day0.replace(day=1 + k), 10 + 2 * k, 100, 5.0 - k / 2, 7) for k in (0, 1, 3, 4, 6, 9)] + [(datetime(2025, 12, 31), 99, 100, 9.0, 9)]
    s = spark.createDataFrame(rows, "started_at timestamp, output long, total_tokens long, usd double, dup_tokens long")
    window = F.to_date(F.lit("2026-01-01")), F.to_date(F.lit("2026-01-10"))
    series = reports.trend_series(s, "output-ratio", *window).orderBy("day").collect()
    assert len(series) == 10 and [x.sessions for x in series] == [1, 1, 0, 1, 1, 0, 1, 0, 0, 1] and series[2].value == series[2].denominator == 0 and series[9].value == 0.28
    got = {x.metric: x for x in reports.trends(s, *window).collect()}
    assert {m: (x.points, x.verdict) for m, x in got.items()} == {"output-ratio": (6, "improving"), "cost-per-session": (6, "improving"), "recoverable-tokens-per-session": (6, "stable")}
    assert got["output-ratio"].median == pytest.approx((0.16 + 0.18) / 2) and got["cost-per-session"].slope == pytest.approx(-sum((x - 2.5) * k / 2 for x, k in enumerate((0, 1, 3, 4, 6, 9))) / 17.5)
    worse = s.withColumn("output", -F.col("output"))
    assert reports.trends(worse, *window, ("output-ratio",)).first().verdict == "regressing"
    few = reports.trends(s.filter("started_at < '2026-01-05'"), *window, ("cost-per-session",)).first()
    assert (few.points, few.slope, few.verdict) == (3, 0.0, "insufficient-data")


def test_todays_top_leak(spark):
    s = spark.createDataFrame([("a", datetime(2026, 1, 2, 9)), ("b", datetime(2026, 1, 2, 8)), ("c", datetime(2026, 1, 1, 8))], "file_id string, started_at timestamp")
    dup = spark.createDataFrame([("a", "/x", 3, 10, 2.0), ("b", "/y", 2, 10, 2.0), ("b", "/z", 1, 0, 9.0), ("c", "/w", 9, 9, 99.0)], "file_id string, path string, reads long, wasted_tokens long, usd double")
    day = F.to_date(F.lit("2026-01-02"))
    assert [tuple(x) for x in reports.today_top_leak(s, dup, day).collect()] == [("b", "/y", 1, 2.0)]
    assert reports.today_top_leak(s, dup, F.to_date(F.lit("2026-01-03"))).count() == 0


def test_a_long_chain_is_one_family(spark):
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(120)] + [("x", "y"), ("y", "y")]
    got = {r.id: r.family for r in requests.families(spark.createDataFrame(chain, "id string, other string")).collect()}
    assert got == {f"n{k:03d}": "n000" for k in range(121)} | {"x": "x", "y": "x"}
    with pytest.raises(RuntimeError):
        requests.families(spark.createDataFrame(chain, "id string, other string"), rounds=1)


def test_rows_without_a_model_are_compared_with_one_another(spark):
    r = spark.createDataFrame([(f"f{v}", k, f"2.1.{v}", None) for v in (1, 2) for k in range(6)], "file_id string, turn_idx long, version string, model string")
    more = {"missing_usage": F.lit(False), "cache_split": F.lit(False), "cache_write": F.lit(0), "cache_write_1h": F.lit(0), "entrypoint": F.lit("cli"), "sidechain": F.lit(False), "ts": F.timestamp_seconds("turn_idx"), "input": F.lit(600), "cache_read": F.lit(30_000), "output": F.lit(1), "after_tool_result": F.lit(True)}
    got = regress.uncached_input(regress.sample_rows(r.withColumns(more))).collect()
    assert {(x.model, x.version, x.median, x.baseline) for x in got} == {("?", "2.1.1", 600, 600), ("?", "2.1.2", 600, 600)}


def test_limit_periods_of_early_resets_drift_and_stale_readings(spark):
    hour = 3_600_000
    rows = [(0, 1.0, 5), (1, 10.0, 5), (2, 8.0, 5), (2.5, 12.0, 5.04), (3, 3.0, 8), (4, 90.0, 5), (6, 4.0, 5), (9, 2.0, 13)]  # hours: at, percent, resets
    r = spark.createDataFrame([(int(a * hour), "s", "l", "p", 300, u, int(z * hour)) for a, u, z in rows], "at long, session_id string, limit_id string, plan_type string, window_minutes long, used_percent double, resets_at long")
    got = [(p.period, p.used_percent, p.resets_at / hour, p.newest_at / hour) for p in limits.periods(limits.points(r)).orderBy("period").collect()]
    # the drift of the reset stays in the period, an early reset begins one, an older window's reading and one after its own reset are left out
    assert got == [(0, 12.0, 5.04, 2.5), (1, 3.0, 8.0, 3.0), (2, 2.0, 13.0, 9.0)]


@pytest.mark.parametrize("now, used, kind", [(9, 50.0, "reset-since"), (2, 100.0, "reached"), (0.5, 5.0, "too-early"), (2, 10.0, "lasts"), (2, 80.0, "runs-out")])
def test_pace(spark, now, used, kind):
    hour = 3_600_000
    p = spark.createDataFrame([("l", 300, 0, 0, int(0.4 * hour), used, 5 * hour)], "limit_id string, window_minutes long, period int, started_at long, newest_at long, used_percent double, resets_at long")
    got = limits.pace(p, F.lit(int(now * hour)).cast("long"))
    assert got.first().kind == kind and limits.named_window(got).first().limit_id == "l"


def test_a_possible_cut_is_half_of_two_earlier_periods(spark):
    rows = [("l", 300, k, "m", t) for k, t in enumerate([1000.0, 1200.0, 900.0, 500.0, 100.0])] + [("k", 300, 0, "m", 10.0), ("k", 300, 1, "m", 1.0)]
    got = limits.possible_cuts(spark.createDataFrame(rows, "limit_id string, window_minutes long, period int, model string, tokens_per_percent double")).collect()
    assert [(r.limit_id, r.period, r.baseline, r.factor) for r in got] == [("l", 3, 1000.0, 2.0)]


@pytest.mark.parametrize("pivot, now, status", [(None, "2026-03-01", "no-install-marker"), ("2026-02-01", "2026-02-02", "insufficient-post-data"), ("2025-01-01", "2026-03-01", "no-baseline"), ("2026-02-25", "2026-03-01", "no-post-sessions"), ("2026-01-20", "2026-03-01", "measured")])
def test_every_status_of_impact(spark, pivot, now, status):
    days = [datetime(2026, 1, 1 + k) for k in range(0, 30, 5)]
    s = spark.createDataFrame([(f"f{k}", d, 1.0, 100, 10, 1, 1, 1) for k, d in enumerate(days)], "file_id string, started_at timestamp, usd double, total_tokens long, output long, dup_tokens long, idle_tokens long, cache_write long")
    assert reports.impact(s, F.lit(pivot).cast("timestamp"), F.lit(now).cast("timestamp")).first().status == status


@pytest.mark.parametrize("days, now, status", [([], "2026-01-15", "no-data"), ([10], "2026-01-30 12:00:00", "near-month-end"), ([1], "2026-01-20", "no-recent-activity"), ([14], "2026-01-18", "insufficient-data"), ([1, 14], "2026-01-15", "ok")])
def test_every_status_of_forecast(spark, days, now, status):
    s = spark.createDataFrame([(f"f{d}", datetime(2026, 1, d), 2.0) for d in days], "file_id string, started_at timestamp, usd double")
    assert reports.forecast(s, F.lit(now).cast("timestamp")).first().status == status


def test_cold_after_an_idle_hour(spark):
    rows = [(f"f{k}", j, f"f{k}", f"2.1.{k % 2}", "m", "cli", False, ts, 100, cr, 0, 0, 0, 1, 40_000, False) for k in range(12) for j, (ts, cr) in enumerate([(0, 39_000), (4_000_000, 0), (4_060_000, 39_000 * (k % 2)), (4_120_000, 39_000 * (k % 2))])]
    df = spark.createDataFrame(rows, "file_id string, turn_idx long, session string, version string, model string, entry string, side boolean, ts long, inp long, cr long, cw long, c5 long, c1 long, out long, ctx long, after_tool boolean")
    got = {r.version: (r.n, r.rate, r.baseline) for r in regress.post_idle_cold(df).collect()}
    assert got == {"2.1.0": (6, 1.0, 0.0), "2.1.1": (6, 0.0, 1.0)}


def test_badge_and_snapshots(spark):
    df = spark.createDataFrame([(87, "Good", "green")], "score int, tier string, color string")
    assert json.loads(df.select(stores.badge(F.col("score"), F.col("tier"), F.col("color"), "quality")).first()[0]) == {"schemaVersion": 1, "label": "quality", "message": "87 · Good", "color": "green", "namedLogo": "github", "labelColor": "#0B0E0E"}


def test_streams_keep_requests_without_a_key_and_the_newest_signals(spark):
    rows = [(i, "f", "k" if i % 2 else None, i, i, 2 * i, 3, 4) for i in range(8)]
    df = spark.createDataFrame(rows, "seq long, file_id string, request_key string, line_no long, input long, output long, cache_read long, cache_write long")
    got = run(spark, df, live.merged_requests, "keyless", "complete")
    assert sorted((r.request_key or "", r.input) for r in got) == [("", 0), ("", 2), ("", 4), ("", 6), ("k", 7)]
    sig = spark.createDataFrame([(i, "s", i, f"x{i}") for i in range(10)], "seq long, session_id string, at long, signal string")
    held = run(spark, sig, lambda s: live.newest_signals(s, keep=3), "newest3", "update")
    assert [(r.at, r.signal, r["rank"]) for r in held[-3:]] == [(9, "x9", 1), (8, "x8", 2), (7, "x7", 3)]


def test_logs_to_sessions(spark, tmp_path):
    """Two agents' logs, one session resumed in a second file: each request once, priced by the day its session began."""
    u = {"input_tokens": 1_000_000, "output_tokens": 0, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0}
    first = [user("go", 1), assistant(1, "m1", "r1", u, [READ, EDIT], 2, "m"), user([{"type": "tool_result", "tool_use_id": "c1", "content": "x" * 400}], 3)]
    again = {"type": "tool_use", "id": "c9", "name": "Read", "input": {"file_path": "/w/app/A.ts"}}
    later = assistant(9, "m9", "r9", u, [again], 55, "m") | {"timestamp": "2026-04-01T00:00:00.000Z"}
    write(tmp_path / "a" / "p" / "one.jsonl", first)
    write(tmp_path / "a" / "p" / "two.jsonl", [*first, later, user([{"type": "tool_result", "tool_use_id": "c9", "content": "y" * 40}], 56)])
    name = "rollout-2026-01-02T03-00-00-11111111-1111-1111-1111-111111111111.jsonl"
    sub = rollout("session_meta", 0, id="11111111-1111-1111-1111-111111111111", cwd="/w/b", parent_thread_id="z")
    write(tmp_path / "b" / "sessions" / name, [sub, rollout("turn_context", 1, turn_id="t", model="g", cwd="/w/b"), counted(2, tokens(500_000), tokens(500_000))])
    rates = ("input", "output", "cache_read", "cache_write", "cache_write_1h")
    schema = "as_of date, provider string, model string, " + ", ".join(f"{r} double" for r in rates) + ", long_over long, " + ", ".join(f"long_{r} double" for r in rates)
    p = spark.createDataFrame([(d, q, m, x, *[0.0] * 4, None, *[None] * 5) for d, q, m, x in PRICES], schema)
    logs = usage.combined_logs(assistant_logs.read(spark, f"{tmp_path}/a"), rollouts.read(spark, f"{tmp_path}/b"))
    f = usage.session_facts(logs, p, undated=("b",)).cache()
    got = {r.file_id[:7]: (r.agent, r.project, r.n_requests, r.input, r.usd, r.dup_tokens) for r in f.collect()}
    assert got == {"one": ("claude-code", "app", 1, 1_000_000, 1.0, 0), "two": ("claude-code", "app", 1, 1_000_000, 1.0, 10), "rollout": ("codex", "b", 1, 500_000, 4.0, 0)}
    assert usage.latest(f).first().agent == "claude-code"  # a subagent's session is not picked
    assert {r.file_id for r in usage.latest(f, prefix="s1").collect()} == {"one", "two"} and usage.newest_sessions(f, 2).count() == 2
