"""Named queries over the driver tables, each with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import code
from ..operators import analyzers, benchmarks, estimate, files, limits, pricing, regress, repo_audit, reports, requests, rewriters, signals, stores, usage
from ..session import checkpoint_folder
from ..sources import assistant_logs, usage_cache
from . import repo_views, rewriter_twin
from . import trace_views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "dearest_sessions"


def query(sql: str | None = None, *views: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = v.sql(sql, *views) if views else sql
        return f

    return add


def r(c: str, digits: int = 4):
    return F.round(c, digits).alias(c)


def day():
    return F.to_date(F.lit("1997-03-10"))


def now():
    return F.to_timestamp(F.lit("1997-03-10 12:00:00"))


# -- requests: merge, price, own ---------------------------------------------------------------------------

MERGED = """merged AS (SELECT file_id, min(line_no) AS first_line, any_value(request_key) AS request_key, max(input) AS input, max(output) AS output, max(cache_read) AS cache_read,
 max(cache_write) AS cache_write, max(cache_write_1h) AS cache_write_1h, arg_min(model, line_no) AS model, arg_min(ts, line_no) AS ts, arg_min(version, line_no) AS version,
 bool_and(missing_usage) AS missing_usage, count(*) AS n_lines FROM lines GROUP BY file_id, coalesce('k' || request_key, 'n' || line_no)),
requests AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY first_line) - 1 AS turn_idx FROM merged)"""
HELD = """held AS (SELECT p.* FROM prices p JOIN (SELECT provider, coalesce(max(CASE WHEN as_of <= '1997-03-10' THEN as_of END), min(as_of)) AS a FROM prices GROUP BY 1) t ON p.provider = t.provider AND p.as_of = t.a),
price AS (SELECT * FROM held UNION ALL SELECT p.* FROM prices p WHERE as_of = (SELECT max(as_of) FROM prices q WHERE q.provider = p.provider) AND p.model NOT IN (SELECT model FROM held)),
priced AS (SELECT r.*, p.model IS NOT NULL AS priced, coalesce((input * ri + output * ro + cache_read * rr + (cache_write - hour) * rw + hour * coalesce(rh, 2 * ri)) / 1000000, 0) AS usd FROM
 (SELECT *, regexp_replace(model, '-([0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$', '') AS plain, greatest(0, least(cache_write_1h, cache_write)) AS hour FROM requests) r
 LEFT JOIN LATERAL (SELECT model, CASE WHEN r.input + r.cache_read + r.cache_write > long_over THEN coalesce(l_input, p_input) ELSE p_input END AS ri,
  CASE WHEN r.input + r.cache_read + r.cache_write > long_over THEN coalesce(l_output, p_output) ELSE p_output END AS ro,
  CASE WHEN r.input + r.cache_read + r.cache_write > long_over THEN coalesce(l_cache_read, p_cache_read) ELSE p_cache_read END AS rr,
  CASE WHEN r.input + r.cache_read + r.cache_write > long_over THEN coalesce(l_cache_write, p_cache_write) ELSE p_cache_write END AS rw,
  CASE WHEN r.input + r.cache_read + r.cache_write > long_over THEN coalesce(l_cache_write_1h, p_cache_write_1h) ELSE p_cache_write_1h END AS rh
  FROM price WHERE price.model = r.plain) p ON true)"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return requests.merge_lines(v.lines(spark, d))


def _priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.priced(_requests(spark, d), pricing.prices_on(v.prices(spark), day()))


@query(f"{MERGED} SELECT file_id, turn_idx, request_key, model, input, output, cache_read, cache_write, cache_write_1h, missing_usage FROM requests", "lines")
def merge_streamed_lines(spark, d):
    return _requests(spark, d).select("file_id", "turn_idx", "request_key", "model", "input", "output", "cache_read", "cache_write", "cache_write_1h", "missing_usage")


OWNED = """sess AS (SELECT file_id, min(ts) AS s, max(ts) AS e, count(*) AS n FROM requests GROUP BY 1),
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY request_key ORDER BY s IS NULL, s, e IS NULL, e, n, r.file_id, turn_idx) AS k, max(input) OVER w AS ti, max(output) OVER w AS tou, max(cache_read) OVER w AS tr,
 max(cache_write) OVER w AS tw FROM requests r JOIN sess USING (file_id) WINDOW w AS (PARTITION BY request_key)),
owned AS (SELECT file_id, turn_idx, ti AS input, tou AS output, tr AS cache_read, tw AS cache_write, model FROM ranked WHERE request_key IS NOT NULL AND k = 1
 UNION ALL SELECT file_id, turn_idx, input, output, cache_read, cache_write, model FROM requests WHERE request_key IS NULL)"""


@query(f"{MERGED},\n{OWNED} SELECT file_id, count(*) AS n, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write FROM owned GROUP BY 1", "lines")
def cross_session_dedupe(spark, d):
    req = _requests(spark, d)
    return requests.own_requests(req).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")])


@query(f"{MERGED},\n{OWNED} SELECT r.file_id, count(*) AS n_all, count(o.file_id) AS n_kept, count(*) - count(o.file_id) AS n_copied FROM requests r LEFT JOIN owned o ON r.file_id = o.file_id AND r.turn_idx = o.turn_idx GROUP BY 1", "lines")
def copied_requests(spark, d):
    req = _requests(spark, d)
    return requests.dropped_requests(req, requests.own_requests(req))


TOTALS = """totals AS (SELECT file_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
 sum(usd) AS usd, count(*) AS n_requests, bool_and(missing_usage) AS missing_all, CAST(sum(CASE WHEN priced THEN 0 ELSE input + output + cache_read + cache_write END) AS BIGINT) AS unpriced_tokens FROM priced GROUP BY 1)"""


@query(f"{MERGED},\n{HELD},\n{TOTALS} SELECT file_id, input, output, cache_read, cache_write, round(usd, 8) AS usd, n_requests, unpriced_tokens, round(output / (input + output + cache_write), 6) AS output_ratio FROM totals WHERE NOT missing_all AND input + output + cache_read + cache_write > 0", "lines", "prices")
def session_totals(spark, d):
    return analyzers.not_empty(analyzers.totals(_priced(spark, d))).select("file_id", "input", "output", "cache_read", "cache_write", r("usd", 8), "n_requests", "unpriced_tokens", r("output_ratio", 6))


@query(f"{MERGED},\n{HELD},\n{TOTALS} SELECT file_id, input + output + cache_read + cache_write AS total_tokens, round(usd, 8) AS usd, n_requests FROM totals WHERE NOT missing_all ORDER BY 2 DESC, totals.usd DESC, 1 LIMIT 20", "lines", "prices")
def dearest_sessions(spark, d):
    t = analyzers.not_empty(analyzers.totals(_priced(spark, d))).withColumn("total_tokens", pricing.total_tokens()).withColumn("started_at", F.lit(0))
    return reports.dearest_sessions(t, 20).select("file_id", "total_tokens", r("usd", 8), "n_requests")


@query(f"{MERGED},\n{HELD} SELECT file_id, model, round(sum(usd), 8) AS usd, CAST(sum(input + output + cache_read + cache_write) AS BIGINT) AS tokens FROM priced GROUP BY 1, 2", "lines", "prices")
def cost_by_model(spark, d):
    return analyzers.cost_by_model(_priced(spark, d)).select("file_id", "model", r("usd", 8), "tokens")


@query(f"{MERGED},\n{HELD} SELECT CAST(sum(input + output + cache_read + cache_write) AS BIGINT) AS tokens, count(*) AS requests, array_to_string(list_sort(list_distinct(list(model))), ',') AS models FROM priced WHERE NOT priced AND input + output + cache_read + cache_write > 0", "lines", "prices")
def unpriced_usage(spark, d):
    return pricing.unpriced(_priced(spark, d)).select("tokens", "requests", F.array_join("models", ",").alias("models"))


@query(f"{MERGED} SELECT file_id, arg_max(model, n * 100000 - f) AS primary_model, array_to_string(list_sort(list(model)), ',') AS models FROM (SELECT file_id, model, count(*) AS n, min(turn_idx) AS f FROM requests GROUP BY 1, 2) GROUP BY 1", "lines")
def primary_models(spark, d):
    return requests.primary_model(_requests(spark, d)).select("file_id", "primary_model", F.array_join("models", ",").alias("models"))


@query("""SELECT file_id, c AS context, round(c / 200000.0, 6) AS share, CASE WHEN c >= 180000 THEN 'p90' WHEN c >= 140000 THEN 'p70' WHEN c >= 100000 THEN 'p50' ELSE 'none' END AS band
 FROM (SELECT file_id, arg_max(input + cache_read + cache_write + output, line_no) AS c FROM lines GROUP BY 1)""", "lines")
def context_pressure(spark, d):
    return reports.pressure(v.lines(spark, d)).select("file_id", "context", r("share", 6), "band")


@query("""newest AS (SELECT provider, max(as_of) AS a FROM price_rows GROUP BY 1), held AS (SELECT coalesce(max(CASE WHEN as_of <= '1997-03-10' THEN as_of END), min(as_of)) AS a FROM price_rows WHERE provider = 'anthropic'),
own AS (SELECT * FROM price_rows WHERE provider = 'anthropic' AND as_of = (SELECT a FROM held)),
filled AS (SELECT * FROM own UNION ALL SELECT p.* FROM price_rows p JOIN newest n ON p.provider = n.provider AND as_of = a WHERE p.provider = 'anthropic' AND model NOT IN (SELECT model FROM own)),
every AS (SELECT * FROM filled UNION ALL SELECT p.* FROM price_rows p JOIN newest n ON p.provider = n.provider AND as_of = a WHERE p.provider = 'openai' AND model NOT IN (SELECT model FROM filled))
SELECT provider, model, as_of, s * 0.5 AS input, s * 2.5 AS output, s * 0.0625 AS cache_read, s * 0.625 AS cache_write, CASE WHEN s % 2 = 0 THEN s END AS cache_write_1h, CAST(CASE WHEN s > 45 THEN 60000 END AS DOUBLE) AS long_over, CASE WHEN s > 45 THEN s END AS long_input, CASE WHEN s > 45 AND s % 2 = 0 THEN s * 2 END AS long_cache_write_1h FROM every""", "price_rows")
def prices_as_of(spark, d):
    """Price files written from part, read again, and the rows that hold on a day."""
    held = pricing.prices_on(pricing.price_files(spark, v.price_folder(spark, d) + "/*/*"), day(), pricing.UNDATED)
    return held.select("provider", "model", F.col("as_of").cast("string").alias("as_of"), "input", "output", "cache_read", "cache_write", "cache_write_1h", F.col("long_over").cast("double").alias("long_over"), "long_input", "long_cache_write_1h")


# -- from logs to sessions -----------------------------------------------------------------------------------

DATED = HELD[HELD.index("priced AS"):].replace("FROM price WHERE price.model = r.plain)", "FROM price WHERE price.model = r.plain AND r.day >= price.valid_from AND r.day < price.valid_to)")
CALENDAR = """spans AS (SELECT provider, as_of, CASE WHEN row_number() OVER o = 1 THEN '0001-01-01' ELSE as_of END AS valid_from, coalesce(lead(as_of) OVER o, '9999-12-31') AS valid_to FROM (SELECT DISTINCT provider, as_of FROM prices) WINDOW o AS (PARTITION BY provider ORDER BY as_of)),
price AS (SELECT p.*, valid_from, valid_to FROM prices p JOIN spans USING (provider, as_of)
 UNION ALL SELECT p.*, s.valid_from, s.valid_to FROM prices p JOIN spans s USING (provider) WHERE p.as_of = (SELECT max(as_of) FROM prices q WHERE q.provider = p.provider) AND NOT EXISTS (SELECT 1 FROM prices q WHERE q.provider = p.provider AND q.as_of = s.as_of AND q.model = p.model))"""
CALENDAR = CALENDAR.replace("SELECT p.*, s.valid_from", "SELECT p.provider, p.as_of, p.* EXCLUDE (provider, as_of), s.valid_from").replace("SELECT p.*, valid_from", "SELECT provider, as_of, p.* EXCLUDE (provider, as_of), valid_from")
FACTS = f"""{MERGED.replace("FROM lines", "FROM log_lines").replace("requests AS (", "all_requests AS (")},
{OWNED.replace("FROM requests", "FROM all_requests")},
days AS (SELECT file_id, substr(CAST(min(ts) AS VARCHAR), 1, 10) AS day FROM log_lines GROUP BY 1),
requests AS (SELECT o.*, d.day, o.h AS cache_write_1h FROM owned o JOIN days d USING (file_id)),
{CALENDAR},
{DATED}"""
FACTS = FACTS.replace("max(cache_write) OVER w AS tw FROM", "max(cache_write) OVER w AS tw, max(cache_write_1h) OVER w AS th FROM").replace("tw AS cache_write, model FROM ranked", "tw AS cache_write, th AS h, model FROM ranked").replace("cache_read, cache_write, model FROM all_requests WHERE request_key IS NULL", "cache_read, cache_write, cache_write_1h AS h, model FROM all_requests WHERE request_key IS NULL")


@query(f"{FACTS}, f AS (SELECT file_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read + cache_write) AS BIGINT) AS cached, sum(usd) AS usd, count(*) AS n_requests FROM priced GROUP BY 1) SELECT file_id AS session_id, d.day, input, output, cached, round(f.usd, 8) AS usd, n_requests FROM f JOIN days d USING (file_id) WHERE input + output + cached > 0", "lines", "log_lines", "prices")
def log_session_facts(spark, d):
    """Logs written from the driver tables, read, merged, deduplicated, priced by each session's day, and summed up."""
    lines = assistant_logs.scan(spark, v.log_folder(spark, d), ending="txt")  # Spark names files alike in each folder
    logs = assistant_logs.from_lines(lines.withColumn("file_id", F.col("project_hash")))
    f = usage.session_facts(logs, v.prices(spark))
    return f.select("session_id", F.substring("started_at", 1, 10).alias("day"), "input", "output", (F.col("cache_read") + F.col("cache_write")).alias("cached"), r("usd", 8), "n_requests")


@query(SQL["log_session_facts"])
def cached_session_facts(spark, d):
    """log_session_facts from the usage cache, filled by one run and read by a second, which opens no log."""
    source = assistant_logs.cached(spark, v.log_folder(spark, d), ending="txt", key="project_hash")
    cache = f"{checkpoint_folder(spark)}/usage-{uuid.uuid4().hex}"
    usage_cache.load(spark, cache, source)
    loaded = usage_cache.load(spark, cache, source)
    if loaded.read:
        raise RuntimeError(f"{loaded.read} unchanged logs were read again")
    f = usage.session_facts(loaded.logs, v.prices(spark)).join(loaded.reported, "file_id", "left_semi")
    return f.select("session_id", F.substring("started_at", 1, 10).alias("day"), "input", "output", (F.col("cache_read") + F.col("cache_write")).alias("cached"), r("usd", 8), "n_requests")


# -- calls -------------------------------------------------------------------------------------------------


@query("""SELECT file_id, path, count(*) AS reads, CAST(coalesce(sum(CASE WHEN n > 1 THEN result_tokens END), 0) AS BIGINT) AS wasted_tokens
 FROM (SELECT *, row_number() OVER (PARTITION BY file_id, path ORDER BY call_idx) AS n FROM calls WHERE name = 'Read') GROUP BY 1, 2""", "calls")
def duplicate_reads(spark, d):
    return analyzers.duplicate_reads(v.calls(spark, d))


@query("""SELECT file_id, path, last_turn - ref AS idle_turns, cost AS idle_tokens FROM (SELECT file_id, path, arg_max(turn_idx, call_idx) AS ref, arg_min(CASE WHEN name = 'Read' THEN result_tokens END, CASE WHEN name = 'Read' THEN call_idx END) AS cost
 FROM calls WHERE name IN ('Read', 'Edit') GROUP BY 1, 2) JOIN (SELECT file_id, max(turn_idx) AS last_turn FROM turns GROUP BY 1) USING (file_id) WHERE last_turn - ref >= 5 AND cost IS NOT NULL""", "calls", "turns")
def idle_context(spark, d):
    return analyzers.idle_context(v.calls(spark, d), v.call_requests(spark, d))


@query("""by_path AS (SELECT file_id, path, CAST(coalesce(sum(CASE WHEN n > 1 THEN result_tokens END), 0) AS BIGINT) AS wasted_tokens FROM (SELECT *, row_number() OVER (PARTITION BY file_id, path ORDER BY call_idx) AS n FROM calls WHERE name = 'Read') GROUP BY 1, 2)
SELECT file_id, path, wasted_tokens, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY wasted_tokens DESC, path) AS INTEGER) AS rank FROM by_path WHERE wasted_tokens > 0) WHERE rank <= 10""", "calls")
def top_duplicates(spark, d):
    return analyzers.top_files(analyzers.duplicate_reads(v.calls(spark, d)), "wasted_tokens").select("file_id", "path", "wasted_tokens", "rank")


@query("""dup AS (SELECT file_id, CAST(sum(result_tokens) AS BIGINT) AS dup FROM (SELECT *, row_number() OVER (PARTITION BY file_id, path ORDER BY call_idx) AS n FROM calls WHERE name = 'Read') WHERE n > 1 GROUP BY 1),
ed AS (SELECT file_id, CAST(sum(output) AS BIGINT) AS ed FROM calls JOIN turns USING (file_id, turn_idx) WHERE name = 'Edit' GROUP BY 1),
s AS (SELECT file_id, CAST(sum(input) AS BIGINT) AS i, CAST(sum(output) AS BIGINT) AS o, CAST(sum(cache_write) AS BIGINT) AS w FROM turns GROUP BY 1),
x AS (SELECT file_id, CAST(floor(w * 0.22::DOUBLE + 0.5) AS BIGINT) AS manifest, coalesce(dup, 0) AS read_once, CAST(floor(coalesce(ed, 0) * 0.85::DOUBLE + 0.5) AS BIGINT) AS diff_output, i + w + o AS most FROM s LEFT JOIN dup USING (file_id) LEFT JOIN ed USING (file_id))
SELECT file_id, manifest, read_once, diff_output, least(manifest + read_once + diff_output, most) AS total FROM x""", "calls", "turns")
def recoverable_tokens(spark, d):
    c, t = v.calls(spark, d), v.call_requests(spark, d)
    sums = t.groupBy("file_id").agg(*[F.sum(x).alias(x) for x in ("input", "output", "cache_write")])
    return analyzers.recoverable(sums, analyzers.duplicate_reads(c), c, t)


@query("""SELECT file_id, rank, call_idx, name, reason, tokens FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tokens DESC, call_idx) AS rank FROM
 (SELECT file_id, call_idx, name, CAST(floor((input + output + cache_read + cache_write) / (count(*) OVER (PARTITION BY file_id, turn_idx)) + 0.5) AS BIGINT) AS tokens,
 CASE WHEN cache_write > input THEN 'cache-creation' WHEN output > 1500 THEN 'long-output' WHEN input > 10000 THEN 'large-input'
 WHEN name = 'Read' AND count(CASE WHEN name = 'Read' THEN 1 END) OVER (PARTITION BY file_id, path) > 1 THEN 'duplicate-read' ELSE 'ordinary' END AS reason FROM calls JOIN turns USING (file_id, turn_idx))) WHERE rank <= 5""", "calls", "turns")
def dearest_calls(spark, d):
    return analyzers.dearest_calls(v.calls(spark, d), v.call_requests(spark, d))


@query("""SELECT file_id, title, tokens, rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tokens DESC, place) AS rank FROM
 (SELECT file_id, 0 AS place, 'duplicate file reads' AS title, dup_tokens AS tokens FROM sessions UNION ALL SELECT file_id, 1, 'idle context', idle_tokens FROM sessions
 UNION ALL SELECT file_id, 2, 'cache-creation overhead', cache_write FROM sessions UNION ALL SELECT file_id, 3, 'input tokens (system + prompts)', input FROM sessions) WHERE tokens > 0) WHERE rank <= 3""", "sessions")
def top_leaks(spark, d):
    return analyzers.leaks(v.orders_sessions(spark, d)).select("file_id", "title", "tokens", "rank")


@query("""SELECT file_id, call_idx, CASE WHEN name = 'Grep' THEN CASE WHEN event_id % 3 > 0 THEN 2000 ELSE 0 END WHEN name = 'Bash' THEN 1500 WHEN name <> 'Read' THEN 0 WHEN nth > 1 THEN 2000 WHEN seen AND NOT ends_with(path, '.md') THEN 3000 ELSE 0 END AS saved FROM (SELECT file_id, call_idx, name, path, event_id,
 row_number() OVER (PARTITION BY file_id, name, path ORDER BY call_idx) AS nth, bool_or(name = 'Grep' AND event_id % 3 > 0 OR name = 'Bash' AND event_id % 7 = 0) OVER (PARTITION BY file_id ORDER BY call_idx) AS seen FROM calls)""", "calls")
def replay_savings(spark, d):
    return analyzers.replay(v.calls(spark, d)).select("file_id", "call_idx", "saved")


@query(rewriter_twin.REWRITTEN)
def rewritten_commands(spark, d):
    """Every shell call and search with the first rewriter that takes it."""
    out = rewriters.rewritten(v.commands(spark, d))
    shown = F.when(F.col("rewrite.rewriter") == "cat", F.substring("rewrite.command", 1, 3)).otherwise(F.col("rewrite.command"))
    return out.select("call_id", "rewrite.rewriter", F.col("rewrite.saved_tokens").cast("double").alias("saved_tokens"), "rewrite.integrity", shown.alias("command"))


# -- period reports ----------------------------------------------------------------------------------------

WINDOW = "FROM sessions WHERE started_at >= DATE '1996-03-01' AND started_at < DATE '1997-03-11'"


def _window(spark, d):
    since, until = reports.parse_since("375d", day(), F.to_date(F.lit("1995-01-01")))
    return reports.in_window(v.orders_sessions(spark, d), since, until)


@query(f"""SELECT count(*) AS sessions, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
 CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(usd), 2) AS usd, floor(sum(output) / sum(total_tokens) * 100 * 10 + 0.5) / 10 AS output_ratio_pct {WINDOW}""", "sessions")
def stats_totals(spark, d):
    return reports.window_totals(_window(spark, d)).withColumn("usd", F.round("usd", 2))


@query(f"SELECT primary_model, count(*) AS sessions {WINDOW} GROUP BY 1 ORDER BY 2 DESC, max((started_at, file_id)) DESC LIMIT 1", "sessions")
def stats_dominant_model(spark, d):
    return reports.dominant_model(_window(spark, d))


@query(f"SELECT project, count(*) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(usd), 2) AS usd, floor(sum(usd) / sum(sum(usd)) OVER () * 100 * 10 + 0.5) / 10 AS pct {WINDOW} GROUP BY 1", "sessions")
def stats_projects(spark, d):
    return reports.by_project(_window(spark, d)).withColumn("usd", F.round("usd", 2))


@query("SELECT project, primary_model, count(*) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, grouping_id(project, primary_model) AS level FROM sessions GROUP BY ROLLUP (project, primary_model)", "sessions")
def stats_rollup(spark, d):
    return reports.rollup_costs(v.orders_sessions(spark, d), "project", "primary_model")


@query(f"""days AS (SELECT CAST(started_at AS DATE) AS day, count(*) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(usd) AS usd {WINDOW} GROUP BY 1)
SELECT CAST(d.day AS VARCHAR) AS day, coalesce(sessions, 0) AS sessions, coalesce(total_tokens, 0) AS total_tokens, round(coalesce(usd, 0), 2) AS usd
FROM (SELECT CAST(unnest(generate_series(greatest(min(day), max(day) - 365), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM days) d LEFT JOIN days b ON b.day = d.day""", "sessions")
def stats_daily_all(spark, d):
    """All sessions of the window, by day."""
    return reports.daily(_window(spark, d)).select(F.col("day").cast("string").alias("day"), "sessions", "total_tokens", r("usd", 2))


@query(f"""SELECT *, dup_usd + idle_usd + write_usd AS total_usd FROM (SELECT *, round(dup_tokens * 0.3 / 1000000, 6) AS dup_usd, round(idle_tokens * 0.3 / 1000000, 6) AS idle_usd, round(floor(cache_write * 0.3 + 0.5) * 3.75 / 1000000, 6) AS write_usd
 FROM (SELECT CAST(sum(dup_tokens) AS BIGINT) AS dup_tokens, CAST(sum(idle_tokens) AS BIGINT) AS idle_tokens, CAST(sum(cache_write) AS BIGINT) AS cache_write {WINDOW}))""".replace("dup_usd + idle_usd + write_usd AS total_usd", "round(dup_usd + idle_usd + write_usd, 5) AS total_usd"), "sessions")
def stats_savings(spark, d):
    price = F.struct(F.lit(0.3).alias("cache_read"), F.lit(3.75).alias("cache_write"))
    return reports.savings(_window(spark, d), price).select("dup_tokens", "idle_tokens", "cache_write", r("dup_usd", 6), r("idle_usd", 6), r("write_usd", 6), r("total_usd", 5))


TREND = """days AS (SELECT CAST(unnest(generate_series(DATE '1996-03-15', DATE '1997-03-10', INTERVAL 1 DAY)) AS DATE) AS day),
own AS (SELECT CAST(started_at AS DATE) AS day, count(*) AS n, CAST(sum(output) AS DOUBLE) AS o, CAST(sum(total_tokens) AS DOUBLE) AS t, sum(usd) AS u, CAST(sum(dup_tokens) AS DOUBLE) AS r FROM sessions GROUP BY 1),
s AS (SELECT metric, days.day, coalesce(n, 0) AS sessions, coalesce([o, u, r][k], 0) AS numerator, coalesce([t, n, n][k], 0) AS denominator FROM days LEFT JOIN own USING (day), (VALUES ('output-ratio', 1), ('cost-per-session', 2), ('recoverable-tokens-per-session', 3)) m(metric, k)),
series AS (SELECT *, CASE WHEN denominator > 0 THEN numerator / denominator ELSE 0 END AS value FROM s)"""


def _year():
    return reports.trend_window("360d", day())


@query(f"{TREND}, d AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day) - 1 AS x FROM series WHERE sessions > 0), f AS (SELECT metric, count(*) AS points, median(value) AS m, CASE WHEN count(*) < 5 THEN 0 ELSE regr_slope(value, x) END AS s FROM d GROUP BY 1) "
 "SELECT metric, points, round(m, 6) AS median, round(s, 6) AS slope, CASE WHEN points < 5 THEN 'insufficient-data' WHEN abs(s) < 0.001 THEN 'stable' WHEN (s > 0) = (metric = 'output-ratio') THEN 'improving' ELSE 'regressing' END AS verdict FROM f", "sessions")
def trend_report(spark, d):
    return reports.trends(v.orders_sessions(spark, d), *_year()).select("metric", "points", r("median", 6), r("slope", 6), "verdict")


@query(f"{TREND} SELECT metric, CAST(day AS VARCHAR) AS day, sessions, round(numerator, 4) AS numerator, round(denominator, 4) AS denominator, round(value, 6) AS value FROM series", "sessions")
def trend_series(spark, d):
    """Every day of the window for each metric, days without sessions too."""
    s = v.orders_sessions(spark, d)
    every = [reports.trend_series(s, m, *_year()).withColumn("metric", F.lit(m)) for m in reports.METRICS]
    return reduce(DataFrame.unionByName, every).select("metric", F.col("day").cast("string").alias("day"), "sessions", r("numerator"), r("denominator"), r("value", 6))


@query("SELECT count(*) AS sessions, round(coalesce(sum(usd), 0), 2) AS usd, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(output), 0) AS BIGINT) AS output, round(CASE WHEN sum(total_tokens) > 0 THEN sum(output) / sum(total_tokens) * 100 ELSE 0 END, 6) AS output_ratio_pct FROM sessions WHERE CAST(started_at AS DATE) = DATE '1997-03-10'", "sessions")
def today_block(spark, d):
    return reports.today_block(v.orders_sessions(spark, d), day()).select("sessions", r("usd", 2), "total_tokens", "output", r("output_ratio_pct", 6))


@query("""SELECT count(*) AS days, round(median(usd), 4) AS median_usd, round(median(tokens), 4) AS median_tokens, round(median(ratio), 4) AS median_output_ratio_pct FROM
 (SELECT CAST(started_at AS DATE) AS day, sum(usd) AS usd, sum(total_tokens) AS tokens, avg(output / total_tokens) * 100 AS ratio FROM sessions WHERE started_at >= DATE '1997-02-09' GROUP BY 1)""", "sessions")
def today_baseline(spark, d):
    return reports.today_baseline(v.orders_sessions(spark, d), F.to_date(F.lit("1997-02-09"))).select("days", r("median_usd"), r("median_tokens"), r("median_output_ratio_pct"))


@query("""s AS (SELECT *, (epoch_us(started_at) - epoch_us(TIMESTAMP '1997-03-10 12:00:00')) / 86400000000.0 + 14 AS pos FROM sessions WHERE started_at <= TIMESTAMP '1997-03-10 12:00:00'),
b AS (SELECT least(CAST(floor(pos) AS INT), 13) AS slot, sum(usd) AS usd, count(*) AS n FROM s WHERE pos >= 0 GROUP BY 1),
p AS (SELECT avg(coalesce(usd, 0)) AS a, median(coalesce(usd, 0)) AS m, stddev_samp(coalesce(usd, 0)) AS sd, sum(coalesce(n, 0)) AS sampled FROM range(14) t(k) LEFT JOIN b ON b.slot = t.k),
m AS (SELECT sum(CASE WHEN started_at >= DATE '1997-03-01' THEN usd END) AS so_far, sum(CASE WHEN started_at >= DATE '1997-02-01' AND started_at < DATE '1997-03-01' THEN usd END) AS last_month FROM s),
x AS (SELECT *, so_far + a * 21 AS pr FROM p, m)
SELECT 'ok' AS status, 21 AS "left", CAST(sampled AS BIGINT) AS sampled, round(a, 2) AS avg_usd, round(m, 2) AS median_usd, round(so_far, 2) AS so_far, round(pr, 2) AS projected, round(greatest(0, pr - greatest(0, least(sd * 21, greatest(0, 0.2 * pr)))), 2) AS low,
round(pr + greatest(0, least(sd * 21, greatest(0, 0.2 * pr))), 2) AS high, round(last_month, 2) AS last_month, round((pr - last_month) / last_month * 100, 4) AS vs_last_month_pct FROM x""", "sessions")
def forecast(spark, d):
    s = v.orders_sessions(spark, d).filter(F.col("started_at") <= now())
    out = reports.forecast(s.withColumn("started_at", F.col("started_at").cast("timestamp")), now())
    return out.select("status", "left", "sampled", *[r(c, 2) for c in ("avg_usd", "median_usd", "so_far", "projected", "low", "high", "last_month")], r("vs_last_month_pct"))


IMPACT = """g AS (SELECT started_at >= DATE '1997-03-10' AS a, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS t, floor(sum(usd) * 100 + 0.5) / 100 AS u, floor(sum(usd) / count(*) * 100 + 0.5) / 100 AS au, floor(sum(output) / sum(total_tokens) * 1000 + 0.5) / 10 AS ra,
 CAST(sum(dup_tokens + idle_tokens + cache_write) AS BIGINT) AS rec FROM sessions GROUP BY 1), x AS (SELECT * FROM g b, g c WHERE NOT b.a AND c.a)"""


@query(f"""{IMPACT} SELECT 'measured' AS status, b.n AS before_sessions, c.n AS after_sessions, b.t AS before_tokens, c.t AS after_tokens, b.u AS before_usd, c.u AS after_usd, b.au AS before_avg_usd, c.au AS after_avg_usd, b.ra AS before_ratio, c.ra AS after_ratio,
 b.rec AS before_recoverable, c.rec AS after_recoverable, c.t - b.t AS token_delta, floor((c.t - b.t) / b.t * 1000 + 0.5) / 10 AS token_delta_pct, round(c.u - b.u, 2) AS usd_delta, round(c.au - b.au, 2) AS avg_usd_delta, round(c.ra - b.ra, 1) AS ratio_delta_pp FROM g b, g c WHERE NOT b.a AND c.a""", "sessions")
def impact(spark, d):
    out = reports.impact(v.orders_sessions(spark, d).withColumn("started_at", F.col("started_at").cast("timestamp")), F.to_timestamp(F.lit("1997-03-10")), F.to_timestamp(F.lit("2001-08-02")))
    cols = [f"{n}_{c}" for c in ("sessions", "tokens", "usd", "avg_usd", "ratio", "recoverable") for n in ("before", "after")]
    return out.select("status", *cols, "token_delta", "token_delta_pct", r("usd_delta", 2), r("avg_usd_delta", 2), r("ratio_delta_pp", 1))


@query("""m AS (SELECT file_id, project, ended_at, total_tokens / n_requests AS tpt, cache_read / (cache_read + input + cache_write) AS chr, dup_tokens AS dup, row_number() OVER (PARTITION BY project ORDER BY ended_at DESC, file_id DESC) AS n FROM sessions),
b AS (SELECT project, count(*) AS k, median(tpt) AS bt, median(chr) AS bc, median(dup) AS bd FROM m WHERE n BETWEEN 2 AND 7 GROUP BY 1)
SELECT project, file_id, round(tpt, 4) AS tokens_per_turn, round(chr, 4) AS cache_hit_rate, dup AS dup_tokens, k AS base_count, round(bt, 4) AS base_tokens_per_turn, tpt > bt * 1.3 AS context_up, bc >= 0.2 AND chr < bc - 0.15 AS cache_down, dup > 2 * bd AND dup > 5000 AS rereads_up FROM m JOIN b USING (project) WHERE n = 1""", "sessions")
def drift(spark, d):
    out = reports.drift(reports.drift_metrics(v.orders_sessions(spark, d)))
    return out.select("project", "file_id", r("tokens_per_turn"), r("cache_hit_rate"), "dup_tokens", "base_count", r("base_tokens_per_turn"), "context_up", "cache_down", "rereads_up")


@query("""a AS (SELECT project, sum(total_tokens) AS t FROM sessions WHERE started_at < DATE '1997-03-10' GROUP BY 1), b AS (SELECT project, sum(total_tokens) AS t FROM sessions WHERE started_at >= DATE '1997-03-10' GROUP BY 1)
SELECT project, CAST(coalesce(a.t, 0) AS BIGINT) AS before, CAST(coalesce(b.t, 0) AS BIGINT) AS after, CAST(coalesce(b.t, 0) - coalesce(a.t, 0) AS BIGINT) AS delta, round(CASE WHEN coalesce(a.t, 0) = 0 THEN 0 ELSE (coalesce(b.t, 0) - a.t) / a.t * 100 END, 4) AS pct FROM a FULL JOIN b USING (project)""", "sessions")
def benchmark_compare_pivot(spark, d):
    """All sessions: those before the pivot date against the others."""
    s = v.orders_sessions(spark, d)
    by = lambda x: x.groupBy("project").agg(F.sum("total_tokens").alias("t"))
    return reports.change_table(by(s.filter("started_at < '1997-03-10'")), by(s.filter("started_at >= '1997-03-10'")), "project", "t").withColumn("pct", F.round("pct", 4))


@query("""m AS (SELECT o_custkey || '-' || o_orderpriority AS project, s.file_id, ended_at, total_tokens / n_requests AS tpt, cache_read / (cache_read + input + cache_write) AS chr, dup_tokens AS dup FROM sessions s JOIN orders ON s.file_id = o_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ended_at DESC, file_id DESC) AS n, list(tpt) OVER e AS lt, list(dup) OVER e AS ld FROM m WINDOW e AS (ORDER BY ended_at, file_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
b AS (SELECT project, count(*) AS k, median(tpt) AS bt, median(dup) AS bd FROM n WHERE n BETWEEN 2 AND 7 GROUP BY 1)
SELECT project, file_id, CASE WHEN k >= 3 THEN 'project' ELSE 'all' END AS scope, CAST(CASE WHEN k >= 3 THEN k ELSE coalesce(len(lt), 0) END AS BIGINT) AS base_count,
round(CASE WHEN k >= 3 THEN bt ELSE coalesce(list_median(lt), 0) END, 4) AS base_tokens_per_turn, round(CASE WHEN k >= 3 THEN bd ELSE coalesce(list_median(ld), 0) END, 4) AS base_dup_tokens FROM n LEFT JOIN b USING (project) WHERE n = 1""".replace("list_median(lt)", "list_aggregate(lt, 'median')").replace("list_median(ld)", "list_aggregate(ld, 'median')"), "sessions")
def drift_sparse(spark, d):
    """Projects of few sessions each: most baselines are those of the sessions before, of any project."""
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.concat_ws("-", "o_custkey", "o_orderpriority").alias("project"))
    out = reports.drift(reports.drift_metrics(v.orders_sessions(spark, d).drop("project").join(o, "file_id")))
    return out.select("project", "file_id", "scope", "base_count", r("base_tokens_per_turn"), r("base_dup_tokens"))


# -- limits ------------------------------------------------------------------------------------------------

POINTS = """pts AS (SELECT limit_id, window_minutes, at_ms, resets_at, dense_rank() OVER (PARTITION BY limit_id ORDER BY resets_at) - 1 AS period, max(used_percent) OVER (PARTITION BY limit_id, resets_at ORDER BY at_ms, used_percent ROWS UNBOUNDED PRECEDING) AS used_percent FROM readings),
per0 AS (SELECT limit_id, window_minutes, period, min(at_ms) AS first_at, max(at_ms) AS newest_at, max(used_percent) AS used_percent, max(resets_at) AS resets_at FROM pts GROUP BY 1, 2, 3),
per AS (SELECT *, greatest(least(resets_at - window_minutes * 60000, first_at), lag(newest_at) OVER (PARTITION BY limit_id ORDER BY period)) AS started_at FROM per0),
steps AS (SELECT limit_id, period, at_ms, used_percent - lag(used_percent, 1, 0) OVER (PARTITION BY limit_id, period ORDER BY at_ms) AS rise FROM (SELECT limit_id, period, at_ms, max(used_percent) AS used_percent FROM pts GROUP BY 1, 2, 3)),
rises AS (SELECT * FROM steps WHERE rise > 0),
inside AS (SELECT p.limit_id, p.period, r.* FROM limit_requests r JOIN per p ON r.tokens > 0 AND r.at_ms > p.started_at AND r.at_ms <= p.newest_at),
seg AS (SELECT i.*, (SELECT min(x.at_ms) FROM rises x WHERE x.limit_id = i.limit_id AND x.period = i.period AND x.at_ms >= i.at_ms) AS to_at FROM inside i),
shares AS (SELECT s.*, coalesce(x.rise * s.tokens / sum(s.tokens) OVER (PARTITION BY s.limit_id, s.period, s.to_at), 0) AS percent FROM seg s LEFT JOIN rises x ON x.limit_id = s.limit_id AND x.period = s.period AND x.at_ms = s.to_at)"""


@query(f"{POINTS} SELECT limit_id, window_minutes, period, started_at, resets_at, newest_at, used_percent FROM per", "readings", "limit_requests")
def limit_periods(spark, d):
    return limits.periods(limits.points(v.readings(spark, d))).select("limit_id", "window_minutes", F.col("period").cast("long").alias("period"), "started_at", "resets_at", "newest_at", "used_percent")


@query(f"{POINTS} SELECT limit_id, period, session_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests, round(sum(percent), 6) AS percent FROM shares GROUP BY 1, 2, 3", "readings", "limit_requests")
def limit_attribution(spark, d):
    s = limits.attribute(v.limit_requests(spark, d), limits.points(v.readings(spark, d)))
    return s.groupBy("limit_id", F.col("period").cast("long").alias("period"), "session_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"), F.round(F.sum("percent"), 6).alias("percent"))


@query(f"{POINTS} SELECT limit_id, period, round(t - coalesce(g, 0), 5) + 0.0 AS unattributed_percent FROM (SELECT limit_id, period, sum(rise) AS t FROM rises GROUP BY 1, 2) LEFT JOIN (SELECT limit_id, period, sum(percent) AS g FROM shares GROUP BY 1, 2) USING (limit_id, period)", "readings", "limit_requests")
def limit_unattributed(spark, d):
    out = limits.unattributed(v.limit_requests(spark, d), limits.points(v.readings(spark, d)))
    return out.select("limit_id", F.col("period").cast("long").alias("period"), (F.round("unattributed_percent", 5) + 0.0).alias("unattributed_percent"))


@query(f"{POINTS} SELECT limit_id, period, CASE WHEN model = 'codex-auto-review' THEN '(automatic reviews)' ELSE session_id END AS line, min(split_part(cwd, '/', 3)) AS project, round(sum(percent), 6) AS percent, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests FROM shares GROUP BY 1, 2, 3", "readings", "limit_requests")
def limit_usage(spark, d):
    out = limits.usage_by_session(limits.attribute(v.limit_requests(spark, d), limits.points(v.readings(spark, d))))
    return out.select("limit_id", F.col("period").cast("long").alias("period"), "line", "project", r("percent", 6), "tokens", "requests")


@query(f"""{POINTS}, l AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY limit_id ORDER BY period DESC) = 1), y AS (SELECT *, newest_at + (100 - used_percent) * (newest_at - started_at) / used_percent AS x FROM l)
SELECT limit_id, period, CASE WHEN resets_at <= newest_at THEN 'reset-since' WHEN used_percent >= 100 THEN 'reached' WHEN newest_at - started_at < 3600000 THEN 'too-early' WHEN used_percent <= 0 OR x > resets_at THEN 'lasts' ELSE 'runs-out' END AS kind FROM y""", "readings", "limit_requests")
def limit_pace(spark, d):
    out = limits.pace(limits.periods(limits.points(v.readings(spark, d))), F.lit(0).cast("long"))
    return out.select("limit_id", F.col("period").cast("long").alias("period"), "kind")


@query(f"""{POINTS}, done AS (SELECT *, max(period) OVER (PARTITION BY limit_id) AS last FROM per), ok AS (SELECT * FROM done WHERE period < last AND used_percent >= 20),
m AS (SELECT i.limit_id, i.period, i.model, sum(i.tokens) AS t, min(i.at_ms) AS f FROM inside i GROUP BY 1, 2, 3), tot AS (SELECT limit_id, period, sum(t) AS total, max(CASE WHEN model IS NOT NULL THEN t END) AS top FROM m GROUP BY 1, 2)
SELECT limit_id, period, round(total / used_percent, 6) AS tokens_per_percent FROM ok JOIN tot USING (limit_id, period) WHERE top / total >= 0.9""", "readings", "limit_requests")
def limit_tokens_per_percent(spark, d):
    p = limits.periods(limits.points(v.readings(spark, d)))
    out = limits.tokens_per_percent(p, v.limit_requests(spark, d), F.lit(0), F.lit(0))
    return out.select("limit_id", F.col("period").cast("long").alias("period"), r("tokens_per_percent", 6))


#: The fold over readings as SQL: a recursion by the place of a reading within its limit.
WILD = """r AS (SELECT *, row_number() OVER (PARTITION BY limit_id, window_minutes ORDER BY at_ms, resets_at, used_percent, session_id) AS n FROM wild_readings WHERE at_ms <= resets_at),
f AS (SELECT limit_id, window_minutes, n, at_ms, used_percent AS used, resets_at AS reset, 0 AS period, true AS kept FROM r WHERE n = 1
 UNION ALL SELECT limit_id, window_minutes, n, at_ms, CASE WHEN skip THEN used WHEN opens THEN p ELSE greatest(used, p) END, CASE WHEN skip THEN reset ELSE z END, period + CASE WHEN opens AND NOT skip THEN 1 ELSE 0 END, NOT skip FROM
 (SELECT r.limit_id, r.window_minutes, r.n, r.at_ms, f.used, f.reset, f.period, r.used_percent AS p, r.resets_at AS z, f.reset - r.resets_at > 900000 AS skip,
  abs(r.resets_at - f.reset) > greatest(900000, r.window_minutes * 600) OR r.at_ms > f.reset OR (r.resets_at - f.reset > 900000 AND r.used_percent < f.used) AS opens FROM f JOIN r ON r.limit_id = f.limit_id AND r.window_minutes = f.window_minutes AND r.n = f.n + 1)),
per0 AS (SELECT limit_id, window_minutes, period, min(at_ms) AS first_at, max(at_ms) AS newest_at, max(used) AS used_percent, arg_max(reset, n) AS resets_at FROM f WHERE kept GROUP BY 1, 2, 3),
per AS (SELECT *, greatest(least(resets_at - window_minutes * 60000, first_at), lag(newest_at) OVER (PARTITION BY limit_id, window_minutes ORDER BY period)) AS started_at FROM per0)"""


@query(f"{WILD} SELECT limit_id, window_minutes, period, started_at, resets_at, newest_at, used_percent FROM per", "wild_readings")
def limit_periods_wild(spark, d):
    """Periods of readings with early resets, drift, falls back to older windows and stale ones."""
    return limits.periods(limits.points(v.wild_readings(spark, d))).select("limit_id", "window_minutes", "period", "started_at", "resets_at", "newest_at", "used_percent")


@query(f"""{WILD}, l AS (SELECT *, greatest(newest_at, 1706630400000) AS latest FROM per QUALIFY row_number() OVER (PARTITION BY limit_id, window_minutes ORDER BY period DESC) = 1), y AS (SELECT *, latest + (100 - used_percent) * (latest - started_at) / nullif(used_percent, 0) AS x FROM l)
SELECT limit_id, window_minutes, period, CASE WHEN resets_at <= 1706630400000 THEN 'reset-since' WHEN used_percent >= 100 THEN 'reached' WHEN latest - started_at < 3600000 THEN 'too-early' WHEN used_percent <= 0 OR x > resets_at THEN 'lasts' ELSE 'runs-out' END AS kind FROM y""", "wild_readings")
def limit_pace_wild(spark, d):
    """How each limit's newest period will end, seen from an evening on which some windows have been reset."""
    out = limits.pace(limits.periods(limits.points(v.wild_readings(spark, d))), F.lit(1706630400000))
    return out.select("limit_id", "window_minutes", "period", "kind")


# -- version regressions -----------------------------------------------------------------------------------

SEQ = """main AS (SELECT *, lag(ts) OVER w AS p_ts, lag(ctx) OVER w AS p_ctx, lead(ts) OVER w AS a_ts, lead(ctx) OVER w AS a_ctx, lead(cr) OVER w AS a_cr, lead(ts, 2) OVER w AS b_ts, lead(ctx, 2) OVER w AS b_ctx, lead(cr, 2) OVER w AS b_cr
 FROM sample_rows WHERE NOT side AND entry NOT LIKE 'sdk%' WINDOW w AS (PARTITION BY file_id ORDER BY ts, turn_idx))"""
RATES = "g AS (SELECT version, count(*) AS n, count(*) FILTER (value) AS h FROM s GROUP BY 1), t AS (SELECT version, n, round(h / n, 6) AS rate, round(coalesce((sum(h) OVER () - h) / nullif(sum(n) OVER () - n, 0), 0), 6) AS baseline, CAST(sum(n) OVER () - n AS BIGINT) AS baseline_n FROM g)"


@query(f"{SEQ}, s AS (SELECT version, cr < 0.3 * ctx AS value FROM main WHERE ts - p_ts BETWEEN 0 AND 300000 AND ctx >= 30000 AND ctx >= 0.6 * p_ctx), {RATES} SELECT * FROM t WHERE n >= 20", "sample_rows")
def regress_warm_cache_miss(spark, d):
    return regress.warm_cache_miss(v.sample_rows(spark, d)).select("version", "n", r("rate", 6), r("baseline", 6), "baseline_n")


@query(f"{SEQ.replace("FROM sample_rows", "FROM idle_rows")}, s AS (SELECT version, a_cr < 0.3 * a_ctx AND b_cr < 0.3 * b_ctx AS value FROM main WHERE ts - p_ts >= 3600000 AND a_ts - ts <= 300000 AND b_ts - a_ts <= 300000 AND a_ctx >= 30000 AND b_ctx >= 30000), {RATES} SELECT * FROM t WHERE n >= 5", "sample_rows", "idle_rows")
def regress_post_idle_cold(spark, d):
    return regress.post_idle_cold(v.idle_rows(spark, d)).select("version", "n", r("rate", 6), r("baseline", 6), "baseline_n")


@query(f"{SEQ}, g AS (SELECT version, count(*) AS n, sum(c5) / sum(c5 + c1) AS share_5m FROM main WHERE c5 + c1 > 0 GROUP BY 1 HAVING count(*) >= 20) SELECT version, n, round(share_5m, 6) AS share_5m, round((sum(share_5m * n) OVER () - share_5m * n) / (sum(n) OVER () - n), 6) AS baseline FROM g", "sample_rows")
def regress_short_ttl(spark, d):
    return regress.short_ttl(v.sample_rows(spark, d)).select("version", "n", r("share_5m", 6), r("baseline", 6))


@query(f"""{SEQ}, g AS (SELECT model, version, count(*) AS n, list_sort(list(inp))[count(*) // 2 + 1] AS median FROM main WHERE after_tool AND ctx >= 20000 GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT model, version, n, median, (SELECT list_sort(list(o.median))[count(*) // 2 + 1] FROM g o WHERE o.model = g.model AND o.version <> g.version) AS baseline FROM g""", "sample_rows")
def regress_uncached_input(spark, d):
    return regress.uncached_input(v.sample_rows(spark, d)).select("model", "version", "n", "median", "baseline")


@query(f"""{SEQ}, e AS (SELECT version, (ts - lag(ts) OVER (PARTITION BY file_id ORDER BY ts, turn_idx)) / 60000 AS gap FROM main WHERE ts - p_ts <= 300000 AND p_ctx >= 50000 AND ctx >= 0.6 * p_ctx AND cr < 0.2 * p_ctx)
SELECT version, count(gap) AS n, count(*) FILTER (gap BETWEEN 50 AND 70) AS hourly FROM e GROUP BY 1""", "sample_rows")
def regress_hourly_rebuild(spark, d):
    return regress.hourly_rebuild(v.sample_rows(spark, d)).select("version", "n", "hourly")


@query("""x AS (SELECT version, file_id, side OR entry LIKE 'sdk%' AS auto FROM sample_rows) SELECT count(*) FILTER (NOT auto) AS requests, count(*) FILTER (auto) AS excluded, count(DISTINCT CASE WHEN NOT auto THEN file_id END) AS sessions,
 count(DISTINCT CASE WHEN NOT auto THEN version END) AS versions, arg_min(version, CAST(split_part(version, '.', 3) AS INT)) AS first_version, arg_max(version, CAST(split_part(version, '.', 3) AS INT)) AS last_version FROM x""", "sample_rows")
def regress_coverage(spark, d):
    return regress.coverage(v.sample_rows(spark, d)).select("requests", "excluded", "sessions", "versions", "first_version", "last_version")


@query("""t AS (SELECT DISTINCT version, CAST(split_part(version, '.', 3) AS INT) AS m FROM sample_rows), i AS (SELECT *, row_number() OVER (ORDER BY m) AS i FROM t), f AS (SELECT *, i - row_number() OVER (ORDER BY i) AS g FROM i WHERE m % 5 <> 0),
rg AS (SELECT arg_min(version, m) AS "from", arg_max(version, m) AS "to", min(m) AS a, max(m) AS b, count(*) AS versions FROM f GROUP BY g)
SELECT "from", "to", versions, CASE WHEN a <= 89 AND b >= 69 THEN CASE WHEN a <= 100 AND b >= 85 THEN 'R2,R3' ELSE 'R2' END WHEN a <= 100 AND b >= 85 THEN 'R3' ELSE '' END AS known FROM rg""", "sample_rows")
def regress_ranges(spark, d):
    t = v.sample_rows(spark, d).select("version", (F.split("version", r"\.")[2].cast("int") % 5 != 0).alias("flagged")).distinct()
    return regress.match_known(regress.merge_ranges(t), regress.known(spark), "warm-cache-miss").select("from", "to", "versions", F.array_join("known", ",").alias("known"))


# -- estimates, benchmarks, files, stores ------------------------------------------------------------------

SHAPES = """shapes AS (SELECT file_id, count(*) AS tool_calls, count(DISTINCT CASE WHEN name = 'Read' AND path <> '' THEN lower(path) END) AS distinct_reads FROM calls GROUP BY 1),
toks AS (SELECT file_id, CAST(round(sum(input + output * 5.0 + cache_read * 0.1 + cache_write * 1.25)) AS BIGINT) AS tokens FROM turns GROUP BY 1),
tiered AS (SELECT *, CASE WHEN tool_calls >= 30 AND distinct_reads >= 20 THEN 'high' WHEN tool_calls BETWEEN 10 AND 29 AND distinct_reads BETWEEN 5 AND 19 THEN 'medium' WHEN tool_calls < 10 AND distinct_reads < 5 THEN 'low' END AS tier FROM toks JOIN shapes USING (file_id))"""


@query(f"{SHAPES} SELECT tier, count(*) AS matched, CAST(floor(median(tokens) + 0.5) AS BIGINT) AS median_tokens, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM tiered WHERE tier IS NOT NULL AND tokens BETWEEN 1 AND 5000000 GROUP BY 1", "calls", "turns")
def estimate_anchors(spark, d):
    turns = v.call_requests(spark, d).withColumn("cache_write_1h", F.lit(0).cast("long"))
    return estimate.anchors(estimate.shapes(turns, v.calls(spark, d)))


def _tasks(spark: SparkSession, d: str, task=None) -> DataFrame:
    """Projects (or another column) as tasks: every session is in one arm, before the pivot date or from it on."""
    s = v.orders_sessions(spark, d)
    side = lambda p, when: s.filter(when).groupBy((F.col("project") if task is None else task).alias("task")).agg(*[F.sum(x).alias(f"{p}_{y}") for x, y in (("total_tokens", "total"), ("cache_write", "cache_write"), ("output", "output"), ("dup_tokens", "dup_reads"), ("usd", "usd"))])
    return side("base", "started_at < '1997-03-10'").join(side("opt", "started_at >= '1997-03-10'"), "task")


TASKS = """b AS (SELECT project AS task, sum(total_tokens) AS t, sum(cache_write) AS w, sum(output) AS o, sum(dup_tokens) AS r, sum(usd) AS u FROM sessions WHERE started_at < DATE '1997-03-10' GROUP BY 1),
p AS (SELECT project AS task, sum(total_tokens) AS t, sum(cache_write) AS w, sum(output) AS o, sum(dup_tokens) AS r, sum(usd) AS u FROM sessions WHERE started_at >= DATE '1997-03-10' GROUP BY 1),
raw AS (SELECT task, b.t AS bt, p.t AS pt, b.u - p.u AS usd, greatest(0, b.t - p.t) AS saved, floor((b.t - p.t) / b.t * 1000 + 0.5) / 10 AS pct, greatest(0, b.w - p.w) AS x, greatest(0, b.o - p.o) AS y, greatest(0, b.r - p.r) AS z FROM b JOIN p USING (task)),
scaled AS (SELECT *, CASE WHEN x + y + z = 0 THEN 0 ELSE floor(x * k + 0.5) END AS a1, CASE WHEN x + y + z = 0 THEN 0 ELSE floor(y * k + 0.5) END AS a2, CASE WHEN x + y + z = 0 THEN 0 ELSE floor(z * k + 0.5) END AS a3
 FROM (SELECT *, CASE WHEN saved > 0 THEN saved / (x + y + z) ELSE 1.0 END AS k FROM raw)),
done AS (SELECT *, CASE WHEN x + y + z > 0 AND saved > 0 THEN saved - a1 - a2 - a3 ELSE 0 END AS drift, CASE WHEN a1 >= a2 AND a1 >= a3 THEN 1 WHEN a2 >= a3 THEN 2 ELSE 3 END AS into_part FROM scaled),
parts AS (SELECT *, CAST(a1 + CASE WHEN into_part = 1 THEN drift ELSE 0 END AS BIGINT) AS manifest, CAST(a2 + CASE WHEN into_part = 2 THEN drift ELSE 0 END AS BIGINT) AS output, CAST(a3 + CASE WHEN into_part = 3 THEN drift ELSE 0 END AS BIGINT) AS reads FROM done)"""


@query(f"{TASKS} SELECT task, pct AS saved_pct, CAST(saved AS BIGINT) AS saved_tokens, manifest, output, reads FROM parts", "sessions")
def benchmark_tasks_pivot(spark, d):
    return benchmarks.saved(_tasks(spark, d)).select("task", "saved_pct", "saved_tokens", "manifest", "output", "reads")


@query(f"{TASKS} SELECT count(*) AS tasks, floor(median(pct) * 10 + 0.5) / 10 AS median_saved_pct, min(pct) AS min_saved_pct, max(pct) AS max_saved_pct, CAST(sum(bt) AS BIGINT) AS base_total, CAST(sum(pt) AS BIGINT) AS opt_total, CAST(sum(manifest) AS BIGINT) AS manifest, CAST(sum(output) AS BIGINT) AS output, CAST(sum(reads) AS BIGINT) AS reads FROM parts", "sessions")
def benchmark_suite_pivot(spark, d):
    return benchmarks.suite(benchmarks.saved(_tasks(spark, d))).select("tasks", "median_saved_pct", "min_saved_pct", "max_saved_pct", "base_total", "opt_total", "manifest", "output", "reads")


CONDITIONS = ("off", "on", "rtk")
LIVE = ", ".join(f"count(*) FILTER (c = '{c}') AS {c}_runs, median(total_tokens) FILTER (c = '{c}') AS {c}_tokens, round(median(usd) FILTER (c = '{c}'), 4) AS {c}_usd" for c in CONDITIONS)


@query(f"m AS (SELECT task, {LIVE} FROM (SELECT project AS task, total_tokens, usd, {list(CONDITIONS)}[1 + file_id % 3] AS c FROM sessions WHERE total_tokens > 0) GROUP BY 1) SELECT *, "
 + ", ".join(f"CAST(coalesce(floor((off_tokens - {c}_tokens) / off_tokens * 100 + 0.5), 0) AS BIGINT) AS {c}_saved_pct" for c in CONDITIONS[1:]) + " FROM m", "sessions")
def benchmark_live(spark, d):
    rows = v.orders_sessions(spark, d).select(F.col("project").alias("task"), F.element_at(F.array(*map(F.lit, CONDITIONS)), (F.col("file_id") % 3 + 1).cast("int")).alias("condition"), "total_tokens", "usd")
    cols = [x for c in CONDITIONS for x in (F.col(f"{c}_runs"), F.col(f"{c}_tokens"), r(f"{c}_usd"))]
    return benchmarks.live(rows).select("task", *cols, *[f"{c}_saved_pct" for c in CONDITIONS[1:]])


@query("SELECT path, count(*) AS changes FROM calls WHERE path IN (SELECT path FROM calls WHERE name = 'Edit') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "calls")
def hot_files(spark, d):
    c = v.calls(spark, d)
    return files.hot_files(c.select("path"), c.filter("name = 'Edit'"))


@query("e AS (SELECT DISTINCT file_id AS importer, path AS imported FROM calls), u AS (SELECT imported, count(*) AS used_by FROM e GROUP BY 1) SELECT importer, CAST(place AS INTEGER) AS place, imported, used_by FROM (SELECT *, row_number() OVER (PARTITION BY importer ORDER BY used_by DESC, imported) AS place FROM e JOIN u USING (imported)) WHERE place <= 5", "calls")
def dearest_imports(spark, d):
    return files.dearest_imports(v.calls(spark, d).select(F.col("file_id").alias("importer"), F.col("path").alias("imported")).filter("imported is not null"))


def _rewrites(spark: SparkSession, d: str) -> DataFrame:
    return v.calls(spark, d).select(F.col("name").alias("rewriter_name"), F.col("result_tokens").alias("saved_tokens"), F.when(F.col("call_idx") % 3 > 0, F.col("call_idx") % 10 / 10).alias("integrity"))


@query("SELECT name AS rewriter_name, count(*) AS events, CAST(sum(result_tokens) AS BIGINT) AS saved_tokens, round(avg(CASE WHEN call_idx % 3 > 0 THEN call_idx % 10 / 10 END), 6) AS avg_integrity, count(CASE WHEN call_idx % 3 > 0 THEN 1 END) AS with_integrity FROM calls GROUP BY 1", "calls")
def rewrite_report(spark, d):
    return stores.rewrite_report(_rewrites(spark, d)).withColumn("avg_integrity", F.round("avg_integrity", 6))


@query("SELECT file_id, call_idx, name FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY call_idx DESC) AS k FROM calls) WHERE k <= 7", "calls")
def newest_signals(spark, d):
    return stores.newest(v.calls(spark, d).select("file_id", "call_idx", "name"), "call_idx", 7, by="file_id")


@query("SELECT path, max(call_idx * 100000 + file_id) AS seen FROM calls GROUP BY 1", "calls")
def read_cache_last_wins(spark, d):
    return stores.last_wins(v.calls(spark, d).select("path", (F.col("call_idx") * 100000 + F.col("file_id")).alias("seen")), "path", "seen")


# -- the same operators asked otherwise ------------------------------------------------------------------------


@query(f"""days AS (SELECT CAST(started_at AS DATE) AS day, count(*) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(usd) AS usd {WINDOW} GROUP BY 1)
SELECT CAST(d.day AS VARCHAR) AS day, coalesce(sessions, 0) AS sessions, coalesce(total_tokens, 0) AS total_tokens, round(coalesce(usd, 0), 2) AS usd
FROM (SELECT CAST(unnest(generate_series(DATE '1996-03-01', DATE '1997-04-01', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN days b ON b.day = d.day""", "sessions")
def stats_daily(spark, d):
    """By day between two given days: every day of the window, and three weeks after it, which are empty."""
    out = reports.daily(_window(spark, d), F.to_date(F.lit("1996-03-01")), F.to_date(F.lit("1997-04-01")), most=None)
    return out.select(F.col("day").cast("string").alias("day"), "sessions", "total_tokens", r("usd", 2))


@query("""a AS (SELECT primary_model, sum(usd) AS u FROM sessions WHERE started_at < DATE '1997-03-10' GROUP BY 1), b AS (SELECT primary_model, sum(usd) AS u FROM sessions WHERE started_at >= DATE '1997-03-10' GROUP BY 1)
SELECT primary_model, round(coalesce(a.u, 0), 2) AS before, round(coalesce(b.u, 0), 2) AS after, round(coalesce(b.u, 0) - coalesce(a.u, 0), 2) AS delta, round(CASE WHEN coalesce(a.u, 0) = 0 THEN 0 ELSE (coalesce(b.u, 0) - a.u) / a.u * 100 END, 4) AS pct FROM a FULL JOIN b USING (primary_model)""", "sessions")
def benchmark_compare(spark, d):
    """Dollars by model before and after the pivot date."""
    s = v.orders_sessions(spark, d)
    by = lambda x: x.groupBy("primary_model").agg(F.sum("usd").alias("usd"))
    out = reports.change_table(by(s.filter("started_at < '1997-03-10'")), by(s.filter("started_at >= '1997-03-10'")), "primary_model", "usd")
    return out.select("primary_model", r("before", 2), r("after", 2), r("delta", 2), r("pct"))


BY_MONTH = TASKS.replace("project AS task", "CAST(month(started_at) AS VARCHAR) AS task")


def _months(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d, F.month("started_at").cast("string"))


@query(f"{BY_MONTH} SELECT task, pct AS saved_pct, CAST(saved AS BIGINT) AS saved_tokens, manifest, output, reads FROM parts", "sessions")
def benchmark_tasks(spark, d):
    """Months of the year as tasks."""
    return benchmarks.saved(_months(spark, d)).select("task", "saved_pct", "saved_tokens", "manifest", "output", "reads")


@query(f"{BY_MONTH} SELECT count(*) AS tasks, floor(median(pct) * 10 + 0.5) / 10 AS median_saved_pct, min(pct) AS min_saved_pct, max(pct) AS max_saved_pct, CAST(sum(bt) AS BIGINT) AS base_total, CAST(sum(pt) AS BIGINT) AS opt_total, CAST(sum(manifest) AS BIGINT) AS manifest, CAST(sum(output) AS BIGINT) AS output, CAST(sum(reads) AS BIGINT) AS reads FROM parts", "sessions")
def benchmark_suite(spark, d):
    """Months of the year as one suite."""
    return benchmarks.suite(benchmarks.saved(_months(spark, d))).select("tasks", "median_saved_pct", "min_saved_pct", "max_saved_pct", "base_total", "opt_total", "manifest", "output", "reads")


@query("""SELECT agent, count(*) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(usd), 2) AS usd FROM (SELECT CASE WHEN file_id % 3 = 0 THEN 'b' ELSE 'a' END AS agent, total_tokens, usd FROM sessions) GROUP BY ROLLUP (agent)""", "sessions")
def agent_totals(spark, d):
    """Each agent's sessions and those of all."""
    s = v.orders_sessions(spark, d).select(F.when(F.col("file_id") % 3 == 0, "b").otherwise("a").alias("agent"), F.lit(1).cast("long").alias("sessions"), "total_tokens", "usd")
    return reports.combined(s).select("agent", "sessions", "total_tokens", r("usd", 2))


@query("SELECT id FROM (VALUES ('R1', 257, 259), ('R2', 69, 89), ('R3', 85, 100), ('R4', 0, 128), ('R5', 0, 247)) k(id, a, b) WHERE EXISTS (SELECT 1 FROM sample_rows WHERE CAST(split_part(version, '.', 3) AS INT) BETWEEN a AND b)", "sample_rows")
def known_in_logs(spark, d):
    """Known regressions whose versions the logs hold."""
    return regress.covered(v.sample_rows(spark, d), regress.known(spark))


@query("SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS family FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def session_families(spark, d):
    """Orders that go on from the customer's order before, as families."""
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), before.alias("other")).filter("other is not null")
    return requests.families(edges)


@query("SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-30 12:00:00') AS active FROM events")
def active_sessions(spark, d):
    """Files written to in the twelve hours before a moment; an event is a file."""
    files_ = v.table(spark, d, "events").select(F.col("event_id").alias("path"), F.col("ts").cast("timestamp").alias("mtime"))
    return usage.active_sessions(files_, F.to_timestamp(F.lit("2024-01-31 00:00:00")), minutes=720)


# -- repositories: documents as their files -------------------------------------------------------------------


@query(repo_views.IMPORTS)
def repo_imports(spark, d):
    """Imports that are files of the same repository, and how many files import each."""
    rows = repo_views.files(spark, d)
    edges = repo_audit.edges(repo_audit.imports(rows), rows)
    used = edges.groupBy("repo", "imported").agg(F.count(F.lit(1)).alias("used_by"))
    return edges.join(used, ["repo", "imported"]).select("repo", "importer", "imported", "used_by")


@query(repo_views.PURPOSES)
def repo_purposes(spark, d):
    """What each source file is for."""
    rows = repo_views.files(spark, d).filter("listed and language <> 'other'")
    return rows.select("repo", "path", code.purpose(F.col("path"), F.col("content"), F.col("language")).alias("purpose"))


@query(repo_views.SCORES)
def repo_scores(spark, d):
    """Each repository's score by 24 checks."""
    return repo_audit.score(repo_audit.verdicts(repo_views.files(spark, d))).drop("to_mend")


@query(repo_views.BUILT)
def repo_built_with(spark, d):
    """What each repository is built and tested with, and how its files are named."""
    return repo_audit.built_with(repo_views.files(spark, d)).drop("languages", "build_tool", "monorepo")


# -- tasks and searches ---------------------------------------------------------------------------------------

ASKED = """SELECT conv_id, turn, concat(CASE (conv_id + turn) % 9 WHEN 0 THEN 'Refactor everywhere:' WHEN 1 THEN 'just fix src/a.py and SRC/A.py' WHEN 2 THEN 'add 7 files' WHEN 3 THEN 'Rename the foo module' WHEN 4 THEN 'explain 12 services globally'
 WHEN 5 THEN 'cover the auth service, lib/b.ts' WHEN 6 THEN 'debugging is on' WHEN 7 THEN 'only document' ELSE '' END, ' ', text) AS text FROM conversations WHERE role = 'user'"""
SAID = f"""said AS ({ASKED}), low AS (SELECT *, lower(text) AS l FROM said),
counted AS (SELECT *, CASE WHEN regexp_matches(l, '\\b(refactor|rewrite|migrate|redesign|restructure|overhaul|port)\\b') THEN 'refactor' WHEN regexp_matches(l, '\\b(implement|add|build|create|introduce|ship)\\b') THEN 'implement'
 WHEN regexp_matches(l, '\\b(fix|debug|investigate|diagnose|troubleshoot|repair|resolve)\\b') THEN 'debug' WHEN regexp_matches(l, '\\b(rename|move|delete|remove|comment|uncomment|format)\\b') THEN 'rename'
 WHEN regexp_matches(l, '\\b(explain|review|audit|describe|summarize|document)\\b') THEN 'review' WHEN regexp_matches(l, '\\b(test|spec|cover)\\b') THEN 'test' ELSE 'other' END AS verb,
 greatest(len(list_distinct(regexp_extract_all(l, '[a-z/]+\\.(?:py|ts)\\b'))) + len(list_distinct(regexp_extract_all(l, '\\bthe ([a-z]+) (?:module|service)\\b', 1))), coalesce(TRY_CAST(regexp_extract(l, '\\b([0-9]+)\\s+(?:files?|services?)\\b', 1) AS BIGINT), 0)) AS files,
 regexp_matches(l, '\\b(everywhere|globally|project-wide|every|all (files|modules|packages|tests)|across the (codebase|repo|project))\\b') AS wide, regexp_matches(l, '\\b(just|only|single|one[- ]line|one[- ]liner|quick|tiny|trivial)\\b') AS narrow,
 len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM low),
s0 AS (SELECT *, CASE verb WHEN 'refactor' THEN 2 WHEN 'debug' THEN 2 WHEN 'implement' THEN 1 WHEN 'other' THEN 1 ELSE 0 END AS v FROM counted),
s1 AS (SELECT *, least(2, v + CASE WHEN files >= 12 THEN 2 WHEN files >= 6 THEN 1 ELSE 0 END + CASE WHEN wide THEN 1 ELSE 0 END) AS v1 FROM s0),
s2 AS (SELECT *, least(2, greatest(0, v1 - CASE WHEN narrow THEN 1 ELSE 0 END) + CASE WHEN words >= 60 THEN 1 ELSE 0 END) AS v2 FROM s1)"""


def _tasks_asked(spark: SparkSession, d: str) -> DataFrame:
    return estimate.classified(spark.sql(ASKED.replace("FROM conversations", "FROM {conversations}"), conversations=v.table(spark, d, "conversations")))


@query(f"WITH {SAID} SELECT conv_id, turn, verb, ['low', 'medium', 'high'][v2 + 1] AS tier, CAST(files AS BIGINT) AS files, CAST(words AS INT) AS words FROM s2")
def task_complexity(spark, d):
    """What each user's turn asks for."""
    return _tasks_asked(spark, d).select("conv_id", "turn", "verb", "tier", "files", "words")


@query(f"""WITH {SAID}, t AS (SELECT *, CASE verb WHEN 'debug' THEN [50250, 104000, 186750][v2 + 1] ELSE [26500, 85000, 167750][v2 + 1] END + 5100 AS base FROM s2),
p AS (SELECT *, CAST(CASE v2 WHEN 0 THEN floor(base * (1 - 0.8) + 40000 * 0.8 + 0.5) WHEN 1 THEN floor(base * (1 - 0.6) + 90000 * 0.6 + 0.5) ELSE base END AS BIGINT) AS tokens FROM t)
SELECT conv_id, turn, tokens, CAST(floor(tokens * 0.7::DOUBLE + 0.5) AS BIGINT) AS tokens_low, CAST(floor(tokens * 1.4::DOUBLE + 0.5) AS BIGINT) AS tokens_high, CASE WHEN v2 = 0 THEN 'haiku' WHEN v2 = 2 AND verb <> 'debug' THEN 'opus' ELSE 'sonnet' END AS model,
 floor(tokens * 3.0::DOUBLE / 1000000 * 10000 + 0.5) / 10000 AS usd_sonnet FROM p""")
def task_predictions(spark, d):
    """Tokens and dollars of each user's turn, blended with two tiers of past sessions."""
    past = spark.createDataFrame([("low", 4, 40000, "high"), ("medium", 2, 90000, "medium")], "tier string, matched long, median_tokens long, confidence string")
    out = estimate.costs(estimate.predicted(_tasks_asked(spark, d), past, repo_files=100, manifest_tokens=100), {"sonnet": 3.0})
    return out.select("conv_id", "turn", "tokens", "tokens_low", "tokens_high", estimate.family().alias("model"), "usd_sonnet")


SEARCHES = """SELECT user_id AS session, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, event_id AS line, CASE event_type WHEN 'signup' THEN 'Grep' WHEN 'purchase' THEN 'Bash' WHEN 'error' THEN 'Glob' ELSE 'Read' END AS name,
 CASE event_type WHEN 'signup' THEN CASE event_id % 5 WHEN 0 THEN 'Load' WHEN 1 THEN 'load_all' WHEN 2 THEN 'All$' WHEN 3 THEN '(' ELSE '' END WHEN 'error' THEN '*.py' END AS pattern, CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'rg -n read' ELSE 'ls' END END AS command FROM events"""


@query(f"""WITH calls AS ({SEARCHES}), sig AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ms, line DESC) AS n FROM (SELECT session, ms, line, name, CASE WHEN name = 'Bash' THEN CASE WHEN command LIKE 'rg%' THEN 'read' END ELSE nullif(pattern, '') END AS pattern FROM calls WHERE name <> 'Read') WHERE pattern IS NOT NULL),
near AS (SELECT r.line AS read_id, s.n, s.pattern, s.name FROM calls r JOIN sig s ON s.session = r.session AND s.ms <= r.ms WHERE r.name = 'Read' QUALIFY row_number() OVER (PARTITION BY r.line ORDER BY s.n DESC) <= 200),
rates AS (SELECT * FROM (VALUES ('loadAll', 'Load', 0.7 + 0.1 * 4 / 7), ('loadAll', 'All$', 0.7), ('READ', 'read', 0.95), ('load', 'Load', 0.95), ('load', 'load_all', 0.75)) v(symbol, pattern, c)),
best AS (SELECT read_id, symbol, max(c) AS c, arg_max(pattern, (c, n)) AS pattern FROM near JOIN rates USING (pattern) WHERE name <> 'Glob' GROUP BY ALL)
SELECT r.line AS read_id, x.symbol, round(coalesce(c, 0), 6) AS confidence, b.pattern FROM calls r CROSS JOIN (VALUES ('loadAll'), ('READ'), ('load')) x(symbol) LEFT JOIN best b ON b.read_id = r.line AND b.symbol = x.symbol WHERE r.name = 'Read'""")
def symbol_scores(spark, d):
    """How well three symbols of each file read fit what the session searched for up to then."""
    calls = spark.sql(SEARCHES.replace("FROM events", "FROM {events}").replace("epoch_us(ts)", "unix_micros(CAST(ts AS TIMESTAMP))"), events=v.table(spark, d, "events")).withColumnRenamed("ms", "at")
    reads = calls.filter("name = 'Read'").select("session", "at", F.col("line").alias("read_id"))
    known = signals.as_of(signals.derived(calls), reads)
    symbols = reads.select("read_id", F.explode(F.array(*map(F.lit, ("loadAll", "READ", "load")))).alias("symbol"))
    return signals.scored(symbols, known).select("read_id", "symbol", r("confidence", 6), "pattern")
