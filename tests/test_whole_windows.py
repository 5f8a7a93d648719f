"""Queries that take every order, counted against the table itself."""

import datetime

from pyspark.sql import functions as F

from ledgerspark.operators import reports
from ledgerspark.plans import registry
from ledgerspark.plans import trace_views as v

TABLES = "/root/testdata/sf0.001"
NEW = ("stats_daily_all", "benchmark_tasks_pivot", "benchmark_suite_pivot", "benchmark_compare_pivot")


def test_no_ids_are_left_out():
    for name in NEW:
        assert "WHERE file_id %" not in registry.SQL[name] and "AND file_id %" not in registry.SQL[name] and "1995-02-01" not in registry.SQL[name]


def test_daily_counts_every_session_of_its_days(spark):
    days = {str(r.day): r.sessions for r in registry.QUERIES["stats_daily_all"](spark, TABLES).collect()}
    s = v.orders_sessions(spark, TABLES).groupBy(F.to_date("started_at").alias("day")).count()
    want = {str(r.day): r["count"] for r in s.collect() if min(days) <= str(r.day) <= max(days)}
    assert {d: n for d, n in days.items() if n} == want
    newest = s.filter("day < '1997-03-11'").agg(F.max("day")).first()[0]
    assert max(days) == str(newest) and len(days) == 366


def test_daily_between_given_days_counts_every_session_of_the_window(spark):
    got = {str(r.day): r.sessions for r in registry.QUERIES["stats_daily"](spark, TABLES).collect()}
    s = v.orders_sessions(spark, TABLES).filter("started_at >= '1996-03-01' and started_at < '1997-03-11'")
    assert {d: n for d, n in got.items() if n} == {str(r.day): r["count"] for r in s.groupBy(F.to_date("started_at").alias("day")).count().collect()}
    assert (min(got), max(got), len(got)) == ("1996-03-01", "1997-04-01", 397) and not any(n for d, n in got.items() if d > "1997-03-10")


def test_daily_fills_empty_days(spark):
    at = [(datetime.datetime(2024, 2, 27, 23), 5, 1.0), (datetime.datetime(2024, 3, 1), 7, 2.0), (datetime.datetime(2024, 3, 1, 9), 1, 0.5)]
    got = reports.daily(spark.createDataFrame(at, "started_at timestamp, total_tokens long, usd double")).orderBy("day").collect()
    assert [(str(r.day), r.sessions, r.total_tokens, r.usd) for r in got] == [("2024-02-27", 1, 5, 1.0), ("2024-02-28", 0, 0, 0.0), ("2024-02-29", 0, 0, 0.0), ("2024-03-01", 2, 8, 2.5)]


def test_every_session_is_in_one_arm(spark):
    total = v.orders_sessions(spark, TABLES).agg(F.sum("total_tokens")).first()[0]
    a = registry.QUERIES["benchmark_compare_pivot"](spark, TABLES).agg(F.sum(F.col("before") + F.col("after"))).first()[0]
    b = registry.QUERIES["benchmark_suite_pivot"](spark, TABLES).first()
    assert a == total == b.base_total + b.opt_total
    assert registry.QUERIES["benchmark_tasks_pivot"](spark, TABLES).count() == b.tasks
