"""The usage cache: unchanged logs are not read, changed ones are, and copies are found in files that a window leaves out."""

import datetime as dt
import os

from pyspark.sql import functions as F

from ledgerspark.operators.requests import own_requests, sessions_of
from ledgerspark.sources import assistant_logs, usage_cache

from .test_sources import LINES, assistant, user, write

USAGE = {"input_tokens": 7, "output_tokens": 8}


def stamp(path, day):
    t = dt.datetime(2026, 1, day, 12, tzinfo=dt.timezone.utc).timestamp()
    os.utime(path, (t, t))


def spoiled(path):
    """Other bytes, with the size and time of before: whoever reads them finds nothing."""
    was = path.stat()
    path.write_bytes(b"x" * was.st_size)
    os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))


def table(df):
    return sorted(map(str, df.select(*sorted(c for c, t in df.dtypes if "variant" not in t)).collect()))


def same(a, b):
    return all(table(getattr(a, t)) == table(getattr(b, t)) for t in usage_cache.TABLES)


def test_a_segment_is_written_from_lines_parsed_once(spark, tmp_path):
    write(tmp_path / "logs" / "p" / "a.jsonl", LINES)
    source = assistant_logs.cached(spark, str(tmp_path / "logs"))
    logs = source.parse([r["open"] for r in source.files().collect()])
    (tmp_path / "logs" / "p" / "a.jsonl").unlink()  # whoever would read the lines again finds none
    segment = usage_cache.segment_of(str(tmp_path / "cache"), logs)
    assert {t: spark.read.parquet(f"{tmp_path}/cache/{t}/segment={segment}").count() for t in usage_cache.TABLES} == {"requests": 3, "calls": 2, "sessions": 1}


def test_unchanged_logs_are_not_read_again(spark, tmp_path):
    logs, cache = tmp_path / "logs", str(tmp_path / "cache")
    write(logs / "p" / "a.jsonl", LINES)
    write(logs / "p" / "b [x] {y}*.jsonl", [user("hi", 1), assistant(9, "m9", "r9", USAGE, [], 55)])
    write(logs / "q" / "c d.jsonl", [assistant(8, "m8", "r8", USAGE, [], 5)])
    (logs / "q" / "empty.jsonl").write_text("")
    source = assistant_logs.cached(spark, str(logs))
    want = assistant_logs.read(spark, str(logs))
    plain = {t: table(getattr(want, t)) for t in usage_cache.TABLES}
    first = usage_cache.load(spark, cache, source)
    assert (first.discovered, first.read, first.unreadable) == (3, 3, 0) and {t: table(getattr(first.logs, t)) for t in usage_cache.TABLES} == plain

    spoiled(logs / "p" / "a.jsonl")
    second = usage_cache.load(spark, cache, source)
    assert second.read == 0 and {t: table(getattr(second.logs, t)) for t in usage_cache.TABLES} == plain

    write(logs / "q" / "c d.jsonl", [assistant(8, "m8", "r8", USAGE, [], 5), assistant(7, "m7", "r7", USAGE, [], 6)])
    third = usage_cache.load(spark, cache, source)
    assert third.read == 1 and third.logs.requests.count() == first.logs.requests.count() + 1

    (logs / "q" / "c d.jsonl").unlink()
    fourth = usage_cache.load(spark, cache, source)
    assert fourth.read == 0 and not {"c d"} & {r.file_id for r in fourth.logs.sessions.collect()}
    before = {t: table(getattr(fourth.logs, t)) for t in usage_cache.TABLES}
    usage_cache.compact(spark, cache, source)
    fifth = usage_cache.load(spark, cache, source)
    assert fifth.read == 0 and {t: table(getattr(fifth.logs, t)) for t in usage_cache.TABLES} == before

    other = usage_cache.load(spark, cache, source, header="session tables, 2")
    assert other.read == 2 and not {"a"} & {r.file_id for r in other.logs.requests.collect()}  # the spoiled file was read


def test_a_run_that_dies_before_its_commit_leaves_the_version_before(spark, tmp_path, monkeypatch):
    logs, cache = tmp_path / "logs", str(tmp_path / "cache")
    write(logs / "p" / "a.jsonl", LINES)
    source = assistant_logs.cached(spark, str(logs))
    usage_cache.load(spark, cache, source)
    write(logs / "p" / "b.jsonl", LINES)
    with monkeypatch.context() as m:
        m.setattr(usage_cache, "commit", lambda *a: 1 / 0)
        try:
            usage_cache.load(spark, cache, source)
        except ZeroDivisionError:
            pass
    again = usage_cache.load(spark, cache, source)
    assert again.read == 1 and {r.file_id for r in again.logs.sessions.collect()} == {"a", "b"}
    assert again.logs.requests.count() == 2 * assistant_logs.from_lines(assistant_logs.scan(spark, str(logs)).filter("file_id = 'a'")).requests.count()


def test_unreadable_files_are_counted_and_tried_again(spark, tmp_path):
    logs, cache = tmp_path / "logs", str(tmp_path / "cache")
    write(logs / "p" / "a.jsonl", LINES)
    (logs / "p" / "blank.jsonl").write_text("\n  \n")
    source = assistant_logs.cached(spark, str(logs))
    assert [(x.read, x.unreadable) for x in (usage_cache.load(spark, cache, source), usage_cache.load(spark, cache, source))] == [(2, 1), (1, 1)]


def test_no_logs(spark, tmp_path):
    (tmp_path / "logs" / "p").mkdir(parents=True)
    got = usage_cache.load(spark, str(tmp_path / "cache"), assistant_logs.cached(spark, str(tmp_path / "logs")))
    assert got.discovered == got.read == 0 and got.logs.requests.count() == 0 and "turn_idx" in got.logs.requests.columns


def test_a_window_reads_files_that_may_hold_copies_and_no_others(spark, tmp_path):
    logs = tmp_path / "logs"
    # new.jsonl (day 9) resumes old.jsonl (day 2); stale.jsonl was written before the new session began; q is another folder
    write(logs / "p" / "old.jsonl", LINES)
    write(logs / "p" / "new.jsonl", [*LINES, assistant(9, "m9", "r9", USAGE, [], 55)])
    write(logs / "p" / "stale.jsonl", LINES)
    write(logs / "q" / "other.jsonl", LINES)
    for name, day in (("p/old", 3), ("p/new", 9), ("p/stale", 1), ("q/other", 3)):
        stamp(logs / f"{name}.jsonl", day)
    source = assistant_logs.cached(spark, str(logs))
    since = F.lit(dt.datetime(2026, 1, 8, tzinfo=dt.timezone.utc))
    got = usage_cache.load(spark, str(tmp_path / "cache"), source, since=since)
    assert got.read == 2 and {r.file_id for r in got.reported.collect()} == {"new"}
    assert {r.file_id for r in got.logs.sessions.collect()} == {"old", "new"}
    own = lambda r: sorted((x.file_id, x.request_key) for x in own_requests(r, sessions_of(r)).collect() if x.file_id == "new" and x.request_key)
    assert own(got.logs.requests) == own(assistant_logs.read(spark, str(logs)).requests)
    again = usage_cache.load(spark, str(tmp_path / "cache"), source, since=since)
    assert again.read == 0 and same(again.logs, got.logs)
    assert usage_cache.load(spark, str(tmp_path / "cache"), source).read == 2  # the rest, and what was there stays


def test_open_families_keep_their_candidates(spark):
    t = dt.datetime(2026, 1, 5)
    files = spark.createDataFrame([("a", t, "f"), ("b", t, "f"), ("c", t, "g"), ("d", t, None), ("e", t, None)], "path string, mtime timestamp, family string").withColumn("file_id", F.col("path"))
    near = lambda *names: sorted(r.path for r in usage_cache.copy_candidates(files, files.filter(F.col("path").isin(*names)), None).collect())
    assert near("a") == ["b", "d", "e"] and near("c") == ["d", "e"] and near("d") == ["a", "b", "c", "e"] and near("a", "c") == ["b", "d", "e"]
    starts = spark.createDataFrame([("a", t + dt.timedelta(minutes=30)), ("c", None)], "file_id string, started_at timestamp")
    near = lambda *names: sorted(r.path for r in usage_cache.copy_candidates(files, files.filter(F.col("path").isin(*names)), starts).collect())
    assert near("a") == ["b"] and near("c") == [] and near("b") == ["a"]
    starts = starts.withColumn("started_at", F.col("started_at") + F.expr("INTERVAL 31 MINUTES"))
    assert near("a") == []
