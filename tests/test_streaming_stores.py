import tempfile
import time
from collections import Counter

from pyspark.sql import functions as F

from ledgerspark.operators import files, rewriters, stores
from ledgerspark.streaming import live


def run(spark, df, op, name, mode, batches=2):
    """df dealt over files that arrive one at a time; what the streaming query has put out."""
    folder = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    put = lambda k: df.filter(F.col("seq") % batches == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    put(0)
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    q = op(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck").start()
    q.processAllAvailable()
    for k in range(1, batches):
        put(k)
        q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_reads_are_refused_when_nothing_changed(spark):
    rows = [
        ("s", 0, "/a", False, "h1", 1, 4000), ("s", 2, "/a", False, "h1", 1, 4000), ("s", 4, "/a", True, "h1", 1, 4000), ("s", 6, "", False, "h1", 1, 4000), ("s", 8, "/a", False, "h2", 2, 4000),
        ("s", 10, "/b", False, None, None, None), ("s", 12, "/c", False, "h", 1, 20), ("s", 14, "/c", False, "h", 1, 20), ("t", 16, "/a", False, "h1", 1, 4000),
        ("s", 1, "/a", False, "h2", 2, 4000), ("t", 3, "/a", False, None, None, None),
    ]
    df = spark.createDataFrame(rows, "session_id string, seq long, path string, partial boolean, sha256 string, mtime_ms long, size_bytes long")
    got = {(r.session_id, r.seq): (r.decision, r.reason, r.saved_tokens) for r in run(spark, df, live.read_decisions, "decisions", "append")}
    assert len(got) == len(rows)
    assert got["s", 0] == ("pass", "no-cache-entry", 0) and got["s", 2] == ("deny", "unchanged", 960)
    assert got["s", 4][1] == "partial-read-requested" and got["s", 6][1] == "missing-file-path" and got["s", 8][1] == "file-changed"
    assert got["s", 10][1] == "no-cache-entry" and got["s", 14][1] == "below-threshold" and got["t", 16][1] == "no-cache-entry"
    assert got["s", 1] == ("deny", "unchanged", 960)  # in a later batch: the state was kept
    assert got["t", 3][1] == "missing-current-fingerprint"


READS = "session_id string, seq long, path string, partial boolean, sha256 string, mtime_ms long, size_bytes long"


def test_a_warm_start_changes_the_first_decision_and_a_restart_keeps_it(spark):
    rows = [("s", 0, "/a", False, "h1", 1, 4000), ("s", 1, "/b", False, "h2", 1, 4000), ("s", 2, "/c", False, "h3", 1, 4000), ("t", 3, "/a", False, "h1", 1, 4000)]
    df = spark.createDataFrame(rows, READS)
    text = "one\ntwo\n"
    read = [("s", 1, "/a", "old", None, None, None), ("s", 4, "/a", "\ufeffone\r\ntwo\r", None, None, None), ("s", 2, "/b", "drifted", None, None, None), ("s", 3, "/c", text, 1, 2, 9), ("s", 3, "/gone", text, 1, 2, 2), ("u", 3, "/c", text, 1, 2, 2)]
    reads = spark.createDataFrame(read, "session_id string, turn long, path string, content string, start_line long, lines long, total_lines long")
    disk = spark.createDataFrame([(p, text, h, 1, 4000) for p, h in (("/a", "h1"), ("/b", "h2"), ("/c", "h3"))], "path string, content string, sha256 string, mtime_ms long, size_bytes long")
    warm = live.warm_entries(reads, disk)
    assert sorted(map(tuple, warm.collect())) == [("s", "/a", "h1", 1, 1000), ("u", "/c", "h3", 1, 1000)]
    assert [r.path for r in live.warm_entries(reads.withColumn("path", F.concat("path", F.lit("x"))), disk.withColumn("path", F.concat("path", F.lit("x"))), keep=1).filter("session_id = 's'").collect()] == ["/ax"]
    folder = tempfile.mkdtemp(prefix="stream-", dir="/tmp")

    def go(part, name):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = live.read_decisions(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), warm)
        q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck-{name}").start()
        q.processAllAvailable()
        q.stop()
        return {(r.session_id, r.path): r.reason for r in spark.table(name).collect()}

    assert go(df, "warm") == {("s", "/a"): "unchanged", ("s", "/b"): "no-cache-entry", ("s", "/c"): "no-cache-entry", ("t", "/a"): "no-cache-entry"}

    def sink(batch, _):
        batch.write.mode("append").parquet(f"{folder}/out")

    def restarted():
        out = live.read_decisions(spark.readStream.schema(df.schema).parquet(f"{folder}/in2"), warm)
        q = out.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/ck2").start()
        q.processAllAvailable()
        q.stop()

    df.filter("seq < 2").coalesce(1).write.mode("append").parquet(f"{folder}/in2")
    restarted()
    df.withColumn("seq", F.col("seq") + 10).coalesce(1).write.mode("append").parquet(f"{folder}/in2")
    restarted()
    later = {(r.session_id, r.path): r.reason for r in spark.read.parquet(f"{folder}/out").filter("seq >= 10").collect()}
    assert later == {("s", "/a"): "unchanged", ("s", "/b"): "unchanged", ("s", "/c"): "no-cache-entry", ("t", "/a"): "no-cache-entry"}


def test_entries_are_forgotten_in_time(spark):
    df = spark.createDataFrame([("s", 0, "/a", False, "h1", 1, 4000)], READS)
    folder = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    df.coalesce(1).write.parquet(f"{folder}/in")
    out = live.read_decisions(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), ttl_ms=1)
    q = out.writeStream.outputMode("append").format("memory").queryName("forgotten").option("checkpointLocation", f"{folder}/ck").trigger(processingTime="1 second").start()

    def shown(n):  # a query with timers has always another batch to do
        for _ in range(240):
            if spark.table("forgotten").count() >= n:
                return [r.reason for r in spark.table("forgotten").collect()]
            time.sleep(0.25)
        raise AssertionError("no rows")

    try:
        assert shown(1) == ["no-cache-entry"]
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        assert shown(2) == ["no-cache-entry"] * 2
    finally:
        q.stop()


def test_rewriters_run_on_a_stream(spark):
    cases = [("git status", "git-status", "git status -s"), ("git log -n 3", None, None), ("npm i x --no-fund", "npm-install", "npm i --no-audit --loglevel=error x --no-fund"), (" ls -l ", "ls", "set -o pipefail; ls -l | awk 'NR<=50'"),
             ("grep -rn x", "grep", "set -o pipefail; grep -rn x | awk 'NR<=50'"), ("grep -r x", "grep", "grep -c -r x"), ("grep -rl x", None, None), ("tsc", "tsc", "set -o pipefail; tsc 2>&1 | awk 'NR<=100'"), ("cat a b", None, None), (None, None, None)]
    rows = [(k, "Bash", c, None) for k, (c, _, _) in enumerate(cases)] + [(50, "Grep", None, "x"), (51, "Glob", None, "x"), (52, "Glob", None, ""), (53, "Read", None, "x")]
    df = spark.createDataFrame(rows, "seq long, name string, command string, pattern string")
    got = {r.seq: r.rewrite for r in run(spark, df, rewriters.rewritten, "rewritten", "append")}
    assert [(got[k].rewriter, got[k].command) if got[k] else (None, None) for k in range(len(cases))] == [(n, c) for _, n, c in cases]
    assert [(got[k].rewriter, got[k].head_limit) if got[k] else None for k in (50, 51, 52, 53)] == [("native-grep", 100), ("native-glob", 100), None, None]
    assert {k: x.rewrite for k, x in ((r.seq, r) for r in rewriters.rewritten(df).collect())} == got
    long = spark.createDataFrame([("Bash", "cat notes.txt", None)], "name string, command string, pattern string")
    assert rewriters.rewritten(long).first().rewrite.command.startswith("awk '{a[NR]=$0} END{n=NR; if(n>300)") and rewriters.rewritten(long).first().rewrite.command.endswith(" notes.txt")


def test_replayed_batches_add_nothing(spark):
    folder = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    df = spark.createDataFrame([(k, f"v{k}") for k in range(9)], "seq long, event string")
    put = stores.event_sink(f"{folder}/out")
    for k in range(3):
        df.filter(F.floor(F.col("seq") / 3) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    every = [(k, f"v{k}") for k in range(9)]
    assert sorted(map(tuple, stores.events(spark, f"{folder}/out", "seq").collect())) == every
    last = spark.read.parquet(f"{folder}/out").filter("batch = 2").drop("batch").collect()
    put(spark.createDataFrame(last, df.schema), 2)  # the batch that a restart would replay
    assert sorted(map(tuple, stores.events(spark, f"{folder}/out", "seq").collect())) == every
    assert sorted(map(tuple, stores.events(spark, f"{folder}/out", "seq", keep=4).collect())) == every[-4:]


def test_streamed_requests_merge(spark):
    rows = [(i, "f", f"k{i % 3}" if i % 4 else None, i, 2 * i, 3, 4) for i in range(24)]
    df = spark.createDataFrame(rows, "seq long, file_id string, request_key string, input long, output long, cache_read long, cache_write long").withColumn("line_no", F.col("seq"))
    got = run(spark, df, live.merged_requests, "merged", "complete")
    want = Counter()
    for r in rows:
        want[r[2]] = max(want[r[2]], r[3])
    assert {r.request_key: r.input for r in got if r.request_key} == {k: n for k, n in want.items() if k}


def test_daily_usage_and_spans(spark):
    rows = [(i, "s", 86_400 * (i // 4) + 600 * (i % 2), 1, 2, 3, 4) for i in range(12)]
    df = spark.createDataFrame(rows, "seq long, session_id string, at long, input long, output long, cache_read long, cache_write long").withColumn("ts", F.timestamp_seconds("at"))
    got = run(spark, df, live.daily_usage, "days", "complete", 1)
    assert sorted((r.requests, r.tokens) for r in got) == [(4, 40)] * 3
    spans = run(spark, df, live.active_spans, "spans", "append", 1)
    assert all(r.events == 2 for r in spans)


def test_newest_signals_are_kept(spark):
    df = spark.createDataFrame([(i, "s", i, f"x{i}") for i in range(10)], "seq long, session_id string, at long, signal string")
    got = run(spark, df, lambda s: live.newest_signals(s, keep=3), "signals", "update")
    assert [(r.at, r["rank"]) for r in got[-3:]] == [(9, 1), (8, 2), (7, 3)]


def test_stores(spark):
    df = spark.createDataFrame([(i, i % 3, f"v{i}") for i in range(250)], "at long, k long, v string")
    assert stores.pruned(df, "at").count() == 100 and stores.pruned(df, "at", above=300).count() == 250
    assert {r.at for r in stores.last_wins(df, "k", "at").collect()} == {249, 248, 247}
    assert stores.report_json(df.limit(1)).first().json.startswith("{")
    empty = stores.rewrite_total(stores.rewrite_report(spark.createDataFrame([], "rewriter_name string, saved_tokens long, integrity double"))).first()
    assert (empty.events, empty.saved_tokens, empty.avg_integrity) == (0, 0, None)


def test_snapshots(spark):
    rows = [("p", 1, ["a", "b"]), ("p", 9, ["b", "c"]), ("q", 9, ["z"])]
    got = {r.project: (r.added, r.removed) for r in stores.snapshot_changes(spark.createDataFrame(rows, "project string, captured_at long, entries array<string>"), F.lit(5)).collect()}
    assert got == {"p": (["c"], ["a"]), "q": (["z"], [])}


def test_commits(spark):
    log = [("f", i, x) for i, x in enumerate(["lost", "COMMIT\tabc\t17", "a/b", "", "c\\d", "COMMIT\tdef\tx", "a/b"])]
    got = files.commits(spark.createDataFrame(log, "file string, line_no long, raw string"))
    assert sorted(map(tuple, got.collect()), key=str) == [("abc", 17, "a/b"), ("abc", 17, "c\\d"), ("def", None, "a/b")]
    known = spark.createDataFrame([("a/b",), ("c/d",)], "path string")
    assert [tuple(r) for r in files.hot_files(got, known).collect()] == [("a/b", 2), ("c/d", 1)]
