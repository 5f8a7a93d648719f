"""Rollout logs (JSON Lines, plain or zstd) as requests, tool calls and sessions.

Usage comes as running totals or, in newer logs, as records. Everything that looks back or ahead in a file is
a window by file: the total before, the model in force, the request that a call belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shell import absolute, failed, patched_files, shell_read, unwrapped, wrapped_commands
from ..functions.core import utf16_length
from ..operators.requests import primary_model
from .text_lines import count_at, file_listing, filled, numbered_lines, present, text_at, unreadable
from .usage_cache import Logs

AGENT = "codex"
TOTALS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
NAME = r"(rollout-.*\.jsonl)(\.zst)?$"


def scan(spark: SparkSession, home: str) -> DataFrame:
    """Both folders (either may be missing), all levels. Of one log's copies a plain file goes before a compressed one, a live one before an archived one."""
    t = numbered_lines(spark, f"{home}/{{,archived_}}sessions", glob="rollout-*.jsonl*", recursive=True, ignore_corrupt=True)
    return best_copies(t.withColumn("file_id", F.regexp_extract("path", NAME, 1)).filter("file_id <> ''"))


def unreadable_files(spark: SparkSession, home: str) -> DataFrame:
    """path, mtime, size of logs with bytes but without a line, such as truncated archives."""
    folders = f"{home}/{{,archived_}}sessions"
    return unreadable(file_listing(spark, folders, glob="rollout-*.jsonl*"), numbered_lines(spark, folders, glob="rollout-*.jsonl*", recursive=True, ignore_corrupt=True))


def best_copies(lines: DataFrame) -> DataFrame:
    order = F.struct(F.col("path").endswith(".zst").alias("z"), F.col("path").contains("/archived_sessions/").alias("a"), "path")
    chosen = lines.groupBy("file_id").agg(F.min(order)["path"].alias("path"))
    return lines.join(chosen, ["file_id", "path"], "left_semi")


def parsed(lines: DataFrame) -> DataFrame:
    v = lines.withColumn("v", F.try_parse_json("raw"))
    v = v.withColumn("ok", present(F.col("v"), "$.payload", "OBJECT"))
    return v.withColumn("type", F.when(F.col("ok"), text_at(F.col("v"), "$.type"))).withColumn("kind", F.when(F.col("ok"), text_at(F.col("v"), "$.payload.type"))).withColumn("ts_raw", F.when(F.col("ok"), filled(F.col("v"), "$.timestamp")))


def metas(p: DataFrame) -> DataFrame:
    """Per file, from its first session_meta line: id, root, folder, version, whether a subagent's, linked ids."""
    v = F.col("v")
    first = p.filter(F.col("type") == "session_meta").withColumn("n", F.row_number().over(W.partitionBy("file_id").orderBy("line_no"))).filter("n = 1")
    sub = present(v, "$.payload.source.subagent", "OBJECT") | text_at(v, "$.payload.source.subagent").isNotNull() | text_at(v, "$.payload.parent_thread_id").isNotNull()
    sid = filled(v, "$.payload.id")
    others = F.array(*[filled(v, f"$.payload.{x}") for x in ("forked_from_id", "parent_thread_id", "source.subagent.thread_spawn.parent_thread_id", "session_id")])
    linked = F.array_distinct(F.filter(others, lambda x: x.isNotNull() & (sid.isNull() | (x != sid))))
    return first.select("file_id", sid.alias("session_id"), F.coalesce(filled(v, "$.payload.session_id"), sid).alias("root"), filled(v, "$.payload.cwd").alias("cwd"), filled(v, "$.payload.cli_version").alias("cli_version"), F.coalesce(sub, F.lit(False)).alias("is_subagent"), linked.alias("linked_ids"))


def usage(v: Column, at: str) -> Column:
    return F.struct(*[count_at(v, f"{at}.{k}").alias(k) for k in TOTALS])


def _vector(u: Column) -> Column:
    return F.concat_ws(":", *[u[k].cast("string") for k in ("total_tokens", "input_tokens", "cached_input_tokens", "output_tokens")])


def requests_of(p: DataFrame, meta: DataFrame) -> DataFrame:
    """Requests: usage records, and before the first of them the steps of the running total."""
    v = F.col("v")
    line = W.partitionBy("file_id").orderBy("line_no")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    t = p.filter(F.col("type").isin("turn_context", "token_usage_record") | ((F.col("type") == "event_msg") & (F.col("kind") == "token_count")))
    t = t.withColumn("turn_id", filled(v, "$.payload.turn_id")).withColumn("said", F.when(F.col("type") == "turn_context", text_at(v, "$.payload.model")))
    t = t.withColumn("current", F.last("said", ignorenulls=True).over(before))
    t = t.withColumn("by_turn", F.when(F.col("turn_id").isNotNull(), F.last("said", ignorenulls=True).over(W.partitionBy("file_id", "turn_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))))
    t = t.withColumn("is_record", F.col("type") == "token_usage_record").withColumn("first_record", F.min(F.when(F.col("is_record"), F.col("line_no"))).over(W.partitionBy("file_id")))
    t = t.join(meta.select("file_id", "root"), "file_id", "left")
    # running totals before the first record
    total, last = usage(v, "$.payload.info.total_token_usage"), usage(v, "$.payload.info.last_token_usage")
    c = t.filter((F.col("type") == "event_msg") & (F.col("first_record").isNull() | (F.col("line_no") < F.col("first_record"))) & present(v, "$.payload.info.total_token_usage", "OBJECT"))
    c = c.withColumn("total", total).withColumn("last", last).withColumn("prev", F.lag("total").over(line))
    same = F.lit(True)
    for k in ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens"):
        same = same & (F.col(f"total.{k}") == F.col(f"prev.{k}"))
    fits = F.col("prev.total_tokens") + F.col("last.total_tokens") == F.col("total.total_tokens")
    step = F.struct(*[F.greatest(F.lit(0), F.col(f"total.{k}") - F.col(f"prev.{k}")).cast("long").alias(k) for k in TOTALS])
    c = c.withColumn("u", F.when(F.col("prev").isNull() | fits, F.col("last")).otherwise(step))
    c = c.filter(F.col("prev").isNull() | (~same & (F.col("total.total_tokens") >= F.col("prev.total_tokens"))))
    c = c.filter((F.col("u.input_tokens") > 0) | (F.col("u.output_tokens") > 0) | (F.col("u.cached_input_tokens") > 0))
    key = F.when(F.col("root").isNotNull(), F.concat(F.lit("codex:"), F.col("root"), F.lit(":"), _vector(F.col("total"))))
    c = c.select("file_id", "line_no", "ts_raw", "u", F.col("current").alias("model"), key.alias("request_key"), F.col("total.total_tokens").alias("cumulative"))
    # records
    thread = F.when(present(v, "$.payload.thread_token_usage", "OBJECT"), usage(v, "$.payload.thread_token_usage"))
    r = t.filter("is_record").withColumn("thread", thread).withColumn("u", usage(v, "$.payload.usage"))
    key = F.when(F.col("thread").isNotNull() & F.col("root").isNotNull(), F.concat(F.lit("codex:"), F.col("root"), F.lit(":rec:"), _vector(F.col("thread"))))
    own = r.select("file_id", "line_no", "ts_raw", "u", F.coalesce("by_turn", "current").alias("model"), F.coalesce(filled(v, "$.payload.response_id"), key).alias("request_key"), F.lit(None).cast("long").alias("cumulative"))
    # steps at the end that the first record's thread total does not put before it are the record's own
    limit = r.filter(F.col("line_no") == F.col("first_record")).select("file_id", (F.col("thread.total_tokens") - F.col("u.total_tokens")).alias("upto"))
    nth = F.row_number().over(W.partitionBy("file_id", "request_key").orderBy("line_no"))
    c = c.withColumn("n", nth).filter(F.col("request_key").isNull() | (F.col("n") == 1)).drop("n").join(limit, "file_id", "left")
    held = F.max(F.when(F.col("cumulative") <= F.col("upto"), F.col("line_no"))).over(W.partitionBy("file_id"))
    popped = F.col("upto").isNotNull() & (F.col("line_no") > F.coalesce(held, F.lit(-1)))
    c = c.withColumn("popped", popped)
    every = c.select(*own.columns, "popped").unionByName(own.withColumn("popped", F.lit(False)))
    every = every.withColumn("n", nth).filter(F.col("request_key").isNull() | (F.col("n") == 1)).filter("not popped")
    cached = F.least(F.col("u.cached_input_tokens"), F.col("u.input_tokens"))
    write = F.least(F.col("u.cache_write_input_tokens"), F.col("u.input_tokens") - cached)
    return every.select(
        "file_id", (F.row_number().over(line) - 1).alias("turn_idx"), F.col("line_no").alias("first_line"), "request_key", "model", F.try_to_timestamp("ts_raw").alias("ts"),
        (F.col("u.input_tokens") - cached - write).alias("input"), F.col("u.output_tokens").alias("output"), cached.alias("cache_read"), write.alias("cache_write"), F.lit(0).cast("long").alias("cache_write_1h"), F.lit(False).alias("missing_usage"),
    )


def _units(v: Column, args: Column) -> Column:
    """What a call asks for, an array of (files patched, command, folder, name): a script may hold several commands."""
    none = F.lit(None)
    unit = lambda files=None, command=None, workdir=None, name=None: F.struct(*[(x if x is not None else none).cast(k).alias(n) for x, n, k in ((files, "files", "array<string>"), (command, "command", "string"), (workdir, "workdir", "string"), (name, "name", "string"))])
    name, kind, argv, folder = F.col("name"), F.col("kind"), F.col("argv"), F.col("workdir")
    is_call = kind == "function_call"
    direct = F.when(F.try_element_at(argv, F.lit(1)).isin("apply_patch", "applypatch"), patched_files(F.try_element_at(argv, F.lit(2))))
    command = F.coalesce(F.when(is_call & (name == "exec_command"), text_at(args, "$.cmd")), F.when(is_call & (name == "shell_command"), text_at(args, "$.command")), F.when(argv.isNotNull(), F.col("unwrapped")))
    scripts = F.when((kind == "custom_tool_call") & (name == "exec"), F.filter(wrapped_commands(text_at(v, "$.payload.input")), lambda x: text_at(x, "$.cmd").isNotNull()))
    patch = F.when(name == "apply_patch", patched_files(F.coalesce(text_at(v, "$.payload.input"), text_at(args, "$.input"), F.lit(""))))
    return (
        F.when(F.size(direct) > 0, F.array(unit(files=direct, workdir=folder))).when(command.isNotNull(), F.array(unit(command=command, workdir=folder)))
        .when(F.size(scripts) > 0, F.transform(scripts, lambda x: unit(command=text_at(x, "$.cmd"), workdir=filled(x, "$.workdir")))).when(F.size(patch) > 0, F.array(unit(files=patch))).otherwise(F.array(unit(name=name)))
    )


def calls_of(p: DataFrame, meta: DataFrame, requests: DataFrame) -> DataFrame:
    """Tool calls with the request that they belong to: the next one in the file, the last one for those at its end.

    Each step (arguments, units, files of a patch, paths) is a projection or an explode of its own, so that no
    expression holds another one many times over.
    """
    v = F.col("v")
    before = W.partitionBy("file_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    t = p.filter((F.col("type") == "turn_context") | ((F.col("type") == "response_item") & F.col("kind").isin("function_call", "custom_tool_call", "local_shell_call")))
    t = t.withColumn("turn_cwd", F.last(F.when(F.col("type") == "turn_context", filled(v, "$.payload.cwd")), ignorenulls=True).over(before)).filter(F.col("type") == "response_item")
    t = t.join(meta.select("file_id", F.col("cwd").alias("own_cwd")), "file_id", "left").withColumn("cwd", F.coalesce("turn_cwd", "own_cwd"))
    t = t.withColumn("call_id", filled(v, "$.payload.call_id")).withColumn("n", F.row_number().over(W.partitionBy("file_id", "call_id").orderBy("line_no"))).filter(F.col("call_id").isNull() | (F.col("n") == 1))
    t = t.withColumn("name", F.coalesce(text_at(v, "$.payload.name"), F.col("kind"))).withColumn("args", F.when(F.col("kind") == "function_call", F.try_parse_json(text_at(v, "$.payload.arguments"))))
    a = F.col("args")
    argv = F.coalesce(F.when(F.col("kind") == "local_shell_call", F.try_variant_get(v, "$.payload.action.command", "array<string>")), F.when((F.col("kind") == "function_call") & F.col("name").isin("shell", "container.exec"), F.try_variant_get(a, "$.command", "array<string>")))
    t = t.withColumn("argv", argv).withColumn("workdir", F.coalesce(filled(v, "$.payload.action.working_directory"), filled(a, "$.workdir")))
    t = t.withColumn("unwrapped", unwrapped("argv"))
    t = t.select("file_id", "line_no", "call_id", "cwd", F.posexplode(_units(v, a)).alias("nth", "unit"))
    own = F.when(F.col("unit.command").rlike(r"^\s*(?:apply_patch|applypatch)\b") & F.col("unit.command").contains("*** Begin Patch"), patched_files(F.col("unit.command")))
    t = t.select("file_id", "line_no", "call_id", "cwd", "nth", "unit", F.filter(F.coalesce("unit.files", own), lambda x: x.isNotNull()).alias("files"))
    entry = lambda name, path, command: F.struct(name.alias("name"), path.cast("string").alias("path"), command.cast("string").alias("command"))
    none = F.lit(None)
    entries = F.when(F.size("files") > 0, F.transform("files", lambda f: entry(F.lit("Edit"), f, none))).otherwise(F.array(entry(F.coalesce("unit.name", F.lit("Bash")), none, F.col("unit.command"))))
    t = t.select("file_id", "line_no", "call_id", "nth", F.coalesce(absolute("unit.workdir", "cwd"), "cwd").alias("base"), F.posexplode(entries).alias("inner", "e"))
    t = t.select("file_id", "line_no", "call_id", (F.col("nth").cast("long") * 2**20 + F.col("inner")).alias("pos"), "base", "e.name", "e.command", absolute("e.path", "base").alias("raw_path"), shell_read("e.command").alias("read"))
    place = F.when(F.col("read.range").isNotNull(), F.concat("place", F.lit("#"), "read.range")).otherwise(F.col("place"))
    c = t.withColumn("place", absolute("read.path", "base")).select("file_id", "line_no", "pos", "call_id", "name", "raw_path", "command", place.alias("read_path"))
    # the request of a call: the first one after its line, else the file's last
    marks = requests.select("file_id", F.col("first_line").alias("line_no"), F.lit(-1).cast("long").alias("pos"), "turn_idx")
    both = c.withColumn("turn_idx", F.lit(None).cast("int")).unionByName(marks, allowMissingColumns=True)
    ahead = W.partitionBy("file_id").orderBy("line_no", "pos").rowsBetween(0, W.unboundedFollowing)
    both = both.withColumn("turn", F.coalesce(F.first("turn_idx", ignorenulls=True).over(ahead), F.max("turn_idx").over(W.partitionBy("file_id"))))
    c = both.filter(F.col("pos") >= 0).filter("turn is not null").drop("turn_idx").withColumnRenamed("turn", "turn_idx")
    # outputs: the first of an id; its size counts once in a request
    blocks = F.try_variant_get(v, "$.payload.output", "array<variant>")
    text = F.coalesce(text_at(v, "$.payload.output"), F.array_join(F.transform(blocks, lambda x: F.coalesce(text_at(x, "$.text"), F.lit(""))), ""), F.lit(""))
    outs = p.filter((F.col("type") == "response_item") & F.col("kind").isin("function_call_output", "custom_tool_call_output")).select("file_id", "line_no", text_at(v, "$.payload.call_id").alias("call_id"), text.alias("out"))
    outs = outs.filter("call_id is not null").groupBy("file_id", "call_id").agg(F.min_by("out", "line_no").alias("out"))
    outs = outs.select("file_id", "call_id", utf16_length(F.col("out")).alias("chars"), failed("out").alias("failed"))
    c = c.join(outs, ["file_id", "call_id"], "left")
    good = F.col("read_path").isNotNull() & ~F.coalesce("failed", F.lit(False))
    once = F.row_number().over(W.partitionBy("file_id", "turn_idx", "call_id").orderBy("line_no", "pos"))
    chars = F.when(F.col("call_id").isNotNull() & (once == 1), F.coalesce("chars", F.lit(0))).otherwise(0)
    path = F.when(good, F.col("read_path")).otherwise(F.col("raw_path"))
    c = c.withColumn("name", F.when(good, F.lit("Read")).otherwise(F.col("name"))).withColumn("raw_path", path).withColumn("path", F.col("raw_path")).withColumn("result_tokens", F.ceil(chars / 4))
    c = c.withColumn("call_idx", F.row_number().over(W.partitionBy("file_id").orderBy("turn_idx", "line_no", "pos")) - 1)
    return c.select("file_id", "turn_idx", "call_idx", "call_id", "name", "command", "raw_path", "path", "result_tokens")


def session_rows(p: DataFrame, meta: DataFrame, requests: DataFrame) -> DataFrame:
    v = F.col("v")
    turn = F.when(F.col("type") == "turn_context", filled(v, "$.payload.turn_id"))
    s = p.groupBy("file_id", "path", "mtime", "size").agg(
        F.min("ts_raw").alias("started_at"), F.max("ts_raw").alias("ended_at"), (F.count_distinct(turn) + F.count_if((F.col("type") == "turn_context") & turn.isNull())).alias("user_turns"),
        F.count_if("ok").alias("lines_parsed"), F.count_if(~F.col("ok")).alias("lines_skipped"),
    )
    span = F.unix_millis(F.try_to_timestamp("ended_at")) - F.unix_millis(F.try_to_timestamp("started_at"))
    s = s.withColumn("duration_sec", F.greatest(F.coalesce(F.floor(span / 1000), F.lit(0)), F.lit(0)))
    n = requests.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return s.join(meta, "file_id", "left").join(primary_model(requests), "file_id", "left").join(n, "file_id", "left").withColumn("agent", F.lit(AGENT))


def from_lines(lines: DataFrame) -> Logs:
    p = parsed(lines)
    meta = metas(p)
    requests = requests_of(p, meta)
    return Logs(p, requests, calls_of(p, meta, requests), session_rows(p, meta, requests))


def read(spark: SparkSession, home: str) -> Logs:
    return from_lines(scan(spark, home))


def limit_readings(lines: DataFrame) -> DataFrame:
    """Limit readings: one per window that is there; lines that don't mention limits are never parsed. ok is false for malformed ones."""
    v = lines.filter(F.col("raw").contains('"rate_limits"')).withColumn("v", F.try_parse_json("raw"))
    v = v.filter(present(F.col("v"), "$.payload.rate_limits", "OBJECT"))
    at = F.unix_millis(F.try_to_timestamp(text_at(F.col("v"), "$.timestamp")))
    num = lambda p: F.try_variant_get("v", p, "double")

    def window(slot: str) -> Column:
        base = f"$.payload.rate_limits.{slot}"
        return F.when(present(F.col("v"), base, "OBJECT"), F.struct(F.lit(slot).alias("slot"), num(f"{base}.used_percent").alias("used_percent"), num(f"{base}.window_minutes").alias("window_minutes"), num(f"{base}.resets_at").alias("resets")))

    x = v.select("file_id", "line_no", at.alias("at"), F.coalesce(text_at(F.col("v"), "$.payload.rate_limits.limit_id"), F.lit("codex")).alias("limit_id"), text_at(F.col("v"), "$.payload.rate_limits.plan_type").alias("plan_type"), F.explode(F.array(window("primary"), window("secondary"))).alias("w"))
    x = x.filter("w is not null").select("file_id", "line_no", "at", "limit_id", "plan_type", "w.*")
    ms = F.when(F.col("resets") <= 1e12, F.col("resets") * 1000).otherwise(F.col("resets"))
    good = F.col("at").isNotNull() & (F.col("used_percent") >= 0) & (F.col("window_minutes") > 0) & (F.col("resets") > 0)
    return x.withColumn("resets_at", ms.cast("long")).withColumn("window_minutes", F.col("window_minutes").cast("long")).withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("session_id", F.col("file_id")).drop("resets")
