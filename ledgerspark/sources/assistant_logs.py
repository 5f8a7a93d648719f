"""Assistant session logs (JSON Lines, one folder per project) as requests, tool calls and sessions.

Lines are parsed once into VARIANT, and what the tables need of each is written to the checkpoint folder, from which requests,
calls and sessions are made. A line that is no JSON object with a string type, or whose timestamp or session id is no string,
is skipped and counted. Requests are written too, as calls and sessions need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import normal_path, read_path, utf16_length
from ..operators.requests import merge_lines, primary_model, request_key
from ..session import stored
from .text_lines import LINES, count_at, file_listing, kind_at, numbered_lines, text_at
from .usage_cache import Logs, Source

AGENT = "claude-code"
OBSERVERS = r"(-observer-sessions$|claude-mem-observer)"


def projects_dir(env: dict[str, str], home: str) -> str:
    """Root of the logs; CLAUDE_CONFIG_DIR moves it."""
    return f"{env.get('CLAUDE_CONFIG_DIR') or f'{home}/.claude'}/projects"


def placed(files: DataFrame, ending: str = "jsonl") -> DataFrame:
    """files (with path) with project_hash and file_id, without those of observer folders."""
    parts = F.split("path", "/")
    t = files.withColumn("project_hash", F.element_at(parts, -2)).withColumn("file_id", F.regexp_replace(F.element_at(parts, -1), rf"\.{ending}$", ""))
    return t.filter(~F.col("project_hash").rlike(OBSERVERS))


def scan(spark: SparkSession, root: str, ending: str = "jsonl") -> DataFrame:
    """<root>/<project>/*.jsonl, one level deep, without observer folders."""
    return placed(numbered_lines(spark, f"{root}/*/", glob=f"*.{ending}"), ending)


#: What is taken out of a line, all at once; a field that is no object, or no array, where one is named here is null.
FIELDS = """struct<type: variant, timestamp: variant, sessionId: variant, cwd: variant, requestId: variant, version: variant, entrypoint: variant, isSidechain: variant,
 message: struct<id: variant, model: variant, content: array<variant>, usage: struct<input_tokens: variant, output_tokens: variant, cache_read_input_tokens: variant, cache_creation_input_tokens: variant,
 cache_creation: struct<ephemeral_5m_input_tokens: variant, ephemeral_1h_input_tokens: variant>>>>"""


def parsed(lines: DataFrame) -> DataFrame:
    """lines without their text, with ok, type, ts_raw and what requests, calls and sessions need; written, as a filter on a parsed column would parse each line again for it."""
    own = [c for c in lines.columns if c != "raw"]
    p = lines.withColumn("v", F.try_parse_json("raw")).select(*own, F.try_variant_get("v", "$", FIELDS).alias("x"))
    text, count = lambda c: text_at(F.col(f"x.{c}"), "$"), lambda c: count_at(F.col(f"x.message.usage.{c}"), "$")
    no_text = lambda c: ~F.coalesce(kind_at(F.col(f"x.{c}"), "$").isin("STRING", "VOID"), F.lit(True))
    is_a = lambda c, kind: F.coalesce(F.try_variant_get(c, "$.type", "string") == kind, F.lit(False))
    content = F.col("x.message.content")
    blocks = F.transform(content, lambda c, pos: F.struct(pos.alias("pos"), c.alias("c")))
    p = p.select(
        *own, text("type").alias("type"), (no_text("timestamp") | no_text("sessionId")).alias("odd"), text("timestamp").alias("ts_raw"), text("sessionId").alias("sid"), text("cwd").alias("cwd"),
        text("message.id").alias("message_id"), text("requestId").alias("request_id"), text("message.model").alias("model"),
        count("input_tokens").alias("input"), count("output_tokens").alias("output"), count("cache_read_input_tokens").alias("cache_read"), count("cache_creation_input_tokens").alias("cache_write"),
        count("cache_creation.ephemeral_5m_input_tokens").alias("five"), count("cache_creation.ephemeral_1h_input_tokens").alias("cache_write_1h"), F.col("x.message.usage").isNull().alias("missing_usage"),
        text("version").alias("version"), text("entrypoint").alias("entrypoint"), F.coalesce(F.try_variant_get("x.isSidechain", "$", "boolean"), F.lit(False)).alias("sidechain"), F.col("x.message.usage.cache_creation").isNotNull().alias("cache_split"),
        F.coalesce(F.exists(content, lambda c: is_a(c, "tool_result")), F.lit(False)).alias("has_result"), (content.isNotNull() & F.forall(content, lambda c: is_a(c, "tool_result"))).alias("all_results"),
        F.filter(blocks, lambda x: is_a(x["c"], "tool_use")).alias("uses"), F.transform(F.filter(blocks, lambda x: is_a(x["c"], "tool_result")), result_size).alias("results"),
    )
    filled_ = lambda c: F.when(F.length(c) > 0, F.col(c))
    p = p.withColumn("ok", F.col("type").isNotNull() & ~F.col("odd")).withColumn("type", F.when(F.col("ok"), F.col("type")))
    is_user, is_assistant = F.col("type") == "user", F.col("type") == "assistant"
    p = p.withColumns({"ts_raw": filled_("ts_raw"), "sid": F.when(F.col("ok"), filled_("sid")), "cwd": F.when(F.col("ok"), filled_("cwd")), "request_key": request_key(F.col("message_id"), F.col("request_id")), "cache_write": F.greatest("cache_write", F.col("five") + F.col("cache_write_1h"))})
    p = p.withColumns({"has_result": F.when(is_user, F.col("has_result")), "all_results": F.when(is_user, F.col("all_results")), "uses": F.when(is_assistant, F.col("uses")), "results": F.when(is_user, F.col("results"))})
    return stored(p.drop("odd", "five", "message_id", "request_id"))


def result_size(x: Column) -> Column:
    """Of a tool result (pos, c): its place, the call it answers, and the length of its text."""
    c = x["c"]
    body, blocks = F.try_variant_get(c, "$.content", "variant"), F.try_variant_get(c, "$.content", "array<variant>")
    text = F.when(F.schema_of_variant(body) == "STRING", utf16_length(F.try_variant_get(c, "$.content", "string")))
    summed = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, y: a + F.coalesce(utf16_length(F.try_variant_get(y, "$.text", "string")), F.lit(0)))
    return F.struct(x["pos"].alias("pos"), F.try_variant_get(c, "$.tool_use_id", "string").alias("call_id"), F.coalesce(text, summed, F.lit(0)).alias("chars"))


def request_lines(p: DataFrame) -> DataFrame:
    """Lines of assistant messages with usage, in the columns of merge_lines."""
    before = W.partitionBy("file_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    marked = p.filter("ok").withColumn("after_tool_result", F.coalesce(F.last("has_result", ignorenulls=True).over(before), F.lit(False)))
    return marked.filter(F.col("type") == "assistant").select(
        "file_id", "line_no", "project_hash", "request_key", "model", F.try_to_timestamp("ts_raw").alias("ts"), "input", "output", "cache_read", "cache_write", "cache_write_1h", "missing_usage", "version", "entrypoint", "sidechain", "after_tool_result", "cache_split",
    )


def tool_calls(p: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per tool call in log order, with its request's turn and the size of its result (the last one of its id)."""
    unit = lambda line: F.coalesce(F.concat(F.lit("k"), F.col("request_key")), F.concat(F.lit("n"), F.col(line).cast("string"))).alias("unit")
    uses = p.filter(F.size("uses") > 0).select("file_id", "line_no", "request_key", unit("line_no"), F.explode("uses").alias("use")).select("*", "use.*").drop("use")
    uses = uses.join(requests.select("file_id", unit("first_line"), "turn_idx"), ["file_id", "unit"])
    inp = F.try_variant_get("c", "$.input", "variant")
    uses = uses.select("file_id", "turn_idx", "request_key", "line_no", "pos", F.try_variant_get("c", "$.id", "string").alias("call_id"), F.try_variant_get("c", "$.name", "string").alias("name"), inp.alias("input_json"))
    raw = read_path(F.col("name"), F.col("input_json"))
    uses = uses.withColumn("raw_path", raw).withColumn("path", normal_path(F.col("raw_path")))
    uses = uses.withColumn("call_idx", F.row_number().over(W.partitionBy("file_id").orderBy("line_no", "pos")) - 1)
    r = p.filter(F.size("results") > 0).select("file_id", "line_no", F.explode("results").alias("r")).select("file_id", "r.call_id", F.struct("line_no", "r.pos").alias("at"), "r.chars")
    r = r.groupBy("file_id", "call_id").agg(F.max_by("chars", "at").alias("chars"))
    return uses.join(r, ["file_id", "call_id"], "left").withColumn("result_tokens", F.ceil(F.coalesce("chars", F.lit(0)) / 4)).drop("line_no", "pos", "chars")


def session_rows(p: DataFrame, requests: DataFrame) -> DataFrame:
    """Per file: ids, folder, first and last timestamp (as text), duration, user turns, lines read and skipped, models."""
    ok, sid, cwd = F.col("ok"), F.col("sid"), F.col("cwd")
    said = ok & F.col("type").isin("assistant", "user")
    s = p.groupBy("file_id", "path", "project_hash", "mtime", "size").agg(
        F.min_by(sid, F.when(sid.isNotNull(), F.col("line_no"))).alias("session_id"), F.min_by(cwd, F.when(cwd.isNotNull(), F.col("line_no"))).alias("cwd"),
        F.min(F.when(said, F.col("ts_raw"))).alias("started_at"), F.max(F.when(said, F.col("ts_raw"))).alias("ended_at"),
        F.count_if(ok & (F.col("type") == "user") & ~F.coalesce("all_results", F.lit(False))).alias("user_turns"), F.count_if(ok).alias("lines_parsed"), F.count_if(~ok).alias("lines_skipped"),
    )
    span = F.unix_millis(F.try_to_timestamp("ended_at")) - F.unix_millis(F.try_to_timestamp("started_at"))
    s = s.withColumn("duration_sec", F.greatest(F.coalesce(F.floor(span / 1000), F.lit(0)), F.lit(0)))
    n = requests.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return s.join(primary_model(requests), "file_id", "left").join(n, "file_id", "left").withColumn("agent", F.lit(AGENT))


def read(spark: SparkSession, root: str, ending: str = "jsonl") -> Logs:
    return from_lines(scan(spark, root, ending))


def from_lines(lines: DataFrame) -> Logs:
    p = parsed(lines)
    requests = stored(merge_lines(request_lines(p)))
    return Logs(p, requests, tool_calls(p, requests), session_rows(p, requests))


def cached(spark: SparkSession, root: str, ending: str = "jsonl", key: str = "file_id") -> Source:
    """The logs under root for usage_cache.load(); key: the column that tells files apart."""

    def files() -> DataFrame:
        t = placed(file_listing(spark, f"{root}/*/", glob=f"*.{ending}", recursive=False), ending)
        return t.select("path", "open", "mtime", "size", F.col(key).alias("file_id"), F.col("project_hash").alias("family"))

    def parse(paths: list[str]) -> Logs:
        t = numbered_lines(spark, paths, glob="*") if paths else spark.createDataFrame([], LINES)
        return from_lines(placed(t, ending).withColumn("file_id", F.col(key)))

    return Source(files, parse)


def has_logs(spark: SparkSession, root: str) -> bool:
    return not scan(spark, root).limit(1).isEmpty()


def keys_of(logs: Logs) -> DataFrame:
    """Keys alone, for ownership: nothing else is read of the requests."""
    return logs.requests.select("file_id", "turn_idx", "request_key")
