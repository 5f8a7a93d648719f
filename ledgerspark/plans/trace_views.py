"""The driver tables seen as session logs, so that every operator runs on them too.

lineitem and orders are request lines (an order is a session), events are tool calls and limit readings.
Each view has SQL of the same name in SQL_VIEWS for the oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint_folder

#: Price rows of the views: as_of, provider, model, input, output, cache_read, cache_write, cache_write_1h, long_over, and the long-prompt rates.
PRICES = (
    ("1994-01-01", "a", "model-af", 3.0, 15.0, 0.3, 3.75, None, None, None, None, None, None, None),
    ("1994-01-01", "a", "model-no", 5.0, 25.0, 0.5, 6.25, 10.0, None, None, None, None, None, None),
    ("1996-06-01", "a", "model-af", 2.0, 10.0, 0.2, 2.5, 4.0, 60000, 4.0, 20.0, 0.4, 5.0, 8.0),
    ("1996-06-01", "a", "model-rf", 1.0, 5.0, 0.1, 1.25, 2.0, None, None, None, None, None, None),
)
#: Days of the price files that price_folder() writes.
PRICE_DAYS = ("1994-01-01", "1996-06-01", "1997-09-01")
RATE_COLS = ("input", "output", "cache_read", "cache_write", "cache_write_1h")
PRICE_SCHEMA = "as_of string, provider string, model string, " + ", ".join(f"{c} double" for c in RATE_COLS) + ", long_over long, " + ", ".join(f"long_{c} double" for c in RATE_COLS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in PRICES], PRICE_SCHEMA).withColumn("as_of", F.to_date("as_of"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request lines: file, line number, key (null for one line in seven), usage and the rest."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    model = F.concat(F.lit("model-"), F.lower(F.concat("l_returnflag", "l_linestatus")), F.when(F.col("l_partkey") % 2 == 0, F.lit("-20250101")).otherwise(F.lit("")))
    return x.select(
        F.col("l_orderkey").alias("file_id"), F.row_number().over(order).cast("long").alias("line_no"), F.col("o_custkey").alias("project"),
        F.when(F.col("l_linenumber") < 7, F.concat(F.lit("m"), (F.col("l_partkey") % 500).cast("string"), F.lit("|"), F.col("l_linenumber").cast("string"))).alias("request_key"),
        model.alias("model"), F.col("l_shipdate").alias("ts"), F.floor("l_extendedprice").cast("long").alias("input"), (F.floor("l_quantity") * 100).cast("long").alias("output"),
        F.col("l_partkey").cast("long").alias("cache_read"), (F.col("l_suppkey") * 10).cast("long").alias("cache_write"), F.col("l_suppkey").cast("long").alias("cache_write_1h"),
        (F.col("l_discount") == 0).alias("missing_usage"), F.concat(F.lit("2.1."), (F.col("l_partkey") % 12).cast("string")).alias("version"),
        F.when(F.col("l_tax") > 0.07, F.lit("sdk-cli")).otherwise(F.lit("cli")).alias("entrypoint"), (F.col("l_tax") == 0).alias("sidechain"),
        (F.col("l_linestatus") == "F").alias("after_tool_result"), (F.col("l_suppkey") % 2 == 0).alias("cache_split"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls: a user's events in time order, five to a turn."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    x = e.withColumn("call_idx", (F.row_number().over(order) - 1).cast("long"))
    name = F.when(F.col("event_type").isin("view", "click"), "Read").when(F.col("event_type") == "purchase", "Edit").when(F.col("event_type") == "signup", "Grep").otherwise("Bash")
    path = F.concat(F.lit("/f/"), F.get_json_object("props", "$.k"), F.element_at(F.array(*map(F.lit, (".py", ".md", ".tsx"))), (F.col("user_id") % 3 + 1).cast("int")))
    pattern = F.when(name == "Grep", F.when(F.col("event_id") % 3 > 0, "x").otherwise(""))
    command = F.when(name == "Bash", F.when(F.col("event_id") % 7 == 0, " rg x").otherwise("ls"))
    return x.select(F.col("user_id").alias("file_id"), F.floor(F.col("call_idx") / 5).cast("long").alias("turn_idx"), "call_idx", name.alias("name"), path.alias("path"), path.alias("raw_path"), F.ceil("value").cast("long").alias("result_tokens"), pattern.alias("pattern"), command.alias("command"))


def call_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that the calls belong to, with usage."""
    c = calls(spark, sf_dir)
    return c.groupBy("file_id", "turn_idx").agg((F.sum("result_tokens") * 7).alias("input"), (F.max("result_tokens") * 11).alias("output"), F.sum("result_tokens").alias("cache_read"), (F.min("result_tokens") * 13).alias("cache_write"))


def orders_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as finished session summaries; tokens come from their total."""
    o = table(spark, sf_dir, "orders")
    total = F.floor(F.col("o_totalprice")).cast("long")
    return o.select(
        F.col("o_orderkey").alias("file_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 40).cast("string")).alias("project"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("ended_at"),
        F.col("o_totalprice").alias("usd"), total.alias("total_tokens"), F.floor(total / 10).cast("long").alias("output"), F.floor(total / 5).cast("long").alias("input"),
        F.floor(total / 2).cast("long").alias("cache_read"), (total - F.floor(total / 10) - F.floor(total / 5) - F.floor(total / 2)).cast("long").alias("cache_write"),
        (F.col("o_orderkey") % 997).cast("long").alias("dup_tokens"), (F.col("o_orderkey") % 499).cast("long").alias("idle_tokens"), (F.col("o_orderkey") % 9 + 1).cast("long").alias("n_requests"),
        F.concat(F.lit("model-"), F.lower("o_orderstatus")).alias("primary_model"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit readings: three limits with five-hour windows."""
    e = table(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    five = 5 * 3_600_000
    return e.select(
        at.alias("at"), F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("l"), (F.col("user_id") % 3).cast("string")).alias("limit_id"), F.lit(300).cast("long").alias("window_minutes"),
        F.least(F.lit(100.0), F.floor("value")).alias("used_percent"), ((F.floor(at / five) + 1) * five).cast("long").alias("resets_at"), F.lit("plan").alias("plan_type"),
    )


def limit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        (at + 1000).alias("at"), F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("/w/"), (F.col("user_id") % 7).cast("string")).alias("cwd"),
        F.when((F.col("event_type") == "error") & (F.col("user_id") % 5 == 0), "codex-auto-review").when((F.col("event_type") == "click") & (F.col("user_id") % 5 == 1), F.lit(None)).otherwise("model-x").alias("model"), F.floor(F.col("value") * 10).cast("long").alias("tokens"),
    )


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the version detectors: events by user as a request sequence."""
    e = table(spark, sf_dir, "events")
    v = F.floor("value").cast("long")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("file_id"), (F.row_number().over(order) - 1).cast("long").alias("turn_idx"), F.col("user_id").cast("string").alias("session"),
        F.concat(F.lit("2.1."), (F.col("user_id") % 14 + 80).cast("string")).alias("version"), F.when(F.col("event_type") == "view", "m-a").otherwise("m-b").alias("model"),
        F.when(F.col("event_type") == "signup", "sdk-ts").otherwise("cli").alias("entry"), (F.col("event_id") % 17 == 0).alias("side"), F.floor((F.unix_millis(F.col("ts").cast("timestamp")) / 3600)).cast("long").alias("ts"),
        (v * 17 % 900).alias("inp"), (v * 701 % 60000).alias("cr"), (v * 31 % 9000).alias("cw"), (v * 13 % 5000).alias("c5"), (v * 11 % 3000).alias("c1"), v.alias("out"),
        (F.lit(30000) + v * 977 % 70000).alias("ctx"), (F.col("event_id") % 2 == 0).alias("after_tool"),
    )


def log_folder(spark: SparkSession, sf_dir: str, session: Column | None = None) -> str:
    """lines() written as assistant logs, a file for each of 200 groups of customers, into the checkpoint folder; the folder's path."""
    x = lines(spark, sf_dir).withColumn("session", session if session is not None else F.concat(F.lit("c"), (F.col("project") % 200).cast("string")))
    key = F.split("request_key", r"\|")
    tokens = F.struct(
        F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), F.col("cache_write").alias("cache_creation_input_tokens"),
        F.when(F.col("cache_split"), F.struct((F.col("cache_write") - F.col("cache_write_1h")).alias("ephemeral_5m_input_tokens"), F.col("cache_write_1h").alias("ephemeral_1h_input_tokens"))).alias("cache_creation"),
    )
    message = F.struct(key[0].alias("id"), "model", F.when(~F.col("missing_usage"), tokens).alias("usage"))
    line = F.struct(
        F.lit("assistant").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'00:00:00.000'Z'").alias("timestamp"), F.col("session").alias("sessionId"), F.concat(F.lit("/w/"), "session").alias("cwd"),
        key[1].alias("requestId"), "version", "entrypoint", F.col("sidechain").alias("isSidechain"), message.alias("message"),
    )
    x = x.repartition("session").sortWithinPartitions("session", "file_id", "line_no")  # columns are shuffled and sorted; they become text, which is longer, where they are written
    path = f"{checkpoint_folder(spark)}/logs-{uuid.uuid4().hex}"
    x.select("session", F.to_json(line).alias("value")).write.partitionBy("session").text(path)
    return path


#: Commands that commands() deals to the shell calls.
COMMANDS = (
    "git status", " git status -s", "git status --short=x", "git statusx", "git log", "git log -n 5", "git log --max-count=3", "git log --pretty=%h", "git diff", "git diff --stat", "git show HEAD | head -5", "git show a && ls", "npm ls", "npm list --depth 1",
    "npm install", "npm i x --no-audit --no-fund --silent", "npm add x --fund", "npm view x", "npm view x version", "npm info x --json", "npm info -g x", "cargo build", "cargo test -vv", "cargo check --release", "tsc", "npx tsc --noEmit", "tsc > log", "tsc -v",
    "ls -la", "ls | wc", "dir", "find . -name x", "fd x; ls", "fd x", "grep -rn x .", "grep -r x .", "grep -rl x .", "grep -Rc x", "rg x", "rg x | tail", "grep x | sort", "rg --recursive x", "rg --recursive --context=2 x | sort", "cat a.py", "cat -n a.py ", "cat a b", "cat a; ls", "cat", "echo hi",
)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of shells and searches."""
    k = F.col("event_id")
    name = F.when(k % 5 == 0, "Grep").when(k % 7 == 0, "Glob").when(k % 11 == 0, "Read").otherwise("Bash")
    return table(spark, sf_dir, "events").select(
        k.alias("call_id"), name.alias("name"), F.when(name == "Bash", F.element_at(F.array(*map(F.lit, COMMANDS)), (k % len(COMMANDS) + 1).cast("int"))).alias("command"),
        F.when(name != "Bash", F.when(k % 3 > 0, "x").otherwise("")).alias("pattern"), F.when(k % 4 == 0, F.lit(9)).cast("long").alias("head_limit"), F.when(k % 6 == 0, "count").alias("output_mode"),
    )


def price_folder(spark: SparkSession, sf_dir: str) -> str:
    """part as price files in the checkpoint folder: a brand is a model, every fifth one the second provider's, with three tables each; the folder's path.

    Each table is a folder whose name is that of a price file, as Spark names the files inside.
    """
    p = table(spark, sf_dir, "part")
    day = F.element_at(F.array(*map(F.lit, PRICE_DAYS)), (F.col("p_size") % 3 + 1).cast("int"))
    p = p.select(F.lower("p_brand").alias("model"), day.alias("as_of"), F.col("p_size").cast("double").alias("s")).groupBy("model", "as_of").agg(F.max("s").alias("s"))
    named = lambda k: [(F.col("s") * k * x).alias(n) for n, x in zip(("input_per_mtok", "output_per_mtok", "cache_read_per_mtok", "cache_creation_per_mtok"), (0.5, 2.5, 0.0625, 0.625), strict=True)]
    hour = lambda k: F.when(F.col("s") % 2 == 0, F.col("s") * k).alias("cache_creation_1h_per_mtok")
    long = F.when(F.col("s") > 45, F.struct(F.lit(60000).alias("over_tokens"), *named(2), hour(2))).alias("long_prompt")
    file = F.concat(F.when(F.regexp_extract("model", r"(\d+)$", 1).cast("int") % 5 == 0, "openai-").otherwise(""), "as_of")
    p = p.groupBy(file.alias("file"), "as_of").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(*named(1), hour(1), long)))).alias("models"))
    path = f"{checkpoint_folder(spark)}/prices-{uuid.uuid4().hex}"
    p.select("file", F.to_json(F.struct("as_of", F.lit("part").alias("source_url"), "models")).alias("value")).write.partitionBy("file").text(path)
    return path


def wild_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit readings of 53 limits whose resets drift, come early, fall back to an older window, jump ahead, or lie before the reading."""
    e = table(spark, sf_dir, "events")
    at, k = F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id")
    window = F.when(F.col("user_id") % 2 == 0, F.lit(300)).otherwise(F.lit(10080)).cast("long")
    length = window * 60_000
    shift = F.when(k % 11 == 0, -length).when(k % 13 == 0, length).when(k % 17 == 0, F.lit(-20 * 60_000)).when(k % 19 == 0, F.lit(20 * 60_000)).otherwise(k % 7 * 60_000)
    return e.select(
        at.alias("at"), k.cast("string").alias("session_id"), F.concat(F.lit("w"), (F.col("user_id") % 53).cast("string")).alias("limit_id"), window.alias("window_minutes"),
        F.least(F.lit(100.0), F.floor("value")).alias("used_percent"), ((F.floor(at / length) + 1) * length + shift).cast("long").alias("resets_at"), F.lit("plan").alias("plan_type"),
    )


def idle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_rows() with an idle hour before every fourth request."""
    return sample_rows(spark, sf_dir).withColumn("ts", F.col("ts") + F.floor(F.col("turn_idx") / 4) * 3_700_000)


SQL_VIEWS = {
    "prices": "prices AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x) for x in r) + ")" for r in PRICES)
    + ") t(as_of, provider, model, p_input, p_output, p_cache_read, p_cache_write, p_cache_write_1h, long_over, l_input, l_output, l_cache_read, l_cache_write, l_cache_write_1h))",
    "lines": """lines AS (SELECT l_orderkey AS file_id,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS line_no,
 o_custkey AS project, CASE WHEN l_linenumber < 7 THEN 'm' || (l_partkey % 500) || '|' || l_linenumber END AS request_key,
 'model-' || lower(l_returnflag || l_linestatus) || CASE WHEN l_partkey % 2 = 0 THEN '-20250101' ELSE '' END AS model, l_shipdate AS ts,
 CAST(floor(l_extendedprice) AS BIGINT) AS input, CAST(floor(l_quantity) * 100 AS BIGINT) AS output, l_partkey AS cache_read, l_suppkey * 10 AS cache_write, l_suppkey AS cache_write_1h,
 l_discount = 0 AS missing_usage, '2.1.' || (l_partkey % 12) AS version, CASE WHEN l_tax > 0.07 THEN 'sdk-cli' ELSE 'cli' END AS entrypoint, l_tax = 0 AS sidechain,
 l_linestatus = 'F' AS after_tool_result, l_suppkey % 2 = 0 AS cache_split
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "log_lines": """log_lines AS (SELECT 'c' || (project % 200) AS file_id, row_number() OVER (PARTITION BY project % 200 ORDER BY file_id, line_no) AS line_no, request_key, model, ts, version,
 CASE WHEN missing_usage THEN 0 ELSE input END AS input, CASE WHEN missing_usage THEN 0 ELSE output END AS output, CASE WHEN missing_usage THEN 0 ELSE cache_read END AS cache_read,
 CASE WHEN missing_usage THEN 0 ELSE cache_write END AS cache_write, CASE WHEN missing_usage OR NOT cache_split THEN 0 ELSE cache_write_1h END AS cache_write_1h, missing_usage FROM lines)""",
    "calls": """calls AS (SELECT user_id AS file_id, n // 5 AS turn_idx, n AS call_idx,
 CASE WHEN event_type IN ('view', 'click') THEN 'Read' WHEN event_type = 'purchase' THEN 'Edit' WHEN event_type = 'signup' THEN 'Grep' ELSE 'Bash' END AS name,
 '/f/' || json_extract_string(props, '$.k') || ['.py', '.md', '.tsx'][1 + user_id % 3] AS path, CAST(ceil(value) AS BIGINT) AS result_tokens, event_id
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events))""",
    "turns": """turns AS (SELECT file_id, turn_idx, CAST(sum(result_tokens) * 7 AS BIGINT) AS input, max(result_tokens) * 11 AS output, CAST(sum(result_tokens) AS BIGINT) AS cache_read, min(result_tokens) * 13 AS cache_write
 FROM calls GROUP BY 1, 2)""",
    "sessions": """sessions AS (SELECT file_id, project, started_at, started_at AS ended_at, usd, t AS total_tokens, t // 10 AS output, t // 5 AS input, t // 2 AS cache_read, t - t // 10 - t // 5 - t // 2 AS cache_write,
 file_id % 997 AS dup_tokens, file_id % 499 AS idle_tokens, file_id % 9 + 1 AS n_requests, primary_model
 FROM (SELECT o_orderkey AS file_id, 'p' || (o_custkey % 40) AS project, o_orderdate AS started_at, o_totalprice AS usd, CAST(floor(o_totalprice) AS BIGINT) AS t, 'model-' || lower(o_orderstatus) AS primary_model FROM orders))""",
    "readings": """readings AS (SELECT at_ms, session_id, limit_id, 300 AS window_minutes, used_percent, (at_ms // 18000000 + 1) * 18000000 AS resets_at FROM
 (SELECT (epoch_us(ts) // 1000) AS at_ms, CAST(user_id AS VARCHAR) AS session_id, 'l' || (user_id % 3) AS limit_id, least(100.0, floor(value)) AS used_percent FROM events))""",
    "limit_requests": """limit_requests AS (SELECT (epoch_us(ts) // 1000) + 1000 AS at_ms, CAST(user_id AS VARCHAR) AS session_id, '/w/' || (user_id % 7) AS cwd,
 CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'codex-auto-review' WHEN event_type = 'click' AND user_id % 5 = 1 THEN NULL ELSE 'model-x' END AS model, CAST(floor(value * 10) AS BIGINT) AS tokens FROM events)""",
    "commands": f"""commands AS (SELECT *, CASE WHEN name = 'Bash' THEN {list(COMMANDS)}[1 + call_id % {len(COMMANDS)}] END AS command, CASE WHEN name <> 'Bash' THEN CASE WHEN call_id % 3 > 0 THEN 'x' ELSE '' END END AS pattern FROM
 (SELECT event_id AS call_id, CASE WHEN event_id % 5 = 0 THEN 'Grep' WHEN event_id % 7 = 0 THEN 'Glob' WHEN event_id % 11 = 0 THEN 'Read' ELSE 'Bash' END AS name, event_id % 4 = 0 AS limited, event_id % 6 = 0 AS counts FROM events))""",
    "wild_readings": """wild_readings AS (SELECT at_ms, session_id, limit_id, window_minutes, used_percent, (at_ms // length + 1) * length + CASE WHEN k % 11 = 0 THEN -length WHEN k % 13 = 0 THEN length WHEN k % 17 = 0 THEN -1200000 WHEN k % 19 = 0 THEN 1200000 ELSE k % 7 * 60000 END AS resets_at FROM
 (SELECT epoch_us(ts) // 1000 AS at_ms, event_id AS k, CAST(event_id AS VARCHAR) AS session_id, 'w' || (user_id % 53) AS limit_id, CASE WHEN user_id % 2 = 0 THEN 300 ELSE 10080 END AS window_minutes, CASE WHEN user_id % 2 = 0 THEN 300 ELSE 10080 END * 60000 AS length, least(100.0, floor(value)) AS used_percent FROM events))""",
    "price_rows": f"""price_rows AS (SELECT lower(p_brand) AS model, {list(PRICE_DAYS)}[1 + p_size % 3] AS as_of, CASE WHEN CAST(regexp_extract(p_brand, '[0-9]+$') AS INT) % 5 = 0 THEN 'openai' ELSE 'anthropic' END AS provider, CAST(max(p_size) AS DOUBLE) AS s FROM part GROUP BY ALL)""",
    "idle_rows": "idle_rows AS (SELECT * EXCLUDE (ts), ts + turn_idx // 4 * 3700000 AS ts FROM sample_rows)",
    "sample_rows": """sample_rows AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_idx, '2.1.' || (user_id % 14 + 80) AS version,
 CASE WHEN event_type = 'view' THEN 'm-a' ELSE 'm-b' END AS model, CASE WHEN event_type = 'signup' THEN 'sdk-ts' ELSE 'cli' END AS entry, event_id % 17 = 0 AS side, (epoch_us(ts) // 1000) // 3600 AS ts,
 v * 17 % 900 AS inp, v * 701 % 60000 AS cr, v * 31 % 9000 AS cw, v * 13 % 5000 AS c5, v * 11 % 3000 AS c1, v AS out, 30000 + v * 977 % 70000 AS ctx, event_id % 2 = 0 AS after_tool
 FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM events))""",
}


def sql(body: str, *views: str) -> str:
    """body with the named views before it; body may start with more common tables, each ending in a comma, before SELECT."""
    return "WITH RECURSIVE " + ",\n".join(SQL_VIEWS[v] for v in views) + (",\n" if not body.lstrip().upper().startswith("SELECT") else "\n") + body
