"""Task estimates from past sessions of the same shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights that turn a session's tokens into input tokens of the same price; limits on the sessions used.
OUTPUT, CACHE_READ, CACHE_WRITE, CACHE_WRITE_1H = 5.0, 0.1, 1.25, 2.0
MOST_TOKENS, MOST_SESSIONS = 5_000_000, 120


def weighted_tokens() -> Column:
    """A request's tokens as input tokens."""
    hour = F.greatest(F.lit(0), F.least(F.coalesce("cache_write_1h", F.lit(0)), F.col("cache_write")))
    return F.col("input") + F.col("output") * OUTPUT + F.col("cache_read") * CACHE_READ + (F.col("cache_write") - hour) * CACHE_WRITE + hour * CACHE_WRITE_1H


def shapes(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """file_id, tool_calls, distinct_reads, tokens of each session with requests."""
    tokens = requests.groupBy("file_id").agg(F.round(F.sum(weighted_tokens())).cast("long").alias("tokens"))
    path = F.when(F.col("name") == "Read", F.lower("path"))
    per = calls.groupBy("file_id").agg(F.count(F.lit(1)).alias("tool_calls"), F.count_distinct(F.when(path != "", path)).alias("distinct_reads"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tool_calls", "distinct_reads")]
    return tokens.join(per, "file_id", "left").select("file_id", *zero, "tokens")


def tier() -> Column:
    """The tier whose ranges of calls and files read hold the session; null where they disagree."""
    calls, reads = F.col("tool_calls"), F.col("distinct_reads")
    return (
        F.when((calls >= 30) & (reads >= 20), "high")
        .when(calls.between(10, 29) & reads.between(5, 19), "medium")
        .when((calls < 10) & (reads < 5), "low")
    )


def anchors(shaped: DataFrame, order: str | None = None, most: int = MOST_SESSIONS) -> DataFrame:
    """tier, matched, median_tokens, confidence; with ``order``, only the newest ``most`` sessions count."""
    some = shaped if order is None else shaped.orderBy(F.col(order).desc(), "file_id").limit(most)
    some = some.withColumn("tier", tier()).filter(F.col("tier").isNotNull() & (F.col("tokens") > 0) & (F.col("tokens") <= MOST_TOKENS))
    out = some.groupBy("tier").agg(F.count(F.lit(1)).alias("matched"), F.floor(F.median("tokens") + 0.5).cast("long").alias("median_tokens"))
    return out.withColumn("confidence", F.when(F.col("matched") >= 3, "high").otherwise("medium"))


# -- what a task asks for, from its words ------------------------------------------------------------------------

#: An edge of a word of ASCII letters, digits and underscores, whatever the runtime takes for letters.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Verbs by their keywords (the first that fits), their tiers, what widens or narrows a task, how files are named.
VERBS = {
    "refactor": "refactor rewrite migrate redesign restructure overhaul port",
    "implement": "implement add build create introduce ship",
    "debug": "fix debug investigate diagnose troubleshoot repair resolve",
    "rename": "rename move delete remove comment uncomment format",
    "review": "explain review audit describe summarize document",
    "test": "test spec cover",
}
LEVEL = {"refactor": 2, "implement": 1, "debug": 2, "rename": 0, "review": 0, "test": 0}
WIDENS = ("across the (?:codebase|repo|project)", "everywhere", "all (?:files|modules|packages|tests)", "globally", "project-wide", "every")
NARROWS = ("just", "only", "single", "one[- ]line", "one[- ]liner", "quick", "tiny", "trivial")
FILE = r"[A-Za-z0-9_@./-]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|pyi|go|rs|md|json|toml|yaml|yml|sh|css|scss|html|vue|svelte)"
MODULE = r"the ([A-Za-z0-9_-]+) (?:module|package|service|component|handler|api|router|controller|store|hook|util|lib|client|server)"
NUMBER = r"([0-9]+)\s+(?:files?|modules?|packages?|services?|components?)"
TIERS, TURNS, READS = ("low", "medium", "high"), ((3, 8), (10, 25), (25, 45)), ((1, 5), (5, 15), (12, 25))
TURN_TOKENS, READ_TOKENS, FILE_TOKENS, MOST_FILE_TOKENS = 4000, 1500, 50, 30_000
TRUST, BAND = {"high": 0.8, "medium": 0.6}, (0.7, 1.4)


def word(pattern: str) -> str:
    return f"(?i){EDGE}(?:{pattern}){EDGE}"


def at_level(level: Column, values) -> Column:
    return F.get(F.array(*map(F.lit, values)), level)


def classified(tasks: DataFrame, text: str = "text") -> DataFrame:
    """tasks with verb, tier, files (mentioned), words, widens, narrows (how many patterns fit), turns_low, turns_high, reads_low, reads_high. A null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    verb = F
    for name, keys in VERBS.items():
        verb = verb.when(t.rlike(word(keys.replace(" ", "|"))), F.lit(name))
    all_of = lambda pattern, group: F.size(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(word(pattern)), F.lit(group)), F.lower)))
    named = all_of(FILE, 0) + all_of(MODULE, 1)
    digits = F.regexp_extract(t, word(NUMBER), 1)
    said = F.when(digits != "", F.least(digits.try_cast("double"), F.lit(9e15)).cast("long"))
    fits = lambda patterns: sum((t.rlike(word(p)).cast("int") for p in patterns), F.lit(0))
    trimmed = F.regexp_replace(t, r"\A\s+|\s+\z", "")
    out = tasks.withColumns({
        "verb": verb.otherwise("other"), "files": F.greatest(named.cast("long"), F.coalesce(said, F.lit(0))), "widens": fits(WIDENS), "narrows": fits(NARROWS),
        "words": F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))),
    })
    levels = F.create_map(*[F.lit(x) for pair in LEVEL.items() for x in pair])
    level = F.coalesce(F.try_element_at(levels, F.col("verb")), F.lit(1))
    shifts = ((F.col("files") >= 6, 1), (F.col("files") >= 12, 1), (F.col("widens") > 0, 1), (F.col("narrows") > 0, -1), (F.col("words") >= 60, 1))
    for holds, by in shifts:  # each in turn, within the three tiers
        level = F.greatest(F.lit(0), F.least(F.lit(2), level + F.when(holds, by).otherwise(0)))
    out = out.withColumn("_level", level)
    lo, debug = F.col("_level"), F.col("verb") == "debug"
    less = lambda values, by, least: F.when(debug, F.greatest(F.lit(least), at_level(lo, values) - by)).otherwise(at_level(lo, values))
    more = lambda values, by: at_level(lo, values) + F.when(debug, by).otherwise(0)
    (t0, t1), (r0, r1) = zip(*TURNS, strict=True), zip(*READS, strict=True)
    bands = {"tier": at_level(lo, TIERS), "turns_low": less(t0, 2, 3), "turns_high": more(t1, 10), "reads_low": less(r0, 1, 1), "reads_high": more(r1, 5)}
    return out.withColumns(bands).drop("_level")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def predicted(tasks: DataFrame, past: DataFrame | None = None, repo_files: int = 0, manifest_tokens: int = 0) -> DataFrame:
    """classified() tasks with tokens, tokens_low and tokens_high. past: anchors(), a row a tier at most, into which estimates of the tier are blended."""
    mid = lambda c: (F.col(f"{c}_low") + F.col(f"{c}_high")) / 2
    base = half_up(mid("turns") * TURN_TOKENS + mid("reads") * READ_TOKENS) + min(MOST_FILE_TOKENS, repo_files * FILE_TOKENS) + manifest_tokens
    if past is None:
        out = tasks.withColumn("tokens", base)
    else:
        trust = F.coalesce(*[F.when(F.col("confidence") == c, w) for c, w in TRUST.items()])
        heard = past.filter(trust.isNotNull() & (F.col("median_tokens") > 0)).select(F.col("tier").alias("_tier"), trust.alias("_trust"), F.col("median_tokens").alias("_past"))
        out = tasks.join(F.broadcast(heard), F.col("tier") == F.col("_tier"), "left")  # three tiers
        out = out.withColumn("tokens", F.coalesce(half_up(base * (1 - F.col("_trust")) + F.col("_past") * F.col("_trust")), base)).drop("_tier", "_trust", "_past")
    return out.withColumns({"tokens_low": half_up(F.col("tokens") * BAND[0]), "tokens_high": half_up(F.col("tokens") * BAND[1])})


def family() -> Column:
    """The family of models to take for a task."""
    high, verb = F.col("tier") == "high", F.col("verb")
    return F.when(F.col("tier") == "low", "haiku").when(high & (verb != "debug"), "opus").otherwise("sonnet")


def costs(tasks: DataFrame, input_rates: dict[str, float]) -> DataFrame:
    """predicted() tasks with, for each model (name: dollars a million input tokens), what they cost: usd_<model>, and _low and _high of it."""
    usd = lambda c, rate: half_up(F.col(c) * rate / 1_000_000 * 10_000) / 10_000
    return tasks.withColumns({f"usd_{m}{end}": usd(f"tokens{end}", rate) for m, rate in input_rates.items() for end in ("", "_low", "_high")})
