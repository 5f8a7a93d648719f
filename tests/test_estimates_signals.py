"""Classified tasks, predictions, and signals as of a read, against plain Python."""

import random

import pytest

from ledgerspark.operators import estimate, signals


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Fix the crash in src/a.ts", ("debug", "high", 1, 23, 55, 11, 30)),
        ("rename foo", ("rename", "low", 0, 3, 8, 1, 5)),
        ("Add a flag everywhere", ("implement", "high", 0, 25, 45, 12, 25)),
        ("just add a flag", ("implement", "low", 0, 3, 8, 1, 5)),
        ("just fix it", ("debug", "medium", 0, 8, 35, 4, 20)),
        ("touch 7 files", ("other", "high", 7, 25, 45, 12, 25)),
        ("review 12 modules", ("review", "high", 12, 25, 45, 12, 25)),
        ("explain A.py a.py the auth service and the Auth service", ("review", "low", 2, 3, 8, 1, 5)),
        ("support for adding", ("other", "medium", 0, 10, 25, 5, 15)),
        ("", ("other", "medium", 0, 10, 25, 5, 15)),
        (None, ("other", "medium", 0, 10, 25, 5, 15)),
        ("test " + "word " * 59, ("test", "medium", 0, 10, 25, 5, 15)),
        ("é2 files of ép.py", ("other", "medium", 2, 10, 25, 5, 15)),
    ],
)
def test_classified(spark, text, want):
    row = estimate.classified(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.verb, row.tier, row.files, row.turns_low, row.turns_high, row.reads_low, row.reads_high) == want


def test_predicted(spark):
    tasks = estimate.classified(spark.createDataFrame([("rename a",), ("add b",), ("fix c",)], "text string"))
    past = spark.createDataFrame([("low", 5, 100_000, "high"), ("medium", 1, 10_000, "medium"), ("high", 3, 0, "high")], "tier string, matched long, median_tokens long, confidence string")
    rows = {r.verb: r for r in estimate.costs(estimate.predicted(tasks, past, repo_files=100, manifest_tokens=7), {"m": 3.0}).collect()}
    low, medium, high = 26_500 + 5007, 85_000 + 5007, 39 * 4000 + 20.5 * 1500 + 5007
    assert rows["rename"].tokens == int(low * (1 - 0.8) + 80_000 + 0.5)
    assert rows["implement"].tokens == int(medium * (1 - 0.6) + 6_000 + 0.5)
    assert rows["debug"].tokens == high and rows["debug"].tokens_low == int(high * 0.7 + 0.5)
    assert rows["debug"].usd_m == int(high * 3 / 1e6 * 1e4 + 0.5) / 1e4
    plain = {r.verb: r.tokens for r in estimate.predicted(tasks).collect()}
    assert plain == {"rename": 26_500, "implement": 85_000, "debug": 186_750}
    assert [r[0] for r in tasks.select(estimate.family()).collect()] == ["haiku", "sonnet", "sonnet"]


@pytest.mark.parametrize(
    ("name", "pattern", "command", "want"),
    [
        ("Grep", "foo", None, ("grep-pattern", "foo")),
        ("Glob", "*.py", None, ("glob-pattern", "*.py")),
        ("Grep", "", None, None),
        ("Bash", "x", "grep -rn --include=*.py 'needle' src", ("grep-pattern", "needle")),
        ("Bash", None, "  rg needle", ("grep-pattern", "needle")),
        ("Bash", None, "cat grep", None),
        ("Bash", None, None, None),
        ("Read", "foo", None, None),
    ],
)
def test_derived(spark, name, pattern, command, want):
    rows = spark.createDataFrame([(name, pattern, command)], "name string, pattern string, command string")
    assert [(r.kind, r.pattern) for r in signals.derived(rows).collect()] == ([want] if want else [])


@pytest.mark.parametrize(
    ("symbol", "pattern", "want"),
    [("parse", "parse", 1.0), ("Parse", "parse", 0.95), ("parseLine", "parse", 0.7 + 0.1 * 5 / 9), ("ab", "xaby", 0.75), ("parseHTTPBody", "httpb", 0.7 + 0.1 * 5 / 13), ("loadAll", "^load.*l$", 0.7), ("loadAll", "(", 0.0), ("", "a", 0.0), ("a" * 201, "^a+$", 0.0), ("snake_case", "x|case$", 0.7), ("none", "zzz", 0.0)],
)
def test_confidence(spark, symbol, pattern, want):
    out = signals.scored(spark.createDataFrame([(1, symbol)], "read_id long, symbol string"), spark.createDataFrame([(1, 1, pattern)], "read_id long, n long, pattern string")).first()
    assert out.confidence == pytest.approx(want)
    assert out.pattern == (pattern if want else None)


def test_signals_as_of_reads(spark):
    rng = random.Random(5)
    said = [(f"s{rng.randrange(3)}", rng.randrange(40) * signals.DAY // 8, i, rng.choice(["grep-pattern", "grep-pattern", "glob-pattern"]), f"p{i}") for i in range(300)]
    asked = [(f"s{rng.randrange(4)}", rng.randrange(44) * signals.DAY // 8, i) for i in range(60)]
    got = signals.as_of(spark.createDataFrame(said, "session string, at long, line long, kind string, pattern string"), spark.createDataFrame(asked, "session string, at long, read_id long"), newest=7)
    want = set()
    for session, at, i in asked:
        mine = sorted((x for x in said if x[0] == session and x[1] <= at), key=lambda x: (-x[1], x[2]))[:7]
        want |= {(i, x[4]) for x in mine if x[3] == "grep-pattern"}
    rows = got.collect()
    assert {(r.read_id, r.pattern) for r in rows} == want and len(rows) == len(want)


def test_newest_of_equal_patterns_and_bounds(spark):
    symbols = spark.createDataFrame([(1, "loadAll"), (1, "other"), (2, "x")], "read_id long, symbol string")
    patterns = spark.createDataFrame([(1, 1, "^load"), (1, 2, "All$"), (1, 3, "no")], "read_id long, n long, pattern string")
    rows = {(r.read_id, r.symbol): r for r in signals.scored(symbols, patterns).collect()}
    assert rows[1, "loadAll"].pattern == "All$" and rows[1, "other"].confidence == 0 and rows[2, "x"].confidence == 0
    assert [r.symbol for r in signals.relevant(signals.scored(symbols, patterns)).collect()] == ["loadAll"]
