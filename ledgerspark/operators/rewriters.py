"""Rewriters of commands as one ladder of rules: the first rule that fits a tool call says how to ask for less, and what that saves.

A rule is a row of RULES: which tool, how the command begins, what it must and must not hold, and how it is changed. rewritten()
turns all rows into one expression of built-in functions, a CASE whose branches are tried in order, so that it runs in one
projection, on a table or on a stream alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- patterns ---------------------------------------------------------------------------------------------

#: Output already cut by a pager, commands joined, output sent elsewhere.
CUT, JOINED, SENT = r"\|\s*(head|tail|less|more)\b", r"&&|;|\|", r"[>|]\s*\S+"
PIPED = r"\|"


def flag(*names: str) -> str:
    return rf"(^|\s)({'|'.join(names)})(\s|\z|=)"


def letter(*names: str) -> str:
    """A short option, alone or among others after one dash."""
    return rf"(^|\s)-[a-zA-Z]*[{''.join(names)}][a-zA-Z]*(\s|\z)"


# -- changes ----------------------------------------------------------------------------------------------


def capped(lines: int, errors: bool = False) -> Callable[[Column, str], Column]:
    """Only the first lines, with the exit code of the command itself; with its errors if asked."""
    return lambda c, _: F.concat(F.lit("set -o pipefail; "), c, F.lit(f"{' 2>&1' if errors else ''} | awk 'NR<={lines}'"))


def added(text: str | Column) -> Callable[[Column, str], Column]:
    """More options right after what the command begins with."""
    return lambda c, begins: F.concat(F.regexp_extract(c, begins, 0), F.lit(" "), F.lit(text) if isinstance(text, str) else text, F.regexp_replace(c, begins, ""))


def elided(c: Column, _: str, head: int = 200, tail: int = 100, note: str = "lines elided") -> Column:
    """The first and last lines of a file that has more than both, with a note between."""
    program = (
        f"{{a[NR]=$0}} END{{n=NR; if(n>{head + tail}){{for(i=1;i<={head};i++)print a[i]; print \"... [\"n-{head}-{tail}\" {note}] ...\"; "
        f"for(i=n-{tail}+1;i<=n;i++)print a[i]}} else {{for(i=1;i<=n;i++)print a[i]}}}}"
    )
    return F.concat(F.lit(f"awk '{program}' "), F.regexp_extract(c, r"(\S+)\s*\z", 1))


QUIETER = (("--no-audit", flag("--no-audit", "--audit")), ("--no-fund", flag("--no-fund", "--fund")), ("--loglevel=error", flag("--loglevel", "--silent", "-s", "--quiet", "-q", "--verbose", "-d", "--ddd")))


def quieter(c: Column) -> Column:
    """Options of npm that are not given yet."""
    return F.concat_ws(" ", *[F.when(~c.rlike(given), option) for option, given in QUIETER])


# -- rules ------------------------------------------------------------------------------------------------


class Rule(NamedTuple):
    name: str
    begins: str
    change: Callable[[Column, str], Column]
    saved: int
    integrity: float
    without: tuple[str, ...] = ()
    holds: tuple[str, ...] = ()
    more: Callable[[Column], Column] | None = None


RECURSIVE, SUMS = (letter("r", "R"), flag("--recursive")), (letter("c", "l"), flag("--count", "--files-with-matches"))
LINES = (letter("n", "o", "A", "B", "C"), flag("--line-number", "--only-matching", "--context"))
either = "|".join

#: Names, beginnings, options, limits, savings and integrity of the rules for shell commands, in the order in which they are tried.
RULES = (
    Rule("git-status", "git status", added("-s"), 800, 0.8, (flag("-s", "--short", "--porcelain"),)),
    Rule("git-log", "git log", added("--oneline -n 20"), 3000, 0.3, (flag("--oneline", "--pretty", "--format", "-n"), "--max-count")),
    Rule("git-diff", "git diff|git show", capped(200), 3500, 0.5, (flag("--stat", "--numstat", "--name-only", "--name-status", "--shortstat"), CUT, JOINED)),
    Rule("npm-ls", "npm ls|npm list", added("--depth=0"), 5000, 0.5, (flag("--depth", "-a", "--all", "--json", "--parseable"),)),
    Rule("npm-install", "npm install|npm i|npm add", lambda c, begins: added(quieter(c))(c, begins), 3000, 0.95, more=lambda c: quieter(c) != ""),
    Rule("npm-view", "npm view|npm info", capped(80, True), 2500, 0.55, (CUT, SENT, flag("--json")), more=lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: ~w.startswith("-"))) == 3),
    Rule("cargo", "cargo build|cargo check|cargo test", added("--quiet"), 2500, 0.85, (flag("--quiet", "-q", "--verbose", "-v", "-vv"),)),
    Rule("tsc", "tsc|npx tsc", capped(100, True), 3000, 0.55, (CUT, SENT, flag("--listFiles", "--listEmittedFiles", "--version", "-v"))),
    Rule("ls", "ls|dir", capped(50), 1500, 0.6, (CUT, JOINED)),
    Rule("find", "find|fd", capped(100), 2500, 0.5, (CUT, JOINED)),
    Rule("grep", "grep|rg", capped(50), 1500, 0.6, (*SUMS, CUT, PIPED), (either(RECURSIVE), either(LINES))),
    Rule("grep", "grep|rg", added("-c"), 4000, 0.8, (*SUMS, *LINES), (either(RECURSIVE),)),
    Rule("grep", "grep|rg", capped(50), 1500, 0.6, (*RECURSIVE, CUT, PIPED)),
    Rule("cat", "cat", elided, 2000, 0.55, (JOINED,), (r"^cat(?:\s+-[^\s]+)?\s+(\S+)\s*\z",)),
)
#: Tools with a limit of their own, and what asks for none.
NATIVE = (("native-grep", "Grep", 100, 2000, 0.78, "count"), ("native-glob", "Glob", 100, 1500, 0.75, None))
RESULT = "struct<rewriter: string, saved_tokens: long, integrity: double, command: string, head_limit: long>"


def fits(rule: Rule, command: Column) -> Column:
    """Whether the rule takes the command (without white space around it)."""
    tests = [command.rlike(rf"^({rule.begins})([ \t\n]|\z)"), *[~command.rlike(p) for p in rule.without], *[command.rlike(p) for p in rule.holds]]
    return reduce(lambda a, b: a & b, tests if rule.more is None else [*tests, rule.more(command)])


def rewritten(calls: DataFrame) -> DataFrame:
    """calls with ``rewrite``: rewriter, saved_tokens, integrity, and the new command or head_limit; null where no rule takes the call.

    calls: name, command (of shell calls), pattern (of searches) and, if there, head_limit and output_mode.
    """
    of = lambda c, kind: F.col(c) if c in calls.columns else F.lit(None).cast(kind)
    command = F.regexp_replace(F.coalesce(of("command", "string"), F.lit("")), r"^\s+|\s+\z", "")
    row = lambda name, saved, integrity, new, limit: F.struct(F.lit(name), F.lit(saved), F.lit(integrity), new, F.lit(limit)).cast(RESULT)
    none = F.lit(None).cast("string")
    branches = [((F.col("name") == "Bash") & fits(r, command), row(r.name, r.saved, r.integrity, r.change(command, rf"^({r.begins})"), None)) for r in RULES]
    for name, tool, limit, saved, integrity, but in NATIVE:
        asks = (F.col("name") == tool) & (F.length(of("pattern", "string")) > 0) & of("head_limit", "long").isNull()
        branches.append((asks if but is None else asks & (F.coalesce(of("output_mode", "string"), F.lit("")) != but), row(name, saved, integrity, none, limit)))
    (first, value), *rest = branches
    ladder = reduce(lambda c, b: c.when(*b), rest, F.when(first, value))
    return calls.withColumn("rewrite", ladder)
