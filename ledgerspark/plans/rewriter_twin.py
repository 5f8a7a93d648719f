"""The ladder of rewriters as DuckDB SQL over the view ``commands``: what each saves, and the new command."""

from __future__ import annotations

from .trace_views import sql


def has(*names: str) -> str:
    return rf"regexp_matches(c, '(^|\s)({'|'.join(names)})(\s|$|=)')"


def short(letters: str) -> str:
    return rf"regexp_matches(c, '(^|\s)-[a-zA-Z]*[{letters}][a-zA-Z]*(\s|$)')"


def begins(*names: str) -> str:
    return rf"regexp_matches(c, '^({'|'.join(names)})(\s|$)')"


def head(lines: int, errors: str = "") -> str:
    return f"'set -o pipefail; ' || c || '{errors} | awk ''NR<={lines}'''"


def put(names: str, option: str) -> str:
    return rf"regexp_replace(c, '^({names})', '\1 ' || {option})"


GLUE, SENT = "(contains(c, '|') OR contains(c, '&&') OR contains(c, ';'))", r"regexp_matches(c, '[>|]\s*\S+')"
DEEP = f"({short('rR')} OR {has('--recursive')})"
SUMS = f"({short('cl')} OR {has('--count', '--files-with-matches')})"
ROWS = f"({short('noABC')} OR {has('--line-number', '--only-matching', '--context')})"
EXTRA = (
    f"concat_ws(' ', CASE WHEN NOT {has('--no-audit', '--audit')} THEN '--no-audit' END, CASE WHEN NOT {has('--no-fund', '--fund')} THEN '--no-fund' END, "
    f"CASE WHEN NOT {has('--loglevel', '--silent', '-s', '--quiet', '-q', '--verbose', '-d', '--ddd')} THEN '--loglevel=error' END)"
)
#: name, tokens saved, integrity, condition, new command
LADDER = (
    ("git-status", 800, 0.8, f"{begins('git status')} AND NOT {has('-s', '--short', '--porcelain')}", put("git status", "'-s'")),
    ("git-log", 3000, 0.3, f"{begins('git log')} AND NOT {has('--oneline', '--pretty', '--format', '-n')} AND NOT contains(c, '--max-count')", put("git log", "'--oneline -n 20'")),
    ("git-diff", 3500, 0.5, f"{begins('git diff', 'git show')} AND NOT {has('--stat', '--numstat', '--name-only', '--name-status', '--shortstat')} AND NOT {GLUE}", head(200)),
    ("npm-ls", 5000, 0.5, f"{begins('npm ls', 'npm list')} AND NOT {has('--depth', '-a', '--all', '--json', '--parseable')}", put("npm ls|npm list", "'--depth=0'")),
    ("npm-install", 3000, 0.95, f"{begins('npm install', 'npm i', 'npm add')} AND extra <> ''", put("npm install|npm i|npm add", "extra")),
    ("npm-view", 2500, 0.55, f"{begins('npm view', 'npm info')} AND NOT {SENT} AND NOT {has('--json')} AND len(list_filter(string_split(c, ' '), lambda w: NOT starts_with(w, '-'))) = 3", head(80, " 2>&1")),
    ("cargo", 2500, 0.85, f"{begins('cargo build', 'cargo check', 'cargo test')} AND NOT {has('--quiet', '-q', '--verbose', '-v', '-vv')}", put("cargo build|cargo check|cargo test", "'--quiet'")),
    ("tsc", 3000, 0.55, f"{begins('tsc', 'npx tsc')} AND NOT {SENT} AND NOT {has('--listFiles', '--listEmittedFiles', '--version', '-v')}", head(100, " 2>&1")),
    ("ls", 1500, 0.6, f"{begins('ls', 'dir')} AND NOT {GLUE}", head(50)),
    ("find", 2500, 0.5, f"{begins('find', 'fd')} AND NOT {GLUE}", head(100)),
    ("grep", 1500, 0.6, f"{begins('grep', 'rg')} AND NOT contains(c, '|') AND (NOT {DEEP} OR (NOT {SUMS} AND {ROWS}))", head(50)),
    ("grep", 4000, 0.8, f"{begins('grep', 'rg')} AND {DEEP} AND NOT {SUMS} AND NOT {ROWS}", put("grep|rg", "'-c'")),
    ("cat", 2000, 0.55, rf"regexp_matches(c, '^cat(\s+-[^\s]+)?\s+\S+\s*$') AND NOT {GLUE}", "'awk'"),
    ("native-grep", 2000, 0.78, "name = 'Grep' AND pattern <> '' AND NOT limited AND NOT counts", "CAST(NULL AS VARCHAR)"),
    ("native-glob", 1500, 0.75, "name = 'Glob' AND pattern <> '' AND NOT limited", "CAST(NULL AS VARCHAR)"),
)


def _case(column: int) -> str:
    return "CASE " + " ".join(f"WHEN k = {k} THEN {x[column]!r}" if column < 3 else f"WHEN k = {k} THEN {x[column]}" for k, x in enumerate(LADDER)) + " END"


FIRST = "CASE " + " ".join(f"WHEN {x[3]} THEN {k}" for k, x in enumerate(LADDER)) + " END"
REWRITTEN = sql(
    f"t AS (SELECT *, {EXTRA} AS extra FROM (SELECT *, trim(coalesce(command, '')) AS c FROM commands)), r AS (SELECT *, {FIRST} AS k FROM t)\n"
    f"SELECT call_id, {_case(0)} AS rewriter, CAST({_case(1)} AS DOUBLE) AS saved_tokens, CAST({_case(2)} AS DOUBLE) AS integrity, {_case(4)} AS command FROM r",
    "commands",
)
