"""documents seen as files of eight repositories, and DuckDB twins of the queries over them.

A document is a file: its place in its repository tells path and kind, and its whole text is the content, after the comment
and the import that its place gives it. The twins count lines, headings and folders by lists, not by the operators' patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .trace_views import table

NAME = "CASE k % 4 WHEN 0 THEN 'read-part-' WHEN 1 THEN 'load_' WHEN 2 THEN 'Model' ELSE CASE WHEN m = 5 THEN 'tmp' ELSE 'view' END END"
TAIL = "CASE WHEN k % 4 = 3 AND m <> 5 THEN 'x' ELSE '' END"
FOLDER = "CASE k % 5 WHEN 0 THEN 'src/a' WHEN 1 THEN 'src/b/c' WHEN 2 THEN 'lib' WHEN 3 THEN CASE WHEN m % 2 = 0 THEN 'lib/d' ELSE concat('m', k % 15) END ELSE CASE WHEN m = 3 THEN 'src/s/t/u/v/w/x' ELSE 'test' END END"
EXT = "CASE k % 6 WHEN 0 THEN 'ts' WHEN 1 THEN 'py' WHEN 2 THEN 'js' WHEN 3 THEN 'go' WHEN 4 THEN 'tsx' ELSE 'md' END"
PLACES = """CASE WHEN k = 0 AND m < 6 THEN 'README.md' WHEN k = 1 AND m <> 2 THEN 'CLAUDE.md' WHEN k = 2 AND m > 3 THEN '.cursorrules' WHEN k = 3 AND m < 5 THEN 'package.json' WHEN k = 4 AND m % 2 = 0 THEN 'yarn.lock'
 WHEN k = 5 AND m % 4 = 0 THEN 'bun.lock' WHEN k = 6 AND m <> 1 THEN '.gitignore' WHEN k = 7 AND m % 3 = 0 THEN 'pyproject.toml' WHEN k = 8 AND m % 2 = 0 THEN 'go.mod' WHEN k = 9 AND m % 3 = 1 THEN 'AGENTS.md'
 WHEN k = 10 AND m > 4 THEN 'src/index.ts' WHEN k % 13 = 11 THEN concat('docs/note-', k, '.md') WHEN k % 17 = 12 THEN concat('tests/test_', k, '.py') WHEN k % 19 = 13 AND m > 1 THEN concat('src/', k, '/utils.py') END"""
#: The view as SQL that Spark and DuckDB read alike.
FILES = f"""SELECT concat('r', m) AS repo, path, ext, CAST(length(text) AS BIGINT) AS size, CASE WHEN ext IN ('ts', 'tsx') THEN 'typescript' WHEN ext = 'js' THEN 'javascript' WHEN ext = 'py' THEN 'python' WHEN ext = 'go' THEN 'go' ELSE 'other' END AS language,
 path <> '.cursorrules' AS listed, CASE WHEN path = 'package.json' THEN concat('{{"name": "p', m, '", "dependencies": {{', CASE m WHEN 0 THEN '"jest": "1", "vitest": "1"' WHEN 1 THEN '"next": "1"' WHEN 2 THEN '"express": "4"' ELSE '"vite": "2"' END, '}}, "scripts": {{', CASE WHEN m % 2 = 0 THEN '"build": "x"' ELSE '' END, '}}}}')
 WHEN path = 'README.md' THEN concat('# t', chr(10), text, chr(10), CASE WHEN m % 2 = 0 THEN '## Usage' ELSE '## Why' END, chr(10), text) WHEN path = 'CLAUDE.md' THEN concat(CASE WHEN m > 4 THEN 'use /review' ELSE 'plain' END, chr(10), text)
 WHEN path = 'pyproject.toml' THEN concat('[tool.x]', chr(10), text) WHEN ext IN ('ts', 'tsx', 'js') THEN concat(CASE WHEN k % 3 = 0 OR m = 7 THEN '' WHEN k % 2 = 0 THEN concat('/** What ', k, ' is for. */', chr(10)) ELSE concat('// part ', k, chr(10)) END, 'import {{ x }} from "./', stem, k - 60, tail, '"', chr(10), text)
 WHEN ext = 'py' THEN concat(CASE WHEN k % 4 = 0 OR m = 7 THEN '' ELSE concat('# part ', k, chr(10)) END, 'from .', stem, k - 60, tail, ' import y', chr(10), text) WHEN ext = 'go' THEN concat('// Package ', k, chr(10), 'import "fmt"', chr(10), text) ELSE text END AS content
 FROM (SELECT *, CASE WHEN path LIKE '%.%' THEN regexp_extract(path, '([^.]*)$', 1) ELSE '' END AS ext FROM
 (SELECT *, coalesce({PLACES}, concat({FOLDER}, '/', stem, k, tail, '.', {EXT})) AS path FROM (SELECT *, {NAME} AS stem, {TAIL} AS tail FROM (SELECT coalesce(text, '') AS text, doc_id % 8 AS m, CAST(floor(doc_id / 8) AS BIGINT) AS k FROM documents WHERE doc_id IS NOT NULL) a) b) c) d"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    braces = FILES.replace("{", "{{").replace("}", "}}")  # spark.sql reads a brace as the start of a table's name
    return spark.sql(braces.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


TWIN = f"WITH files AS ({FILES}),\n"
BASE = "regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '')"
SOURCE = "ext IN ('ts', 'tsx', 'js', 'py', 'go')"
EDGES = """found AS (SELECT repo, path, string_split(path, '/')[:-2] AS dirs, language, unnest(CASE WHEN language = 'python' THEN regexp_extract_all(content, '(?:^|\\n)[ \\t]*from\\s+([.\\w]+)\\s+import\\s+\\S', 1) WHEN language IN ('typescript', 'javascript') THEN regexp_extract_all(content, 'import\\s+\\{[^}]*\\}\\s+from\\s+"([^"]+)"', 1) END) AS spec FROM files WHERE listed),
aimed AS (SELECT repo, path, list_aggregate(list_concat(dirs, [CASE WHEN language = 'python' THEN spec[2:] || '.py' ELSE spec[3:] END]), 'string_agg', '/') AS target FROM found WHERE spec LIKE '.%'),
edges AS (SELECT DISTINCT a.repo, a.path AS importer, a.target || e AS imported, i FROM aimed a, (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js')) x(i, e) WHERE (a.repo, a.target || e) IN (SELECT (repo, path) FROM files WHERE listed) QUALIFY row_number() OVER (PARTITION BY a.repo, a.path, a.target ORDER BY i) = 1)"""
IMPORTS = TWIN + EDGES + " SELECT repo, importer, imported, count(*) OVER (PARTITION BY repo, imported) AS used_by FROM edges"
PURPOSES = TWIN + """said AS (SELECT repo, path, CASE WHEN language = 'python' THEN CASE WHEN content LIKE '# %' THEN string_split(content, chr(10))[1][3:] END WHEN content LIKE '/** %' THEN trim(regexp_extract(content, '/\\*\\*(.*?)\\*/', 1)) WHEN content LIKE '// %' THEN string_split(content, chr(10))[1][4:] END AS s,
 regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '') AS base FROM files WHERE listed AND language <> 'other')
SELECT repo, path, coalesce(s, CASE WHEN path LIKE '%/test%' THEN 'tests for ' ELSE '' END || lower(regexp_replace(list_aggregate(list_filter(regexp_split_to_array(base, '[-_.]'), lambda w: w <> ''), 'string_agg', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g'))) AS purpose FROM said"""
FACTS = f"""heads AS (SELECT repo, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '^#{{1,6}}\\s')) AS h, ls, content FROM (SELECT repo, content, regexp_split_to_array(content, '\\r?\\n') AS ls FROM files WHERE path = 'README.md')),
readme AS (SELECT repo, length(trim(content)) > 200 AS big, content LIKE '%' || chr(10) || '## Usage%' AS start, len(list_filter(regexp_split_to_array(regexp_replace(array_to_string(ls[h[1] + 1 : coalesce(h[2] - 1, len(ls))], ' '), '[`*_>#]', ' ', 'g'), '\\s+'), lambda w: w <> '')) >= 80 AS rich FROM heads),
src AS (SELECT *, {BASE} AS base, len(string_split(content, chr(10))) AS loc, regexp_matches(content, '^(//|/\\*|# )') AS said FROM files WHERE {SOURCE}),
kinds AS (SELECT repo, count(*) AS n, max(c) AS most, sum(c) AS alls FROM (SELECT repo, list_aggregate(string_split(path, '/')[:-2], 'string_agg', '/') AS dir, CASE WHEN base LIKE '%-%' THEN 1 WHEN base LIKE '%\\_%' ESCAPE '\\' THEN 2 WHEN base LIKE 'Model%' THEN 3 ELSE 4 END AS kind, count(*) AS c FROM src GROUP BY ALL) GROUP BY repo, dir),
tops AS (SELECT repo, string_split(path, '/')[1] AS top, count(*) AS n FROM files WHERE listed AND path LIKE '%/%' GROUP BY ALL),
f AS (SELECT repo, count(*) FILTER (listed) AS n_files, list(path) AS paths, max(len(string_split(path, '/')) - 1) AS depth, max(CASE WHEN path = 'CLAUDE.md' THEN content END) AS rules, max(CASE WHEN path = '.cursorrules' THEN content END) AS rival,
 max(CASE WHEN path = 'go.mod' THEN content END) AS go_mod, count(*) FILTER (path LIKE 'tests/test%' OR path LIKE 'test/%') AS central, bool_or(path = 'AGENTS.md' AND trim(content) <> '') AS agents FROM files GROUP BY 1),
s AS (SELECT repo, bool_or(loc > 1000) AS long, bool_or(regexp_matches(base, '^tmp\\d*$')) AS bad, bool_or(base = 'utils' AND loc > 200) AS generic, bool_or(path LIKE 'test/%') AS unnamed, avg(CAST(said AS INT)) AS commented, bool_or(path = 'src/index.ts' AND NOT content LIKE '/**%') AS bare FROM src GROUP BY 1),
c AS (SELECT f.repo, n_files, list_value(CASE WHEN trim(rules) <> '' THEN 5 ELSE 0 END,
 CASE WHEN length(rules) <= 16000 THEN 4 ELSE 0 END,
 CASE WHEN agents OR rich THEN 3 ELSE 0 END,
 CASE WHEN regexp_matches(rules, '(^|\\s)/[a-z][a-z0-9_-]+') OR regexp_matches(rules, '(?i)\\b(skill|skills|sub-?agent|sub-?agents|routing)\\b') THEN 4 ELSE 0 END,
 CASE WHEN trim(rival) <> '' AND trim(rules) <> '' AND NOT contains(na, nb) AND NOT contains(nb, na) AND NOT (length(na) < 50 AND length(nb) < 50) THEN 0 ELSE 4 END) AS a,
 list_value(CASE WHEN depth <= 6 THEN 5 ELSE 0 END, 4, CASE WHEN long THEN 0 ELSE 4 END, 3, CASE WHEN EXISTS (FROM tops t WHERE t.repo = f.repo AND t.n = 1 AND top <> 'docs') THEN 0 ELSE 4 END) AS b,
 list_value(CASE WHEN bad THEN 0 ELSE 5 END, CASE WHEN EXISTS (FROM kinds k WHERE k.repo = f.repo AND alls >= 3 AND most / alls < 0.6) THEN 0 ELSE 5 END, CASE WHEN generic THEN 0 ELSE 5 END, CASE WHEN unnamed THEN 0 ELSE 5 END) AS c,
 list_value(CASE WHEN big THEN 5 ELSE 0 END, CASE WHEN start THEN 4 ELSE 0 END, CASE WHEN commented >= 0.6 THEN 4 ELSE 0 END, CASE WHEN bare THEN 0 ELSE 4 END, CASE WHEN len(list_filter(paths, lambda p: p LIKE 'docs/%.md')) > 0 THEN 3 ELSE 0 END) AS d,
 list_value(CASE WHEN f.repo = 'r0' THEN 0 ELSE 5 END, CASE WHEN list_has_all(paths, ['yarn.lock', 'bun.lock']) THEN 0 ELSE 4 END,
 CASE WHEN list_contains(paths, 'package.json') AND f.repo IN ('r0', 'r2', 'r4') OR list_contains(paths, 'pyproject.toml') OR go_mod <> '' THEN 4 ELSE 0 END, CASE WHEN list_contains(paths, '.gitignore') THEN 3 ELSE 0 END,
 CASE WHEN list_contains(paths, 'package.json') THEN CASE WHEN list_has_any(paths, ['yarn.lock', 'bun.lock']) THEN 4 ELSE 0 END WHEN list_contains(paths, 'pyproject.toml') OR go_mod <> '' THEN 0 ELSE 4 END) AS e
 FROM (SELECT *, trim(regexp_replace(lower(rules), '\\s+', ' ', 'g')) AS na, trim(regexp_replace(lower(rival), '\\s+', ' ', 'g')) AS nb FROM f) f LEFT JOIN readme USING (repo) LEFT JOIN s ON s.repo = f.repo)"""
PARTS = "SELECT repo, n_files, CAST(list_sum(a) AS INT) AS score_a, CAST(list_sum(b) AS INT) AS score_b, CAST(list_sum(c) AS INT) AS score_c, CAST(list_sum(d) AS INT) AS score_d, CAST(list_sum(e) AS INT) AS score_e FROM c"
SCORES = TWIN + FACTS + f" SELECT *, CASE WHEN score >= 90 THEN 'platinum' WHEN score >= 75 THEN 'gold' WHEN score >= 60 THEN 'silver' WHEN score >= 40 THEN 'bronze' ELSE 'needs-work' END AS tier FROM (SELECT *, score_a + score_b + score_c + score_d + score_e AS score FROM ({PARTS}))"
BUILT = TWIN + f"""n AS (SELECT repo, count(*) FILTER (base LIKE '%-%') AS kebab, count(*) FILTER (contains(base, '_')) AS snake, count(*) FILTER (base LIKE 'Model%') AS pascal, count(*) FILTER (NOT base LIKE '%-%' AND NOT contains(base, '_') AND NOT base LIKE 'Model%' AND NOT regexp_matches(base, '^[0-9]')) AS camel FROM (SELECT repo, {BASE} AS base FROM files WHERE listed AND {SOURCE}) GROUP BY 1),
p AS (SELECT repo, list(path) AS paths, max(CASE WHEN path = 'package.json' THEN CAST(content AS JSON) END) AS j FROM files GROUP BY 1)
SELECT repo, CASE WHEN json_extract(j, '$.dependencies.next') IS NOT NULL THEN 'next-pages' WHEN json_extract(j, '$.dependencies.vite') IS NOT NULL THEN 'vite' WHEN json_extract(j, '$.dependencies.express') IS NOT NULL THEN 'express' ELSE 'unknown' END AS framework,
 CASE WHEN json_extract(j, '$.dependencies.vitest') IS NOT NULL THEN 'vitest' WHEN len(list_filter(paths, lambda x: x LIKE '%test\\_%.py' ESCAPE '\\')) > 0 THEN 'pytest' ELSE 'none' END AS test_framework,
 CASE WHEN list_contains(paths, 'bun.lock') THEN 'bun' WHEN list_contains(paths, 'yarn.lock') THEN 'yarn' ELSE 'unknown' END AS package_manager,
 CASE WHEN kebab >= 0.6 * (kebab + snake + pascal + camel) THEN 'kebab-case' WHEN snake >= 0.6 * (kebab + snake + pascal + camel) THEN 'snake_case' WHEN pascal >= 0.6 * (kebab + snake + pascal + camel) THEN 'PascalCase' WHEN camel >= 0.6 * (kebab + snake + pascal + camel) THEN 'camelCase' ELSE 'mixed' END AS naming FROM p JOIN n USING (repo)"""

