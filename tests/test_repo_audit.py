"""Repository scan, imports, purpose lines and the score, on folders and texts written here."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith

from ledgerspark.functions import code
from ledgerspark.operators import files as repo_tables
from ledgerspark.operators import repo_audit
from ledgerspark.sources import repo_files

TREE = {
    "good/README.md": "# Good\n" + "word " * 90 + "\n## Usage\nrun it\n",
    "good/CLAUDE.md": "Use /review before a commit.\n",
    "good/AGENTS.md": "who does what\n",
    "good/.gitignore": "dist\n",
    "good/.env": "hidden\n",
    "good/.scanignore": "# left out\nsrc/skipped/\n",
    "good/package.json": json.dumps({"name": "good", "scripts": {"build": "tsc"}, "bin": "x.js", "devDependencies": {"typescript": "5", "vitest": "1"}}),
    "good/package-lock.json": "{}",
    "good/docs/ARCHITECTURE.md": "text",
    "good/src/index.ts": '/** Entry of the tool. */\nimport { a } from "./parse-line";\nimport b from "./store/index.js";\n// import c from "./gone"\n',
    "good/src/parse-line.ts": "// Parses lines\nexport const a = 1;\n",
    "good/src/store/index.ts": '/** Store. */\nimport * as p from "../parse-line.js";\nimport "side";\n',
    "good/src/skipped/x1.ts": "bad",
    "good/src/big-file.ts": "x" * (256 * 1024 + 1),
    "good/node_modules/m/index.js": "no",
    "good/venv/pyvenv.cfg": "home",
    "good/venv/app.py": "no",
    "good/test/parse-line.test.ts": "// t\n",
    "poor/CLAUDE.md": "first " * 20,
    "poor/.cursorrules": "second " * 20,
    "poor/a/b/c/d/e/f/g/temp.py": "x = 1\n",
    "poor/a/utils.py": "x\n" * 300,
    "poor/lone/kebab-name.py": "import os\n",
    "poor/yarn.lock": "",
    "poor/bun.lock": "",
    "poor/package.json": json.dumps({"dependencies": {"jest": "1", "mocha": "2", "next": "3"}}),
    "poor/pyvenv.cfg": "the top is an environment",
    "poor/lib/site.py": "no",
    "poor/tests/thing.py": "# c\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("repos")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def scanned(spark, tree):
    return repo_files.scan(spark, tree).cache()


def test_what_a_scan_lists(scanned):
    got = {f"{r.repo}/{r.path}" for r in scanned.filter("listed").collect()}
    out = {"good/.env", "good/src/skipped/x1.ts", "good/src/big-file.ts", "good/node_modules/m/index.js", "good/venv/pyvenv.cfg", "good/venv/app.py", "poor/.cursorrules", "poor/lib/site.py"}
    assert got == set(TREE) - out
    other = scanned.filter("not listed").collect()
    assert [(r.repo, r.path, r.content[:6]) for r in other] == [("poor", ".cursorrules", "second")]


def test_filters_reach_the_walk(spark, tree):
    rows = repo_files.scan(spark, tree).filter("repo = 'good' and path like 'src/%' and language = 'typescript'")
    assert {r.path for r in rows.collect()} == {"src/index.ts", "src/parse-line.ts", "src/store/index.ts"}
    reader = repo_files.RepoReader({"path": tree})
    assert len(list(reader.pushFilters([EqualTo(("repo",), "good"), StringStartsWith(("path",), "src/store/")]))) == 2
    assert [(p.repo, p.folder) for p in reader.partitions()] == [("good", ""), ("good", "src")]
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["src/store/index.ts"]


def test_one_repository_skips_and_manifest(spark, tree):
    rows = repo_files.scan(spark, f"{tree}/good", single="true", skip="docs,test", content="false", manifest="docs/none.md")
    got = rows.collect()
    assert {r.repo for r in got} == {"good"} and not [r for r in got if r.content is not None]
    assert not [r for r in got if r.path.startswith(("docs/", "test/"))]


def test_no_folder_gives_no_rows(spark, tmp_path):
    assert repo_files.scan(spark, str(tmp_path / "none")).count() == 0


SCRIPT = """/* import x from "no" */
import d from "./d"; import d2, { n2 } from './n'
import * as s from "../s"
import type { T } from "./t";
import "./effect";
import {} from "./empty";
const u = "http://h/x"; // import z from "./z"
await import("./dyn");
"""
PYTHON = "from . import a\nfrom .b.c import (d)\nfrom x import *\n# import no\nimport os, re\nimport numpy as np\n  from ..up import q\n"
GO = 'import "fmt"\nimport (\n  x "a/b"\n  "c"\n)\n'


@pytest.mark.parametrize(
    ("language", "path", "text", "want"),
    [
        ("typescript", "src/m/a.ts", SCRIPT, [("./d", "default", "src/m/d"), ("./n", "named", "src/m/n"), ("../s", "star", "src/s"), ("./t", "named", "src/m/t"), ("./effect", "side-effect", "src/m/effect"), ("./empty", "side-effect", "src/m/empty"), ("./dyn", "default", "src/m/dyn")]),
        ("python", "p/q/a.py", PYTHON, [(".", "named", "p.py"), (".b.c", "named", "p/q/b/c.py"), ("x", "star", None), ("os", "default", None), ("re", "default", None), ("numpy", "default", None), ("..up", "named", "p/up.py")]),
        ("go", "a.go", GO, [("fmt", "default", None), ("a/b", "default", None), ("c", "default", None)]),
        ("other", "a.md", SCRIPT, []),
        ("typescript", "a.ts", None, []),
        ("typescript", "a.ts", "", []),
        ("typescript", "a.ts", 'import a from "../../x/"; import b from "."', [("../../x/", "default", "../../x/"), (".", "default", ".")]),
    ],
)
def test_imports(spark, language, path, text, want):
    rows = spark.createDataFrame([("r", path, language, True, text)], "repo string, path string, language string, listed boolean, content string")
    assert [(r.specifier, r.style, r.target) for r in repo_audit.imports(rows).orderBy("place").collect()] == want


@pytest.mark.parametrize(
    ("language", "path", "text", "want"),
    [
        ("typescript", "a.ts", "/**\n * @file\n *  Reads   the logs.\n */", "Reads the logs."),
        ("typescript", "a.ts", "\n//  one\n", "one"),
        ("typescript", "a.ts", "/* block */\nx", "block"),
        ("typescript", "src/parseLine-two.ts", "const x", "parse line two"),
        ("typescript", "x/test/a_b.ts", "", "tests for a b"),
        ("python", "a.py", '#!/bin/sh\n"""\n\n  Doc of it. \n"""', "Doc of it."),
        ("python", "a.py", "## note\nx = 1", "note"),
        ("python", "a.py", "#!/bin/sh\n# later", "a"),
        ("go", "m.go", None, "m"),
        ("go", "m.go", "// " + " ".join("abcdefghijklmn"), "a b c d e f g h i j k l…"),
    ],
)
def test_purpose(spark, language, path, text, want):
    rows = spark.createDataFrame([(path, language, text)], "path string, language string, content string")
    assert rows.select(code.purpose(F.col("path"), F.col("content"), F.col("language"))).first()[0] == want


def test_edges_are_files(scanned):
    got = repo_audit.edges(repo_audit.imports(scanned), scanned)
    want = {("src/index.ts", "src/parse-line.ts"), ("src/index.ts", "src/store/index.ts"), ("src/store/index.ts", "src/parse-line.ts")}
    assert {(r.importer, r.imported) for r in got.collect()} == want
    top = repo_tables.dearest_imports(got.select("importer", "imported")).filter("importer = 'src/index.ts'").orderBy("place").collect()
    assert [(r.imported, r.used_by) for r in top] == [("src/parse-line.ts", 2), ("src/store/index.ts", 1)]


def test_built_with(scanned):
    got = {r.repo: r for r in repo_audit.built_with(scanned).collect()}
    g, p = got["good"], got["poor"]
    assert (g.framework, g.build_tool, g.languages, g.test_framework, g.package_manager, g.monorepo, g.naming) == ("cli", "tsc", ["typescript"], "vitest", "npm", "single", "camelCase")
    assert (p.framework, p.build_tool, p.languages, p.test_framework, p.package_manager) == ("next-pages", "unknown", ["python"], "jest", "bun")
    styles = {r.repo: r.import_style for r in repo_audit.import_styles(repo_audit.imports(scanned)).collect()}
    assert styles == {"good": "mixed", "poor": "default"}


def test_score(scanned):
    judged = repo_audit.verdicts(scanned).cache()
    failed = {r.repo: set() for r in judged.collect()}
    for r in repo_audit.checks(judged).filter("not passed").collect():
        failed[r.repo].add(r.check)
    # the good one: its only top folder of one file that isn't expected is test/
    assert failed["good"] == {"SC014"}
    assert failed["poor"] == {"SC003", "SC004", "SC005", "SC010", "SC014", "SC020", "SC022", "SC023", "SC030", "SC031", "SC032", "SC034", "SC040", "SC041", "SC042", "SC043"}
    got = {r.repo: r for r in repo_audit.score(judged).collect()}
    assert (got["good"].score, got["good"].tier, got["good"].to_mend) == (96, "platinum", ["SC014 (-4pts)"])
    assert got["poor"].tier == "needs-work" and got["poor"].to_mend[:2] == ["SC010 (-5pts)", "SC020 (-5pts)"]
    assert sum(repo_audit.CHECKS.values()) == 100
    assert all(r.score == r.score_a + r.score_b + r.score_c + r.score_d + r.score_e for r in got.values())


@pytest.mark.parametrize(("name", "bad"), [("a", True), ("", True), ("Temp", True), ("fooCopy", True), ("foo2", True), ("page12", True), ("abc123", True), ("abcd123", False), ("fine", False), ("é", True)])
def test_bad_names(spark, name, bad):
    assert spark.createDataFrame([(name,)], "n string").select(F.col("n").rlike(repo_audit.BAD_NAME)).first()[0] is bad


def test_empty_and_nulls(spark):
    none = spark.createDataFrame([], repo_files.SCHEMA)
    assert repo_audit.score(repo_audit.verdicts(none)).count() == 0
    rows = spark.createDataFrame([("r", "src/a.ts", "ts", 1, "typescript", True, None), ("r", "package.json", "json", 1, "other", True, "{not json")], repo_files.SCHEMA)
    got = repo_audit.score(repo_audit.verdicts(rows)).collect()
    assert len(got) == 1 and got[0].n_files == 2
