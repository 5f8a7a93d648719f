"""Audits of repositories: import graphs, what a repository is built with, and its score by 24 checks.

All take files (repo, path, ext, size, language, listed, content), as ``sources.repo_files`` gives them, for any number of
repositories at once. The score is one scan: files are summed by folder, folders by top folder, those by repository, so that
a repository with a third of all files is summed in parts, and no text but that of a few named files is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code
from ..functions.core import approx_tokens

#: Kinds of source, limits, names that count, and what each check is worth.
CHECKED = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "py", "go")
COUNTED = (*CHECKED, "cjs")
MOST_DEPTH, MOST_LINES, MOST_GENERIC_LINES, MOST_TOKENS, MAJORITY = 6, 1000, 200, 4000, 0.6
USUAL_FOLDERS = ("src", "lib", "packages", "apps", "app", "pages", "cmd", "internal", "pkg", "components", "modules")
SINGLE_FOLDERS = ("public", "static", "assets", "docs", "scripts", "bin", "config", ".github", ".vscode", ".husky", ".changeset")
GENERIC = ("utils", "util", "helpers", "helper", "common", "misc", "stuff", "shared")
BAD_NAME = r"(?s)^.?$|^(?i:temp|tmp|untitled|new|copy|asdf|foo|bar|baz)(?i:\d+|copy)?$|^(?i:file|page|component|module)\d+$|^(?=.{1,6}$)[a-z]+\d+$"
LOCKS = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "bun.lock")
TEST_FOLDER = r"(^|/)(tests?|__tests__)/"
TEST_FILE = r"\.(test|spec)\.[jt]sx?$|_test\.go$|(^|/)test_[^/]+\.py$"
TEST_NAMED = r"\.(test|spec)\.[jt]sx?$|_test\.go$|^test_|_test\.py$|^conftest\.py$|^(setup|fixture|helpers)"
FRONT = ("index.ts", "index.js", "index.tsx", "index.jsx", "cli.ts", "cli.js", "main.go", "doc.go")
READMES = ("README.md", "README", "README.markdown")
CHECKS = {
    "SC001": 5, "SC002": 4, "SC003": 3, "SC004": 4, "SC005": 4, "SC010": 5, "SC011": 4, "SC012": 4, "SC013": 3, "SC014": 4, "SC020": 5, "SC021": 5,
    "SC022": 5, "SC023": 5, "SC030": 5, "SC031": 4, "SC032": 4, "SC033": 4, "SC034": 3, "SC040": 5, "SC041": 4, "SC042": 4, "SC043": 3, "SC044": 4,
}
CATEGORIES = {"0": "A", "1": "B", "2": "C", "3": "D", "4": "E"}
TIERS = ((90, "platinum"), (75, "gold"), (60, "silver"), (40, "bronze"), (0, "needs-work"))
#: What the packages a repository depends on say of it, the first that fits.
FRAMEWORKS = (("astro", ("astro",)), ("remix", ("@remix-run/react", "@remix-run/node")), ("sveltekit", ("@sveltejs/kit",)), ("vite", ("vite",)), ("express", ("express",)), ("fastify", ("fastify",)))
BUILD_TOOLS = (("vite", ("vite",)), ("webpack", ("webpack",)), ("turbopack", ("turbopack",)), ("rollup", ("rollup",)), ("esbuild", ("esbuild",)), ("tsc", ("typescript",)))
TEST_TOOLS = (("vitest", ("vitest",)), ("jest", ("jest", "@jest/core")), ("mocha", ("mocha",)), ("pytest", ("pytest",)))
RIVALS = (*TEST_TOOLS[:3], ("ava", ("ava",)), ("jasmine", ("jasmine",)))
NEXT_PAGES = ("app/layout.tsx", "src/app/layout.tsx", "app/page.tsx", "src/app/page.tsx")
MANAGERS, LOCK_OF = ("pnpm", "yarn", "bun", "npm"), (("pnpm", LOCKS[1:2]), ("bun", LOCKS[3:]), ("yarn", LOCKS[2:3]), ("npm", LOCKS[:1]))
STYLES, KINDS = ("default", "named", "star"), {"camel": "camelCase", "kebab": "kebab-case", "snake": "snake_case", "pascal": "PascalCase"}
SAMPLED = ("ts", "tsx", "js", "jsx", "mjs", "py", "go")

# -- imports --------------------------------------------------------------------------------------------------


def imports(files: DataFrame) -> DataFrame:
    """repo, path, place, specifier, style, target: each import of each file, in the order in which they are found."""
    each = files.filter("listed and language <> 'other'").select("repo", "path", "language", F.posexplode(code.imports(F.col("content"), F.col("language"))).alias("place", "i"))
    return each.select("repo", "path", "place", "i.specifier", "i.style", code.target(F.col("path"), F.col("i.specifier"), F.col("language")).alias("target"))


#: What may follow a target, the likeliest first: nothing, an extension, a folder's index. ``x.js`` may stand for ``x.ts``.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
SWAPPED = {r"\.js$": (".ts", ".tsx"), r"\.jsx$": (".tsx",), r"\.mjs$": (".mts",), r"\.cjs$": (".cts",), r"\.py$": ("/__init__.py",)}


def edges(imported: DataFrame, files: DataFrame) -> DataFrame:
    """importer, imported within each repo: imports() whose target is a file, by the likeliest of the paths it may stand for.

    Candidates meet the file list in one equi-join on (repo, path); each distinct target is resolved once, however many
    files import it, so a file that all others import is no hot key.
    """
    t = F.col("target")
    plain = F.regexp_replace(t, "/$", "")
    swapped = [F.when(t.rlike(p), F.regexp_replace(t, p, e)) for p, ends in SWAPPED.items() for e in ends]
    paths = F.filter(F.array(*[F.concat(plain, F.lit(e)) for e in ENDINGS], *swapped), lambda x: x.isNotNull())
    wanted = imported.filter("target is not null").select("repo", "target").distinct()
    candidates = wanted.select("repo", "target", F.posexplode(paths).alias("place", "path"))
    met = candidates.join(files.filter("listed").select("repo", "path").distinct(), ["repo", "path"])
    best = met.groupBy("repo", "target").agg(F.min_by("path", "place").alias("imported"))
    return imported.select("repo", "path", "target").distinct().join(best, ["repo", "target"]).select("repo", F.col("path").alias("importer"), "imported").distinct()


# -- what a repository is built with ----------------------------------------------------------------------------


def is_file(*paths: str) -> Column:
    return F.col("listed") & F.col("path").isin(*paths)


def package() -> Column:
    """package.json as a map of its fields; null where it isn't a JSON object."""
    return F.when(F.col("path") == "package.json", F.try_variant_get(F.try_parse_json("content"), "$", "map<string,variant>"))


def fields(name: str) -> Column:
    """Keys of an object in the package's field; none if it is something else."""
    keys = F.map_keys(F.try_variant_get(F.try_element_at("package", F.lit(name)), "$", "map<string,variant>"))
    return F.coalesce(keys, F.array().cast("array<string>"))


def text(name: str) -> Column:
    return F.try_variant_get(F.try_element_at("package", F.lit(name)), "$", "string")


def truthy(name: str) -> Column:
    value = F.to_json(F.try_element_at("package", F.lit(name)))
    return F.coalesce(~value.isin("null", "false", "0", '""'), F.lit(False))


def packages(files: DataFrame) -> DataFrame:
    """repo, name, deps, and what else is asked of a package.json at the top; a row for each repository that has one."""
    rows = files.filter(F.col("path") == "package.json").select("repo", package().alias("package")).filter("package is not null")
    deps = F.array_distinct(F.concat(fields("dependencies"), fields("devDependencies"), fields("peerDependencies")))
    return rows.select(
        "repo", F.nullif(text("name"), F.lit("")).alias("name"), deps.alias("deps"), (F.size(fields("scripts")) > 0).alias("scripts"), truthy("bin").alias("bin"),
        F.map_contains_key("package", "main").alias("main"), truthy("workspaces").alias("workspaces"), text("packageManager").alias("manager"),
    )


def first_of(ladder, deps: Column) -> Column:
    out = F
    for name, any_of in ladder:
        out = out.when(F.arrays_overlap(deps, F.array(*map(F.lit, any_of))), F.lit(name))
    return out


def majority(counts: dict[str, Column]) -> Column:
    """The name whose count is 60 % of all or more; mixed if there is none, unknown without any. Ties are below that."""
    total = reduce(Column.__add__, counts.values())
    out = F.when(total == 0, "unknown")
    for name, n in counts.items():
        out = out.when(n / F.nullif(total, F.lit(0)) >= MAJORITY, F.lit(name))
    return out.otherwise("mixed")


def some(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def built_with(files: DataFrame) -> DataFrame:
    """repo, framework, build_tool, languages, test_framework, package_manager, monorepo, naming: one row a repository."""
    here = files.filter("listed")
    kind = code.kind_of_name(code.base_name(F.col("path")))
    path = F.col("path")
    seen = here.groupBy("repo").agg(
        *[F.count_if((F.col("ext").isin(*SAMPLED)) & (kind == k)).alias(k) for k in KINDS],
        some(path.isin(*NEXT_PAGES)).alias("app"), some(path == "tsconfig.json").alias("tsconfig"), some(path == "turbo.json").alias("turbo"), some(path == "pnpm-workspace.yaml").alias("pnpm_workspace"),
        *[some(path.isin(*locks)).alias(f"lock_{m}") for m, locks in LOCK_OF], *[some(F.col("language") == x).alias(x) for x in ("typescript", "javascript", "python", "go")],
        F.min_by(F.when(path.rlike(r"_test\.go$"), "go-test").when(path.rlike(r"test_.*\.py$|_test\.py$"), "pytest"), F.when(path.rlike(r"_test\.go$|test_.*\.py$|_test\.py$"), path)).alias("tested"),
    )
    x = seen.join(packages(files), "repo", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
    deps = F.col("deps")
    yes = lambda c: F.coalesce(c, F.lit(False))
    framework = F.when(F.array_contains(deps, "next"), F.when(F.col("app"), "next-app").otherwise("next-pages"))
    framework = F.coalesce(framework, first_of(FRAMEWORKS, deps), F.when(yes(F.col("bin")), "cli").when(yes(F.col("main")), "library"), F.lit("unknown"))
    build = F.coalesce(first_of(BUILD_TOOLS, deps), F.when(F.col("tsconfig"), "tsc"), F.lit("unknown"))
    declared = reduce(lambda out, m: out.when(F.col("manager").startswith(m), F.lit(m)), MANAGERS, F)
    locked = reduce(lambda out, m: out.when(F.col(f"lock_{m}"), F.lit(m)), [m for m, _ in LOCK_OF], F)
    return x.select(
        "repo", framework.alias("framework"), build.alias("build_tool"),
        F.array_compact(F.array(*[F.when(F.col(n), n) for n in ("typescript", "javascript", "python", "go")])).alias("languages"),
        F.coalesce(first_of(TEST_TOOLS, deps), "tested", F.lit("none")).alias("test_framework"), F.coalesce(declared, locked, F.lit("unknown")).alias("package_manager"),
        F.when(F.col("turbo"), "turbo").when(F.col("pnpm_workspace"), "pnpm-workspace").when(yes(F.col("workspaces")), "workspaces").otherwise("single").alias("monorepo"),
        majority({name: F.col(k) for k, name in KINDS.items()}).alias("naming"),
    )


def import_styles(imported: DataFrame) -> DataFrame:
    """repo, import_style: how most imports of a repository are written; those for their effect alone don't vote."""
    n = imported.groupBy("repo").agg(*[F.count_if(F.col("style") == s).alias(s) for s in STYLES])
    return n.select("repo", majority({s: F.col(s) for s in STYLES}).alias("import_style"))


# -- score ----------------------------------------------------------------------------------------------------


def filled(c: Column) -> Column:
    return F.coalesce(code.trimmed(c) != "", F.lit(False))


HEADING = r"(?:\A|\n)#{1,6}[^\S\r\n][^\n]*"


def opening_words(text: Column) -> Column:
    """Words between the first heading and the next."""
    first = F.coalesce(F.get(F.split(text, HEADING, 3), F.lit(1)), F.lit(""))
    words = code.trimmed(F.regexp_replace(first, r"[`*_>#]", " "))
    return F.when(words == "", 0).otherwise(F.size(F.split(words, rf"{code.BLANK}+")))


def flat(text: Column) -> Column:
    return code.trimmed(F.regexp_replace(F.lower(text), rf"{code.BLANK}+", " "))


def rivalry(files: DataFrame) -> DataFrame:
    """repo, rival: where both files of routing rules are filled, whether they differ. At most one row a repository and file."""
    side = lambda path, name: files.filter((F.col("path") == path) & filled(F.col("content"))).select("repo", flat(F.col("content")).alias(name))
    both = side("CLAUDE.md", "a").join(side(".cursorrules", "b"), "repo")
    same = F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")) | (F.length("a") < 50) & (F.length("b") < 50)
    return both.groupBy("repo").agg(some(~same).alias("rival"))


def facts_of_files(files: DataFrame, manifest: str | None = None) -> DataFrame:
    """What the checks ask of a file, each worked out once; of texts only few facts go further."""
    path, ext, body = F.col("path"), F.col("ext"), F.col("content")
    name, base = F.substring_index(path, "/", -1), code.base_name(path)
    n_lines = F.when(F.col("listed") & ext.isin(*COUNTED) & (body != ""), F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    rules, project, has_text = path == "CLAUDE.md", path == "pyproject.toml", body != ""
    about = F.struct(
        F.length(code.trimmed(body)).alias("length"), (opening_words(body) >= 80).alias("rich"),
        body.rlike(r"(?im)^#{1,6}\s*(quick\s*start|usage|getting\s*started|install(ation)?)\b").alias("start"),
    )
    return files.select(
        "repo", "path", "listed", F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("").alias("folder"), name.alias("name"), base.alias("base"),
        F.lower(base).alias("plain"), code.kind_of_name(base).alias("kind"), (F.col("listed") & (F.col("language") != "other")).alias("source"), (F.col("listed") & ext.isin(*CHECKED)).alias("checked"),
        n_lines.alias("n_lines"), F.when(F.col("listed") & ext.isin(*CHECKED), code.top_comment(body, ext == "py")).alias("comment"), body.isNotNull().alias("read"), path.rlike(TEST_FOLDER).alias("in_tests"),
        (path.startswith("docs/") & (ext == "md")).alias("doc"), F.when(rules, filled(body)).alias("rules"), F.when(rules, has_text & (approx_tokens(body) <= MOST_TOKENS)).alias("rules_short"),
        F.when(rules, body.rlike(r"(?m)(^|\s)/[a-z][a-z0-9_-]+") | body.rlike(r"(?i)\b(skill|skills|sub-?agent|sub-?agents|routing)\b")).alias("rules_route"),
        filled(F.when(path.isin("AGENTS.md", *([manifest] if manifest else [])), body)).alias("manifest"), F.when(path.isin(*READMES), about).alias("about"),
        F.when(project, has_text).alias("pyproject"), F.when(project, body.rlike(r"\[(project|tool\.poetry)\.(scripts|entry-points)|\[tool\.")).alias("pyproject_tool"), F.when(path == "go.mod", has_text).alias("go_mod"),
    )


def by_folder(facts: DataFrame) -> DataFrame:
    """facts_of_files() by folder: counts, and whether any file has a fact."""
    path, name, listed, checked, in_tests, comment = map(F.col, ("path", "name", "listed", "checked", "in_tests", "comment"))
    front = checked & (F.lower(name).isin(*FRONT) | (F.lower(name) == "__init__.py") & (F.size(F.split(path, "/")) <= 3))
    place = F.when(path == READMES[0], 0).when(path == READMES[1], 1).otherwise(2)
    return facts.groupBy("repo", "folder").agg(
        F.max(F.when(listed, F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))).alias("depth"),
        F.count_if(listed).alias("n_files"), F.count_if("source").alias("n_source"), F.count_if(F.col("n_lines") > MOST_LINES).alias("n_long"),
        F.count_if(listed & in_tests).alias("n_central"), F.count_if(listed & path.rlike(TEST_FILE) & ~in_tests).alias("n_beside"),
        F.count_if(checked & F.col("base").rlike(BAD_NAME)).alias("n_bad"), *[F.count_if(checked & (F.col("kind") == k)).alias(k) for k in KINDS],
        F.count_if(F.col("plain").isin(*GENERIC) & (F.col("n_lines") > MOST_GENERIC_LINES)).alias("n_generic"),
        F.count_if(checked & in_tests & ~path.rlike(r"(^|/)fixtures?/") & ~name.rlike(TEST_NAMED)).alias("n_unnamed"),
        F.count_if(checked & F.col("read")).alias("n_read"), F.count_if(comment.isNotNull()).alias("n_commented"),
        F.count_if(front & ~F.coalesce(comment.rlike(r"^(/\*\*|\"\"\"|''')"), F.lit(False))).alias("n_bare"),
        some(is_file("ARCHITECTURE.md", "docs/ARCHITECTURE.md") | listed & F.col("doc")).alias("architecture"),
        *[some(is_file(x)).alias(x) for x in LOCKS], some(is_file(".gitignore")).alias("gitignore"), some(is_file("poetry.lock", "uv.lock", "requirements.txt")).alias("python_lock"), some(is_file("go.sum")).alias("go_sum"),
        *[some(F.col(c)).alias(c) for c in ("rules", "rules_short", "rules_route", "manifest", "pyproject", "pyproject_tool", "go_mod")],
        F.min_by("about", F.when(F.col("about").isNotNull() & F.col("read"), place)).alias("readme"),
    )


FACTS = ("architecture", *LOCKS, "gitignore", "python_lock", "go_sum", "rules", "rules_short", "rules_route", "manifest", "pyproject", "pyproject_tool", "go_mod")
SUMS = ("n_files", "n_source", "n_long", "n_central", "n_beside", "n_bad", "n_generic", "n_unnamed", "n_read", "n_commented", "n_bare", "n_mixed")


def by_repo(folders: DataFrame) -> DataFrame:
    """Facts of folders, to top folders, to repositories."""
    named = reduce(Column.__add__, map(F.col, KINDS))
    mixed = (named >= 3) & (F.greatest(*KINDS) / named < MAJORITY)
    facts = [F.max("depth").alias("depth"), *[F.bool_or(f"`{f}`").alias(f) for f in FACTS], F.max("readme").alias("readme")]
    top = folders.withColumn("n_mixed", F.when(named >= 3, mixed.cast("int")).otherwise(0)).groupBy("repo", F.substring_index("folder", "/", 1).alias("top")).agg(*[F.sum(s).alias(s) for s in SUMS], *facts)
    inside = F.col("top") != ""
    usual = (F.col("n_source") > 0) & (~inside | F.col("top").isin(*USUAL_FOLDERS))
    lonely = inside & (F.col("n_files") == 1) & ~F.col("top").isin(*SINGLE_FOLDERS)
    return top.groupBy("repo").agg(*[F.sum(s).alias(s) for s in SUMS], *facts, F.bool_or(usual).alias("usual"), F.count_if(lonely).alias("n_lonely"))


def verdicts(files: DataFrame, manifest: str | None = None) -> DataFrame:
    """repo, n_files and a boolean for each check."""
    facts = by_repo(by_folder(facts_of_files(files, manifest))).join(rivalry(files), "repo", "left").join(packages(files), "repo", "left").join(built_with(files).select("repo", "framework", "test_framework"), "repo", "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    has_package, locks = F.col("deps").isNotNull(), reduce(Column.__add__, [f(f"`{x}`").cast("int") for x in LOCKS])
    deps = F.coalesce("deps", F.array().cast("array<string>"))
    rivals = reduce(Column.__add__, [F.arrays_overlap(deps, F.array(*map(F.lit, names))).cast("int") for _, names in RIVALS])
    tests = F.col("n_central") + F.col("n_beside")
    locked = F.when(has_package, locks > 0).when(f("pyproject"), f("python_lock")).when(f("go_mod"), f("go_sum")).otherwise(True)
    passed = {
        "SC001": f("rules"), "SC002": f("rules_short"), "SC003": f("manifest") | f("readme.rich"), "SC004": f("rules_route"), "SC005": ~f("rival"),
        "SC010": n("depth") <= MOST_DEPTH, "SC011": (F.col("n_source") == 0) | f("usual") | F.coalesce(F.col("framework").isin("next-app", "next-pages", "astro", "remix", "sveltekit"), F.lit(False)),
        "SC012": F.col("n_long") == 0, "SC013": F.greatest("n_central", "n_beside") >= 0.75 * tests, "SC014": F.col("n_lonely") == 0,
        "SC020": F.col("n_bad") == 0, "SC021": F.col("n_mixed") == 0, "SC022": F.col("n_generic") == 0, "SC023": F.col("n_unnamed") == 0,
        "SC030": n("readme.length") > 200, "SC031": f("readme.start"), "SC032": (F.col("n_read") == 0) | (F.col("n_commented") / F.nullif(F.col("n_read"), F.lit(0)) >= MAJORITY), "SC033": F.col("n_bare") == 0, "SC034": f("architecture"),
        "SC040": (rivals < 2) | F.coalesce(F.col("test_framework") == "none", F.lit(False)), "SC041": locks <= 1, "SC042": f("scripts") | f("pyproject_tool") | f("go_mod"), "SC043": f("gitignore"), "SC044": locked,
    }
    return facts.select("repo", "n_files", *[p.alias(c) for c, p in passed.items()])


def checks(judged: DataFrame) -> DataFrame:
    """verdicts() as rows: repo, check, category, passed, points, most."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.lit(CATEGORIES[c[3]]).alias("category"), F.col(c).alias("passed"), F.lit(p).alias("most")) for c, p in CHECKS.items()]))
    return judged.select("repo", each.alias("c")).select("repo", "c.check", "c.category", "c.passed", F.when(F.col("c.passed"), F.col("c.most")).otherwise(0).alias("points"), "c.most")


def score(judged: DataFrame) -> DataFrame:
    """repo, n_files, score, tier, a column of points for each category, and what to mend first: the failed checks by points lost, then by id."""
    points = {c: F.when(F.col(c), p).otherwise(0) for c, p in CHECKS.items()}
    total = reduce(Column.__add__, points.values())
    tier = reduce(lambda out, t: out.when(total >= t[0], F.lit(t[1])), TIERS, F)
    parts = [reduce(Column.__add__, [x for c, x in points.items() if c[3] == k]).alias(f"score_{name.lower()}") for k, name in CATEGORIES.items()]
    order = sorted(CHECKS, key=lambda c: (-CHECKS[c], c))
    mend = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(f"{c} (-{CHECKS[c]}pts)")) for c in order]))
    return judged.select("repo", "n_files", total.alias("score"), tier.alias("tier"), *parts, mend.alias("to_mend"))
