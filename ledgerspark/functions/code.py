"""Columns that read source files: imports, purpose lines, kinds of names. All of it is built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_WORDS = 12
#: White space as logs' and scripts' own runtime has it, and the patterns of imports, documentation and names.
BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SCRIPT_IMPORT = r"""import\s+(?:(?:type\s+)?(?:([\w$]+)\s*,\s*)?(?:\{([^}]*)\}|\*\s+as\s+([\w$]+)|([\w$]+))\s+from\s+)?["']([^"']+)["']"""
SCRIPT_CALL = r"""\bimport\(\s*["']([^"']+)["']\s*\)"""
PYTHON_FROM = r"^from\s+([.\w]+)\s+import\s+(.+)"
PYTHON_IMPORT = r"^import\s+([\w.,\s]+?)(?:\s+as\s+\w+)?$"
GO_SINGLE = r'import\s+(?:[\w.]+\s+)?"([^"]+)"'
GO_BLOCK = r"import\s*\(([\s\S]*?)\)"
GO_LINE = r'^\s*(?:[\w.]+\s+)?"([^"]+)"'
NAMES = {"kebab": r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)+$", "snake": r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$", "pascal": r"^[A-Z][a-zA-Z0-9]*$", "camel": r"^[a-z][a-zA-Z0-9]*$"}
SCRIPTS = ("typescript", "javascript")


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A{BLANK}+|{BLANK}+\z", "")


def base_name(path: Column) -> Column:
    """The file's name without folders and without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")


def kind_of_name(name: Column) -> Column:
    """kebab, snake, pascal, camel, or other."""
    out = F
    for kind, pattern in NAMES.items():
        out = out.when(name.rlike(pattern), kind)
    return out.otherwise("other")


def found(text: Column, pattern: str) -> Column:
    """All matches of a pattern, whole."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def one(specifier: Column, style: Column | str) -> Column:
    return F.struct(specifier.alias("specifier"), (F.lit(style) if isinstance(style, str) else style).alias("style"))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"/\*[\s\S]*?\*/", ""), r"(?m)(^|[^:])//.*$", "$1")


def script_imports(text: Column) -> Column:
    def style(m: Column) -> Column:
        part = lambda k: F.regexp_extract(m, SCRIPT_IMPORT, k) != ""
        return F.when(part(2), "named").when(part(3), "star").when(part(1) | part(4), "default").otherwise("side-effect")

    bare = without_comments(text)
    static = F.transform(found(bare, SCRIPT_IMPORT), lambda m: one(F.regexp_extract(m, SCRIPT_IMPORT, 5), style(m)))
    called = F.transform(found(bare, SCRIPT_CALL), lambda m: one(F.regexp_extract(m, SCRIPT_CALL, 1), "default"))
    return F.concat(static, called)


def python_imports(text: Column) -> Column:
    def of(line: Column) -> Column:
        source = one(F.regexp_extract(line, PYTHON_FROM, 1), F.when(trimmed(F.regexp_extract(line, PYTHON_FROM, 2)) == "*", "star").otherwise("named"))
        names = F.transform(F.split(F.regexp_extract(line, PYTHON_IMPORT, 1), ","), trimmed)
        plain = F.transform(F.filter(names, lambda n: n != ""), lambda n: one(n, "default"))
        return F.when(line.rlike(PYTHON_FROM), F.array(source)).otherwise(plain)

    return F.flatten(F.transform(F.filter(F.transform(lines(text), trimmed), lambda x: x.rlike(r"^(from|import)\s")), of))


def go_imports(text: Column) -> Column:
    single = F.transform(found(text, GO_SINGLE), lambda m: one(F.regexp_extract(m, GO_SINGLE, 1), "default"))
    body = F.flatten(F.transform(found(text, GO_BLOCK), lambda m: lines(F.regexp_extract(m, GO_BLOCK, 1))))
    block = F.transform(F.filter(body, lambda x: x.rlike(GO_LINE)), lambda x: one(F.regexp_extract(x, GO_LINE, 1), "default"))
    return F.concat(single, block)


def imports(text: Column, language: Column) -> Column:
    """Array of (specifier, style: named, star, default or side-effect); empty for other languages and null texts."""
    none = F.array().cast("array<struct<specifier:string,style:string>>")
    by = F.when(language.isin(*SCRIPTS), script_imports(text)).when(language == "python", python_imports(text)).when(language == "go", go_imports(text))
    return F.coalesce(by.cast("array<struct<specifier:string,style:string>>"), none)


def normal(path: Column) -> Column:
    """A relative path without ``.``, empty and resolvable ``..`` segments; ``.`` if nothing is left, and a slash at its end is kept."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    kept = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.concat(F.when(kept == "", ".").otherwise(kept), F.when(path.endswith("/"), "/").otherwise(""))


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def target(path: Column, specifier: Column, language: Column) -> Column:
    """The path that an import of a file names within its repository (scripts: mostly without extension); null for what lies outside."""
    at = folder_of(path)
    script = F.when(specifier.rlike(r"^[./]"), normal(F.concat(at, F.lit("/"), specifier)))
    dots = F.length(F.regexp_extract(specifier, r"^\.+", 0)) + F.when(specifier.rlike(r"^\.+$"), 1).otherwise(0)
    parts = F.split(at, "/")
    above = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    inside = F.translate(F.regexp_replace(specifier, r"^\.+", ""), ".", "/")
    module = F.when(specifier.startswith("."), F.concat(normal(F.regexp_replace(F.concat_ws("/", above, inside), "/$", "")), F.lit(".py")))
    return F.when(language.isin(*SCRIPTS), script).when(language == "python", module)


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed."""
    return trimmed(F.regexp_extract(text, rf"\A{BLANK}*([^\r\n]*)", 1))


def top_comment(text: Column, python: Column) -> Column:
    """The first line that is not blank if it opens a comment or docstring, else null."""
    line = first_line(text)
    opens = F.when(python, line.rlike(r"^(#(?!!)|\"\"\"|''')")).otherwise(line.rlike(r"^(//|/\*)"))
    return F.when(opens, line)


def clamped(s: Column, most: int = SOURCE_WORDS) -> Column:
    words = F.split(trimmed(F.regexp_replace(s, rf"{BLANK}+", " ")), " ")
    return F.concat(F.array_join(F.slice(words, 1, most), " "), F.when(F.size(words) > most, "…").otherwise(""))


def purpose(path: Column, text: Column, language: Column) -> Column:
    """What a file is for in a few words: from its first documentation, else its first comment, else its name."""
    python = language == "python"
    full = F.get(F.filter(F.transform(lines(F.regexp_extract(text, r"(?m)^[ \t]*(?:\"\"\"|''')([\s\S]*?)(?:\"\"\"|''')", 1)), trimmed), lambda x: x != ""), F.lit(0))
    starred = F.transform(lines(F.regexp_extract(text, r"/\*\*([\s\S]*?)\*/", 1)), lambda x: trimmed(F.regexp_replace(x, r"^\s*\*\s?", "")))
    doc = F.when(python, full).otherwise(F.get(F.filter(starred, lambda x: (x != "") & ~x.startswith("@")), F.lit(0)))
    line = first_line(text)
    script = F.when(line.startswith("//"), F.regexp_replace(line, r"^//+\s?", "")).when(line.startswith("/*"), F.regexp_replace(F.regexp_replace(line, r"^/\*+\s?", ""), r"\*/$", ""))
    comment = trimmed(F.when(python, F.when(line.rlike("^#(?!!)"), F.regexp_replace(line, r"^#+\s?", ""))).otherwise(script))
    words = F.filter(F.split(base_name(path), r"[-_.]"), lambda w: w != "")
    phrase = F.array_join(F.transform(words, lambda w: F.lower(F.regexp_replace(w, "([a-z])([A-Z])", "$1 $2"))), " ")
    tests = path.contains("/test") | path.endswith(".test.ts") | path.endswith(".test.js")
    name = F.when(tests, F.concat(F.lit("tests for "), phrase)).when(phrase == "", path).otherwise(phrase)
    return clamped(F.coalesce(F.nullif(doc, F.lit("")), F.nullif(comment, F.lit("")), name))
