"""Folders of repositories as a table of files: a data source whose partitions are folders.

    spark.dataSource.register(RepoFiles)
    spark.read.format("repo_files").load("/shared/checkouts")

``path`` holds one repository a folder (or is itself one, with option ``single``). The driver lists a repository's top
folder only; each folder in it is a partition, walked where it is read. Of filters, ``repo`` =, ``path`` = and startsWith,
and ``ext`` or ``language`` = or IN are taken into the walk: folders that no wanted path lies in are not entered, and files
of other kinds are not opened. ``content`` is read only where it is asked for (option ``content``) and the file is source
code or one of the files that tell what a repository is.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

#: Folders that are never entered, folders of a Python environment, hidden files that count, the largest file.
SKIPPED = frozenset(
    "node_modules .git .next .astro .turbo .svelte-kit .cache .output .vercel .idea .vscode dist build out coverage __pycache__ "
    ".pytest_cache .mypy_cache vendor target .nuxt .parcel-cache site-packages".split()
)
ENV_FOLDERS = frozenset("Lib lib lib64 include Include Scripts bin share".split())
HIDDEN = frozenset(".gitignore .eslintrc .prettierrc .env.example".split())
MOST_BYTES = 256 * 1024
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "go": "go"}
#: Files at the top whose text is read whatever their size, also where a scan leaves them out.
TELLING = ("CLAUDE.md", "README.md", "README", "README.markdown", "AGENTS.md", ".cursorrules", "package.json", "pyproject.toml", "go.mod")

SCHEMA = "repo string, path string, ext string, size long, language string, listed boolean, content string"


def extension(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name else ""


def is_environment(entries: list[os.DirEntry]) -> bool:
    """Whether a folder with these entries is a Python environment."""
    return any(e.name == "pyvenv.cfg" and e.is_file(follow_symlinks=False) or e.name == "conda-meta" and e.is_dir(follow_symlinks=False) for e in entries)


def entries_of(folder: str) -> list[os.DirEntry]:
    """What a folder holds; nothing if it can't be read."""
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def text_of(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace", newline="") as f:
            return f.read()
    except OSError:
        return None


@dataclass(frozen=True)
class Rules:
    """What a walk leaves out, and what the query asks for."""

    hidden: frozenset[str] = HIDDEN
    telling: tuple[str, ...] = TELLING
    content: bool = True
    wanted: dict[str, frozenset[str]] = field(default_factory=dict)  # column -> values; none: all
    below: tuple[str, ...] = ()  # path prefixes, all of which hold

    def may_hold(self, folder: str) -> bool:
        """Whether a wanted path can lie in a folder (with a slash at its end)."""
        paths = self.wanted.get("path")
        return all(folder.startswith(b) or b.startswith(folder) for b in self.below) and (paths is None or any(p.startswith(folder) for p in paths))

    def takes(self, row: dict) -> bool:
        return all(row[c] in values for c, values in self.wanted.items() if c != "repo") and all(row["path"].startswith(b) for b in self.below)


class Folder(InputPartition):
    """One folder of a repository ('' is its top, of which only the files are taken)."""

    def __init__(self, root: str, repo: str, folder: str, ignored: frozenset[str]):
        super().__init__((root, folder))
        self.root, self.repo, self.folder, self.ignored = root, repo, folder, ignored


def ignored_in(root: str, name: str, more: frozenset[str] = frozenset()) -> frozenset[str]:
    """The paths of a repository's ignore file: one a line, ``#`` for remarks, slashes at the end don't count."""
    lines = (text_of(os.path.join(root, name)) or "").splitlines()
    said = (line.strip().replace("\\", "/").rstrip("/") for line in lines if not line.strip().startswith("#"))
    return more | {s for s in said if s}


def folders(root: str, at: str, ignored: frozenset[str], rules: Rules, entries: list[os.DirEntry]) -> list[str]:
    """The folders in a folder that a scan enters."""
    inner = is_environment(entries)
    if inner and at:
        return []
    names = [e.name for e in entries if e.is_dir(follow_symlinks=False) and e.name not in SKIPPED and not (inner and e.name in ENV_FOLDERS) and (not e.name.startswith(".") or e.name in rules.hidden)]
    paths = [f"{at}/{n}" if at else n for n in names]
    return [p for p in paths if p not in ignored and rules.may_hold(p + "/")]


def files(part: Folder, at: str, rules: Rules, entries: list[os.DirEntry]) -> Iterator[tuple]:
    """Rows of the files in one folder."""
    if at and is_environment(entries):
        return
    for e in entries:
        path = f"{at}/{e.name}" if at else e.name
        tells = path in rules.telling
        if not e.is_file(follow_symlinks=False):
            continue
        listed = (not e.name.startswith(".") or e.name in rules.hidden) and path not in part.ignored
        try:
            size = e.stat(follow_symlinks=False).st_size
        except OSError:
            continue
        listed = listed and size <= MOST_BYTES
        ext = extension(e.name)
        row = {"path": path, "ext": ext, "language": LANGUAGES.get(ext, "other")}
        if (listed or tells) and rules.takes(row):
            text = text_of(os.path.join(part.root, path)) if rules.content and (tells or row["language"] != "other") else None
            yield part.repo, path, ext, size, row["language"], listed, text


class RepoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.single = options.get("single", "false").lower() == "true"
        self.ignore = options.get("ignore", ".scanignore")
        self.skip = frozenset(s.strip().rstrip("/") for s in options.get("skip", "").split(",") if s.strip())
        manifest = options.get("manifest")
        telling = TELLING + ((manifest,) if manifest else ())
        self.rules = Rules(HIDDEN | {self.ignore}, telling, options.get("content", "true").lower() == "true")

    def pushFilters(self, filters: list[Filter]):
        """Filters go into the walk, and stay with Spark as well, which costs next to nothing."""
        wanted, below = dict(self.rules.wanted), list(self.rules.below)
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("repo", "path", "ext", "language") and isinstance(f, (EqualTo, In)):
                values = frozenset(f.value if isinstance(f, In) else [f.value])
                wanted[column] = wanted[column] & values if column in wanted else values
            elif column == "path" and isinstance(f, StringStartsWith):
                below.append(f.value)
            yield f
        self.rules = Rules(self.rules.hidden, self.rules.telling, self.rules.content, wanted, tuple(below))

    def partitions(self):
        names = [""] if self.single else [e.name for e in entries_of(self.root) if e.is_dir()]
        out = []
        for name in names:
            root = os.path.join(self.root, name) if name else self.root
            repo = name or os.path.basename(self.root)
            if repo not in self.rules.wanted.get("repo", (repo,)):
                continue
            ignored = ignored_in(root, self.ignore, self.skip)
            inside = folders(root, "", ignored, self.rules, entries_of(root))
            out += [Folder(root, repo, folder, ignored) for folder in ["", *inside]]
        return out

    def read(self, part: Folder | None):
        if part is None:  # what Spark reads where there are no partitions
            return
        entries = entries_of(os.path.join(part.root, part.folder))
        yield from files(part, part.folder, self.rules, entries)
        if not part.folder:
            # files that tell what a repository is lie in folders that a scan doesn't enter, too
            for path in self.rules.telling:
                folder = os.path.dirname(path)
                if folder and folder.startswith("."):
                    yield from files(part, folder, self.rules, [e for e in entries_of(os.path.join(part.root, folder)) if f"{folder}/{e.name}" == path])
            return
        left = folders(part.root, part.folder, part.ignored, self.rules, entries)
        while left:
            at = left.pop()
            entries = entries_of(os.path.join(part.root, at))
            yield from files(part, at, self.rules, entries)
            left += folders(part.root, at, part.ignored, self.rules, entries)


class RepoFiles(DataSource):
    """Options: path; single (path is one repository); ignore (name of its ignore file); skip (more paths, by comma); manifest (path of a manifest); content (false: no text)."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoReader:
        return RepoReader(dict(self.options))


def scan(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The files of the repositories in a folder; rows that are not ``listed`` are there for their text alone.

    It turns on a setting of the session without which Spark refuses a reader that takes filters.
    """
    spark.dataSource.register(RepoFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("repo_files").options(**options).load(path)
