"""What log files hold, kept as tables between runs, so that a run reads only files that are new or changed.

The cache is a folder. ``requests``, ``calls`` and ``sessions`` are Parquet tables in segments, one for each reading, that
are never changed. A manifest lists every file that is up to date, with its size, time and segment. ``versions`` has a row
for each manifest, with a header; it is written last, so a run that dies leaves the version before it in force. Rows of
a segment count only for the files that the manifest in force gives to this segment.

A run lists the files (names, sizes and times, no bytes), takes those whose (path, size, time) the manifest lacks, and hands
their paths to the reader: nothing else is opened. Another header means that lines were understood in another way, so
everything is read again. Empty files hold nothing and are not listed; files with bytes but
without a line are unreadable: they are counted and tried again by the next run.

With ``since``, only files written in the window are reported, but a request in them may be a copy from a file outside.
Such files are picked before they are read: a copy keeps the time of its original, so it is in a file of the same
folder that was written after the reported session began, give or take ``SLACK``. Where logs name the threads they
came from, files of the same family count, whenever written; an open family, one that names a thread without a log, may
share requests with any.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

HEADER = "session tables, 1"
TABLES = ("requests", "calls", "sessions")
SLACK = "INTERVAL 1 HOUR"
MANIFEST = "path string, mtime timestamp, size long, file_id string, segment string"
VERSIONS = "version long, header string, manifest string"
FILE = ["path", "mtime", "size"]


@dataclass
class Logs:
    """Logs as tables, by file_id: parsed lines, requests, tool calls and sessions."""

    lines: DataFrame | None
    requests: DataFrame
    calls: DataFrame
    sessions: DataFrame


@dataclass
class Source:
    """Where logs are: files() lists path, open (what to open), mtime, size, file_id and family; parse() reads some of them, by ``open``.

    by_start: a copy is in a file of its family written after the session began; else whenever written.
    """

    files: Callable[[], DataFrame]
    parse: Callable[[list[str]], Logs]
    by_start: bool = True


@dataclass
class Loaded:
    """logs (whose lines are not kept) of the reported files and of those that may hold copies; reported: file_id; counts of files."""

    logs: Logs
    reported: DataFrame
    discovered: int
    read: int
    unreadable: int


def manifest_in_force(spark: SparkSession, root: str, header: str) -> tuple[int, DataFrame | None]:
    """The newest version's number, and its manifest if it has this header."""
    try:
        rows = spark.read.schema(VERSIONS).parquet(f"{root}/versions").orderBy(F.desc("version"), F.desc("manifest")).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    if not rows:
        return 0, None
    return rows[0]["version"], spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{rows[0]['manifest']}") if rows[0]["header"] == header else None


def commit(spark: SparkSession, root: str, header: str, version: int, manifest: DataFrame) -> None:
    """Write the manifest, then the row that puts it in force: one file, which appears whole or not at all."""
    name = uuid.uuid4().hex
    manifest.write.parquet(f"{root}/manifests/{name}")
    spark.createDataFrame([(version, header, name)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{root}/versions")


def segment_of(root: str, logs: Logs) -> str:
    """The tables of logs written as a new segment; its name."""
    name = uuid.uuid4().hex
    for t in TABLES:
        getattr(logs, t).write.parquet(f"{root}/{t}/segment={name}")
    return name


def kept_rows(spark: SparkSession, root: str, manifest: DataFrame, empty: Callable[[], Logs]) -> Logs:
    """The tables as the manifest has them: its small rows pick segments before these are read, then rows."""
    live = manifest.select("segment", "file_id").distinct()

    def one(t: str) -> DataFrame:
        try:
            rows = spark.read.option("mergeSchema", True).parquet(f"{root}/{t}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return getattr(empty(), t)
        return rows.withColumn("segment", F.col("segment").cast("string")).join(live, ["segment", "file_id"], "left_semi").drop("segment")

    return Logs(None, *[one(t) for t in TABLES])


class _Run:
    """One run: the manifest grows by what is read."""

    def __init__(self, spark: SparkSession, root: str, source: Source, header: str) -> None:
        self.spark, self.root, self.source = spark, root, source
        self.version, before = manifest_in_force(spark, root, header)
        self.listing = written(source.files())
        old = before if before is not None else spark.createDataFrame([], MANIFEST)
        self.manifest = written(old.join(self.listing.select(*FILE), FILE, "left_semi"))
        self.dirty = before is None or self.manifest.count() < old.count()
        self.read = self.unreadable = 0

    def refresh(self, wanted: DataFrame) -> None:
        """Read those of the wanted files (rows of the listing) that the manifest lacks. Their paths are on the driver, as Spark's own file index is."""
        fresh = written(wanted.join(self.manifest.select(*FILE), FILE, "left_anti"))
        paths = [r["open"] for r in fresh.select("open").collect()]
        if not paths:
            return
        segment = segment_of(self.root, self.source.parse(paths))
        got = self.spark.read.parquet(f"{self.root}/sessions/segment={segment}").select("file_id").distinct()
        entries = written(fresh.join(got, "file_id", "left_semi").select(*FILE, "file_id", F.lit(segment).alias("segment")))
        self.read, self.unreadable, self.dirty = self.read + len(paths), self.unreadable + len(paths) - entries.count(), True
        self.manifest = written(self.manifest.unionByName(entries))

    def rows(self, files: DataFrame) -> Logs:
        return kept_rows(self.spark, self.root, self.manifest.join(files.select(*FILE), FILE, "left_semi"), lambda: self.source.parse([]))


def copy_candidates(listing: DataFrame, reported: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Files of the listing, not among the reported, that can hold a copy of a reported file's request.

    starts: file_id, started_at (timestamp) of the reported: candidates are of the same family (null: of none) and
    were written at most SLACK before its earliest session began, or at any time if a start is unknown. Without starts,
    an open family (null) is a candidate for all, and all are candidates for it.
    """
    other = listing.join(reported.select("path"), "path", "left_anti")
    if starts is not None:
        since = F.when(F.count_if(F.col("started_at").isNull()) == 0, F.min("started_at") - F.expr(SLACK))
        per = reported.join(starts, "file_id", "left").groupBy("family").agg(since.alias("since")).alias("t")
        near = F.col("o.family").eqNullSafe(F.col("t.family")) & (F.col("t.since").isNull() | (F.col("o.mtime") >= F.col("t.since")))
        return other.alias("o").join(per, near, "left_semi")
    families = reported.select("family").distinct()
    if not families.filter("family is null").isEmpty():
        return other
    return other.filter("family is null").unionByName(other.join(families, "family", "left_semi").select(*other.columns))


def load(spark: SparkSession, root: str, source: Source, since: Column | None = None, header: str = HEADER) -> Loaded:
    """What the source's files hold, reading only what the cache at root lacks, and the cache brought up to date."""
    run = _Run(spark, root, source, header)
    reported = run.listing if since is None else written(run.listing.filter(F.col("mtime") >= since))
    run.refresh(reported)
    files = reported
    if since is not None:
        starts = None
        if source.by_start:
            starts = run.rows(reported).sessions.select("file_id", F.try_to_timestamp("started_at").alias("started_at"))
        files = written(reported.unionByName(copy_candidates(run.listing, reported, starts).select(*reported.columns)))
        run.refresh(files)
    if run.dirty:
        commit(spark, root, header, run.version + 1, run.manifest)
    return Loaded(run.rows(files), reported.select("file_id").distinct(), run.listing.count(), run.read, run.unreadable)


def compact(spark: SparkSession, root: str, source: Source, header: str = HEADER) -> None:
    """The rows in force as one segment, with a manifest that names it."""
    version, manifest = manifest_in_force(spark, root, header)
    if manifest is not None:
        name = segment_of(root, kept_rows(spark, root, manifest, lambda: source.parse([])))
        commit(spark, root, header, version + 1, manifest.withColumn("segment", F.lit(name)))
