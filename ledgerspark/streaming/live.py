"""The stateful operators as streaming queries over the same tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# A repeated read is refused from so many tokens on, and the refusal itself costs some.
LEAST_TOKENS, REFUSAL_TOKENS = 100, 40
READS = "session_id string, seq long, path string, decision string, reason string, saved_tokens long"
KEPT = 200
#: The state store that operators with state of their own need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def merged_requests(lines: DataFrame, late: str | None = None) -> DataFrame:
    """Streamed lines of a request as one row with the highest of each usage field, in update mode.

    Lines without a key are requests of their own, told apart by line_no. With ``late``, lines have a timestamp ``ts``
    and a request is forgotten when the watermark passes the day of its lines, so that state stays bounded.
    """
    best = [F.max(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")]
    own = F.when(F.col("request_key").isNull(), F.col("line_no"))
    keyed = lines.withColumn("own_line", own)
    keys = ["file_id", "request_key", "own_line"]
    if late:
        keyed, keys = keyed.withWatermark("ts", late), [*keys, F.window("ts", "1 day").alias("w")]
    return keyed.groupBy(*keys).agg(*best, F.count(F.lit(1)).alias("n_lines")).drop("w")


def daily_usage(requests: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tokens by day of ``ts``; a day ends when the watermark passes it, and later rows are dropped."""
    total = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")
    by = requests.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    return by.agg(F.count(F.lit(1)).alias("requests"), F.sum(total).alias("tokens")).select(F.to_date("w.start").alias("day"), "requests", "tokens")


def active_spans(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Spans of each session's activity without a pause of ``gap``."""
    by = events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("events")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def canonical(content: Column) -> Column:
    """Text without a byte order mark, with one kind of line end: what a log and a disk hold of the same file."""
    return F.regexp_replace(F.regexp_replace(content, "^\ufeff", ""), r"\r\n?", "\n")


def warm_entries(reads: DataFrame, files: DataFrame, keep: int = KEPT) -> DataFrame:
    """session_id, path, sha256, mtime_ms, tokens: what sessions have read, before there was a stream, of files that still hold the same text.

    reads: session_id, turn, path, content and start_line, lines, total_lines (null if unknown) of each read in the logs; files:
    path, content, sha256, mtime_ms, size_bytes of what is there now. Of a session's whole reads the last of each path
    counts, and of the paths the ``keep`` read last (ties by path). Texts are compared by the SHA-256 of their canonical form.
    """
    whole = (F.coalesce("start_line", F.lit(1)) == 1) & F.coalesce(F.col("lines") >= F.col("total_lines"), F.lit(True)) & F.col("content").isNotNull()
    digest = lambda: F.sha2(canonical(F.col("content")), 256)
    last = reads.filter(whole & (F.length("path") > 0)).groupBy("session_id", "path").agg(F.max("turn").alias("turn"), F.max_by(digest(), "turn").alias("digest"))
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn"), "path"))
    last = last.withColumn("rank", rank).filter(F.col("rank") <= keep)
    now = files.select("path", digest().alias("digest"), "sha256", "mtime_ms", F.ceil(F.col("size_bytes") / 4).alias("tokens"))
    return last.join(now, ["path", "digest"]).select("session_id", "path", "sha256", "mtime_ms", "tokens")


class ReadMemory(StatefulProcessor):
    """What a session has read: a map from path to fingerprint and tokens, kept in the state store, file by file."""

    def __init__(self, least: int, refusal: int, ttl_ms: int | None) -> None:
        self.least, self.refusal, self.ttl_ms = least, refusal, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "path string", "sha256 string, mtime_ms long, tokens long", self.ttl_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.held.updateValue((r.path,), (r.sha256, whole(r.mtime_ms), whole(r.tokens)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for f in rows:
            for r in f.sort_values("seq").itertuples(index=False):
                why, saved = self.decide(r)
                out.append((key[0], r.seq, r.path, "deny" if why == "unchanged" else "pass", why, saved))
        yield pd.DataFrame(out, columns=["session_id", "seq", "path", "decision", "reason", "saved_tokens"])

    def decide(self, r) -> tuple[str, int]:
        """Why a read is refused ("unchanged") or passes, and what a refusal saves; a whole read with a fingerprint that passes is remembered."""
        if not r.path:
            return "missing-file-path", 0
        if r.partial:
            return "partial-read-requested", 0
        known = self.held.getValue((r.path,)) if self.held.exists() and self.held.containsKey((r.path,)) else None
        if not r.sha256 or pd.isna(r.sha256):
            return "no-cache-entry" if known is None else "missing-current-fingerprint", 0
        now = (r.sha256, whole(r.mtime_ms))
        if known is not None and tuple(known[:2]) == now and known[2] >= self.least:
            return "unchanged", max(0, known[2] - self.refusal)
        self.held.updateValue((r.path,), (*now, -(-whole(r.size_bytes) // 4)))
        return "no-cache-entry" if known is None else "file-changed" if tuple(known[:2]) != now else "below-threshold", 0

    def close(self) -> None:
        pass


def whole(x) -> int:
    """A number from pandas, which has whole numbers as floats beside nulls; -1 for null."""
    return -1 if pd.isna(x) else int(x)


def read_decisions(reads: DataFrame, warm: DataFrame | None = None, least: int = LEAST_TOKENS, refusal: int = REFUSAL_TOKENS, ttl_ms: int | None = None) -> DataFrame:
    """Each whole read of a file that a session has read before, unchanged, is refused.

    reads: session_id, seq, path, partial (boolean), sha256, mtime_ms, size_bytes; sha256 is null where the file is
    gone. State: one entry a file for each session, forgotten ``ttl_ms`` after it was written if that is given. warm
    (warm_entries()) is what sessions start with; a query that goes on from a checkpoint has it already. Partial reads and
    reads without path or fingerprint pass and are not remembered; others are remembered when they pass. The session needs the
    state store of STORE.
    """
    mode = "None" if ttl_ms is None else "ProcessingTime"
    first = None if warm is None else warm.groupBy("session_id")
    return reads.groupBy("session_id").transformWithStateInPandas(ReadMemory(least, refusal, ttl_ms), READS, "Append", mode, first)


class SignalMemory(StatefulProcessor):
    """A session's newest signals, as a list in order of time."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "at long, signal string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = [(int(a), w) for a, w in self.held.get()] if self.held.exists() else []
        for f in rows:
            every += zip(f["at"].tolist(), f["signal"].tolist(), strict=True)
        newest = sorted(every)[-self.keep :]
        self.held.put(newest)
        yield pd.DataFrame([(key[0], a, w, k) for k, (a, w) in enumerate(reversed(newest), 1)], columns=["session_id", "at", "signal", "rank"])

    def close(self) -> None:
        pass


def newest_signals(signals: DataFrame, keep: int = KEPT) -> DataFrame:
    """session_id, at, signal, rank (1: the newest): the session's newest ``keep`` signals (session_id, at, signal) after each batch that brings any. The session needs the state store of STORE."""
    return signals.groupBy("session_id").transformWithStateInPandas(SignalMemory(keep), "session_id string, at long, signal string, rank long", "Update", "None")
