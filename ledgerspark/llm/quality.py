"""Quality rules: word, symbol and repetition counts of each text, then cross-document line frequency.

Lines of at least ``min_line_words`` words are normalised (lower case, single spaces) and hashed. For each
host (``source``) and line, documents are counted: by ``distinct`` = "texts", exact copies of one document are
one; by "rows", each is one of its own, so that a page with over ``max_docs`` copies loses all its lines (which
takes its last copy from a corpus as well: the README has figures). A line in more than ``max_docs`` documents
of its host is removed from all of them, or with ``spare_first`` from all but the text of the smallest doc_id.
A document is rejected if the base rules fail, or if the lines removed leave it less than ``min_left`` per cent
of its words.

Spark does the counting: one pass turns each text into its counts and its distinct line hashes (a small
table, written once), two aggregations with map-side parts count texts per line, and the frequent lines come
back through a join salted by text, so that a line in a third of all texts spreads over ``SALT`` tasks.

Defined results: null text counts as empty, has no words and fails; a null source is a host of its own;
repeated rows get equal verdicts; no rows give no rows; extra columns are ignored, and kept as they are by
``filtered``, whatever their names; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, small_batches

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50
MAX_DOCS, MIN_LEFT, MIN_LINE_WORDS = 25, 30, 3
SALT = 16
COUNTS = "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, lines array<struct<line:long,words:long>>"


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that occurs twice or more, the first time included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    code = a[:n].copy()
    for k in range(1, width):
        if len(ids) ** 2 >= 1 << 62 or int(code.max() + 1) * len(ids) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code * len(ids) + a[k : k + n]
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    hit = np.zeros(len(words), bool)
    for k in range(width):
        hit[at + k] = True
    return int(hit.sum())


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(normal: bytes) -> int:
    return signed(xxhash.xxh64_intdigest(normal))


def counts_of(text: str | None, min_line_words: int) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # on bytes: ASCII white space only
    seen, dup, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        if len(own) >= min_line_words:
            h = line_hash(b" ".join(own).lower())
            lines[h] = lines.get(h, 0) + len(own)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), chars, symbols, dup, repeated_words(words), signed(xxhash.xxh64_intdigest(raw, 42)), [{"line": h, "words": n} for h, n in lines.items()]


def counted(docs: DataFrame, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """Base counts, a hash of the text, and the words that each distinct line hash holds."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash", "lines"]
        for f in frames:
            got = pd.DataFrame([counts_of(t, min_line_words) for t in f["text"]], columns=names, index=f.index)
            yield pd.concat([f[["doc_id", "source"]], got], axis=1)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "source", "text").mapInPandas(count, COUNTS)


def frequent_lines(lines: DataFrame, max_docs: int, distinct: str) -> DataFrame:
    """(source, line, holder) of lines in over max_docs documents; lines: distinct (source, line, text_hash), with first_id and rows."""
    first = F.min(F.struct("first_id", "text_hash"))["text_hash"]
    n = F.count(F.lit(1)) if distinct == "texts" else F.sum("rows")
    return lines.groupBy("source", "line").agg(n.alias("n"), first.alias("holder")).filter(F.col("n") > max_docs).drop("n")


def removals(counts: DataFrame, max_docs: int = MAX_DOCS, distinct: str = "texts", spare_first: bool = False) -> DataFrame:
    """(source, text_hash, line, words): the lines that each text loses."""
    if distinct not in ("texts", "rows"):
        raise ValueError(f"distinct is texts or rows, not {distinct}")
    exploded = counts.select("doc_id", "source", "text_hash", F.explode("lines").alias("l"))
    lines = exploded.groupBy("source", F.col("l.line").alias("line"), "text_hash").agg(F.max("l.words").alias("words"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    salted = frequent_lines(lines, max_docs, distinct).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = lines.withColumn("salt", F.pmod("text_hash", F.lit(SALT)).cast("int")).alias("l")
    on = F.col("l.source").eqNullSafe(F.col("f.source")) & (F.col("l.line") == F.col("f.line")) & (F.col("l.salt") == F.col("f.salt"))
    met = own.join(salted.alias("f"), on)
    return (met.filter("l.text_hash <> f.holder") if spare_first else met).select("l.source", "l.text_hash", "l.line", "l.words")


def verdicts(counts: DataFrame, max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT, **how) -> DataFrame:
    """counts with base_failed, removed_words, removed_lines and kept."""
    lost = removals(counts, max_docs, **how).groupBy("source", "text_hash").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    on = F.col("c.source").eqNullSafe(F.col("r.source")) & (F.col("c.text_hash") == F.col("r.text_hash"))
    out = counts.drop("lines").alias("c").join(lost.alias("r"), on, "left").select("c.*", F.coalesce("removed_words", F.lit(0)).alias("removed_words"), "removed_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("removed_words")) < min_left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT, min_line_words: int = MIN_LINE_WORDS, **how) -> DataFrame:
    """One row per document with its counts and verdict; how: distinct, spare_first."""
    return verdicts(cut(counted(docs, min_line_words)), max_docs, min_left, **how)


def filtered(docs: DataFrame, **how) -> DataFrame:
    """The documents that stay, without the lines above the limit, in the columns of docs."""
    cols = docs.columns

    @F.pandas_udf("string")
    def without(text: pd.Series, lines: pd.Series) -> pd.Series:
        def one(t, gone):
            gone = set(gone)
            return "\n".join(x for x in t.split("\n") if line_hash(normal_line(x.encode("utf-8", "surrogatepass"))) not in gone)

        return pd.Series([t if g is None else one(t, g) for t, g in zip(text, lines, strict=True)])

    # equal (doc_id, source, text) get equal verdicts, so one of each is enough to join
    kept = judge(docs, **how).filter("kept").groupBy("doc_id", "source", "text_hash").agg(F.first("removed_lines").alias("removed_lines"))

    own = small_batches(docs).select(F.struct(*cols).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).alias("d")  # XXH64 with seed 42, as in counts
    on = F.col("d.row.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")) & F.col("d.row.source").eqNullSafe(F.col("k.source")) & (F.col("d.hash") == F.col("k.text_hash"))
    out = own.join(kept.alias("k"), on).select("d.row", F.col("k.removed_lines").alias("gone"), F.col("d.row.text").alias("text"))
    out = out.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(without("text", "gone")).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in cols:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in cols])
