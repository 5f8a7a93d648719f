"""Secret scans: fixed patterns, then a token-efficiency test.

Base spans come from three patterns (kinds assign, access, hex). The method adds spans of kind ``random``:
runs of ``MIN_RUN`` or more characters of the kind that keys are made of, for which a byte-level BPE
vocabulary needs a token for every ``MAX_RATIO`` characters or fewer (words and names take more characters a
token). Left out are known digests (hex of 32, 40, 56, 64, 96 or 128 digits), UUIDs, numbers, runs of one
character class, and runs that a base span meets.

Work on a row needs that row only: one Arrow pass and no shuffle.

Defined results: null counts as empty; a text without secrets has zeros, empty ``spans`` and the digest of
the empty string; repeated rows each get a row; no rows give no rows; texts of any length are scanned whole;
extra columns are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
KINDS = ("assign", "access", "hex", "random")
MIN_RUN, MAX_RATIO, MASK = 20, 2.2, "[secret]"


@cache
def vocabulary(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_random(run: str, enc) -> bool:
    if DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run):
        return False
    classes = any(c.islower() for c in run) + any(c.isupper() for c in run) + any(c.isdigit() for c in run)
    return classes >= 2 and len(run) <= MAX_RATIO * len(enc.encode_ordinary(run))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower() if text.isascii() else None
    if low is None or any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spans_of(text: str, enc) -> tuple[list, list]:
    """Base spans, and all spans, in order."""
    base = ordered(base_spans(text))
    more = [(m.start(), m.end(), "random") for m in RUN.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _ in base) and is_random(m[0], enc)]
    return base, ordered(base + more)


def written(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans: list) -> str:
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


def scan(docs: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, redacted (the text with its secrets masked)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = vocabulary(vocab, pattern)
        for f in frames:
            out = []
            for t in f["text"]:
                t = t or ""
                base, every = spans_of(t, enc)
                kinds = [k for _, _, k in every]
                out.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            yield pd.concat([f[["doc_id"]], pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"], index=f.index)], axis=1)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(each, schema)


def redacted(docs: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """docs with every secret in ``text`` replaced by a mask; all documents stay, null texts stay null."""

    @F.pandas_udf("string")
    def mask(text: pd.Series) -> pd.Series:
        enc = vocabulary(vocab, pattern)
        return pd.Series([t if t is None else masked(t, spans_of(t, enc)[1]) for t in text], dtype="object")

    out = small_batches(docs).withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
