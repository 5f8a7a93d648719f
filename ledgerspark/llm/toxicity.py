"""Toxicity by multiple-instance learning.

A sentence scores sigmoid(bias + weights of its distinct words and of their beginnings, which stand for
inflected forms not seen in training); a document's score is the noisy-or of its
sentences, 1 - prod(1 - p). Weights are learned from document labels alone, by full-batch Adam on the
documents' log-likelihood. The model is fitted on the driver from at most ``SAMPLE`` labelled documents with
different texts (smallest hashes of their ids first); Spark cuts their texts into sentences of hashed features
(``SLOTS`` of them), from the first ``FIT_CHARS`` characters of each. ``judge`` fits before it returns. Scoring is one Arrow pass over whole texts with the weights broadcast.
Every offending sentence, one that scores ``OFFENDS`` or more (alone it would make its text toxic), is located
by its offsets, and so is the worst sentence of each text.

Defined results: null and empty texts have no sentence and score 0; repeated rows each get a row; without
any positive or negative label the model is its prior and finds nothing; empty tables give no rows; labels
that are null are not learned from; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

SAMPLE, SLOTS, MIN_DOCS, KEPT = 3000, 1 << 19, 6, 100_000
STEMS = (4, 5, 6, 7)
STEPS, RATE, DECAY, PRIOR = 150, 0.1, 1e-4, -6.0
OFFENDS = THRESHOLD = 0.3
#: Characters of a text that fitting reads at most; scoring always reads whole texts.
FIT_CHARS = 1 << 18
SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (SLOTS - 1)


class Slots(dict):
    """Words' slots, filled in as words are met and emptied at ``KEPT`` words."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= KEPT:
            self.clear()
        self[word] = out = [slot(f) for f in features(word)]
        return out


def sentences(text: str, slots: Slots) -> tuple[bytes, bytes]:
    """All sentences' feature slots in a row, and how many each has (little-endian 32-bit integers)."""
    rows = [[k for w in set(LETTERS.findall(s)) for k in slots[w]] for s in SENTENCE.findall(text.lower())]
    return np.array([k for r in rows for k in r], "<i4").tobytes(), np.array([len(r) for r in rows], "<i4").tobytes()


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n


def sample(docs: DataFrame, labels: DataFrame, most: int) -> list[tuple[bytes, bytes, int]]:
    """At most ``most`` labelled documents as feature slots. Only ids are ranked; texts of the chosen ones are read, where they are."""
    ids = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = small_batches(docs).filter("text is not null").join(F.broadcast(ids), "doc_id")  # at most ``most`` rows
    chosen = chosen.select("toxic", F.substring("text", 1, FIT_CHARS).alias("text")).dropDuplicates(["text"])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = Slots()
        for f in frames:
            for y, t in zip(f["toxic"], f["text"], strict=True):
                yield pd.DataFrame([(zlib.crc32(t.encode("utf-8", "surrogatepass")), *sentences(t, slots), int(y > 0))], columns=["h", "slots", "sizes", "toxic"])

    got = chosen.mapInPandas(each, "h long, slots binary, sizes binary, toxic int").orderBy("h", "slots").limit(most)
    return [(bytes(r.slots), bytes(r.sizes), r.toxic) for r in got.collect()]


def fit(docs: list[tuple[bytes, bytes, int]]) -> np.ndarray:
    """Weights by slot and, at the end, the bias."""
    theta = np.zeros(SLOTS + 1, np.float32)
    theta[-1] = PRIOR
    y = np.array([y for _, _, y in docs], float)
    if not len(y) or y.min() == y.max():
        return theta
    words = [np.frombuffer(a, "<i4") for a, _, _ in docs]
    seen = np.zeros(SLOTS, np.int32)
    for w in words:
        seen[np.unique(w)] += 1
    known = np.flatnonzero(seen >= MIN_DOCS)
    number = np.full(SLOTS, -1, np.int32)
    number[known] = np.arange(len(known))
    sizes = [np.frombuffer(b, "<i4") for _, b, _ in docs]
    doc = np.repeat(np.arange(len(docs)), [len(s) for s in sizes])
    word = number[np.concatenate(words)]
    sen = np.repeat(np.arange(len(doc), dtype=np.int32), np.concatenate(sizes))
    sen, word = sen[word >= 0], word[word >= 0]
    del words, sizes
    t = np.zeros(len(known) + 1)
    t[-1] = PRIOR
    m, v = np.zeros_like(t), np.zeros_like(t)
    for step in range(1, STEPS + 1):
        z = t[-1] + np.bincount(sen, t[word], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))  # log of "no sentence is toxic"
        odds = np.exp(none) / np.maximum(-np.expm1(none), 1e-9)
        g = np.where(y[doc] > 0, p * odds[doc], -p)
        grad = np.append(np.bincount(word, g[sen], len(known)), g.sum()) / len(y)
        grad[:-1] -= DECAY * t[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        t += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta[known], theta[-1] = t[:-1], t[-1]
    return theta


class Weights(dict):
    """Words' total weights, filled in as words are met and emptied at ``KEPT`` words."""

    def __init__(self, theta: np.ndarray):
        self.theta, self.bias = theta, float(theta[-1])

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT:
            self.clear()
        self[word] = out = float(sum(self.theta[slot(f)] for f in features(word)))
        return out


def score_text(text: str | None, words: Weights) -> tuple[float, int, int, float, list[dict]]:
    """Document score, then start, end and score of its worst sentence, then those of every offending one. Beginnings that words share count for each."""
    bias, get = words.bias, words.__getitem__
    none, worst, k_worst, at, found = 0.0, 0.0, 0, (0, 0), []
    text = text or ""
    low = text.lower()
    for k, s in enumerate(SENTENCE.finditer(low)):
        z = bias + sum(map(get, set(LETTERS.findall(s[0]))))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        none += math.log1p(-min(p, 1 - 1e-12))
        if p > worst:
            worst, k_worst, at = p, k, s.span()
        if p >= OFFENDS:
            found.append((k, *s.span(), p))
    if len(low) != len(text):  # lower-casing moved the offsets: find them in the text as it is
        spans = [m.span() for m in SENTENCE.finditer(text)]
        where = lambda k: spans[k] if k < len(spans) else (0, len(text))
        at, found = where(k_worst), [(k, *where(k), p) for k, _, _, p in found]
    return -math.expm1(none), *at, worst, [{"start": a, "end": b, "score": p} for _, a, b, p in found]


def score(docs: DataFrame, theta: np.ndarray) -> DataFrame:
    """doc_id, score, worst_start, worst_end, worst_score, offending for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(theta)  # SLOTS numbers

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Weights(shared.value)
        for f in frames:
            got = pd.DataFrame([score_text(t, words) for t in f["text"]], columns=["score", "worst_start", "worst_end", "worst_score", "offending"], index=f.index)
            yield pd.concat([f[["doc_id"]], got], axis=1)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(each, "doc_id long, score double, worst_start long, worst_end long, worst_score double, offending array<struct<start: long, end: long, score: double>>")


def judge(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, worst_start, worst_end, offending (start, end, score of each offending sentence); labels of fold ``held`` are never learned from."""
    theta = fit(sample(docs.select("doc_id", "text"), labels.filter(fold(F.col("doc_id"), folds) != held), most))
    out = score(docs, theta)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_end", "offending")
