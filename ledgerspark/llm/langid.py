"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units of ``HIDDEN`` cells read each window of ``WINDOW`` bytes forwards and backwards;
at every position a softmax over both states labels the byte. A document's probabilities are the mean over
all positions of its whole text. Training is backpropagation through time in numpy, on the driver, from at
most ``SAMPLE`` texts or ``LEAST`` a language, if that is more (smallest hashes of their ids first, as many of
each language as there are up to an equal share). Every language that a text is labelled with is learned.
Labelling is one Arrow pass with the weights (some kilobytes) sent along.

Defined results: null texts and texts without a letter are ``und`` with score 0; repeated rows each get a
row; without any labelled text all are ``und``; no rows give no rows; a null language is not learned from;
extra columns are ignored; texts of any length are read whole, window by window (fitting, which ``label`` does
on the driver before it returns, reads ``FIT_CHARS`` characters of each sampled text). A letter is what
``str.isalpha`` takes for one: signs of number such as a superscript two are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, small_batches

HIDDEN, WINDOW, LANES = 8, 64, 4096
SAMPLE, LEAST, STEPS, BATCH, RATE = 1200, 10, 260, 256, 0.02
#: Characters of a text that fitting reads at most; labelling always reads whole texts.
FIT_CHARS = 1 << 18
BUCKET_BITS = 12


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def windows(raw: bytes) -> np.ndarray:
    """(n, WINDOW) bytes, padded with zeros."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def raw_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Parameters by name: for each direction, input rows E (3H x 256), recurrent U (3H x H); output V (L x 2H), c (L)."""

    def __init__(self, n_out: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["E" + d] = r.normal(0, 0.3, (3 * HIDDEN, 256)).astype(np.float32)
            self.p["U" + d] = r.normal(0, 1 / np.sqrt(HIDDEN), (3 * HIDDEN, HIDDEN)).astype(np.float32)
        self.p["V"] = r.normal(0, 0.3, (n_out, 2 * HIDDEN)).astype(np.float32)
        self.p["c"] = np.zeros((n_out, 1), np.float32)

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """x: (T, B) bytes. Returns h (T, H, B) and, for training, each step's gates."""
        e, u, n = self.p["E" + d], self.p["U" + d], HIDDEN
        t_all, b = x.shape
        h, out, kept = np.zeros((n, b), np.float32), np.empty((t_all, n, b), np.float32), []
        for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
            a = np.take(e, x[t], axis=1)
            g = u[: 2 * n] @ h
            g += a[: 2 * n]
            sigmoid(g)
            z, r = g[:n], g[n:]
            rh = r * h
            c = u[2 * n :] @ rh
            c += a[2 * n :]
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c  # z h + (1 - z) c
            if keep:
                kept.append((t, h, z, r, rh, c))
            h = out[t] = new
        return out, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, B) bytes -> (T, L, B)."""
        hf, hb = self.states(x, "f")[0], self.states(x, "b")[0]
        v = self.p["V"]
        o = np.matmul(v[:, :HIDDEN], hf)
        o += np.matmul(v[:, HIDDEN:], hb)
        o += self.p["c"]
        o -= o.max(1, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(1, keepdims=True)
        return o

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over non-padding positions; y: (B,) labels."""
        n, (t_all, b) = HIDDEN, x.shape
        h, kept = {}, {}
        for d in "fb":
            h[d], kept[d] = self.states(x, d, True)
        v = self.p["V"]
        o = np.matmul(v[:, :n], h["f"]) + np.matmul(v[:, n:], h["b"]) + self.p["c"]
        o = np.exp(o - o.max(1, keepdims=True))
        o /= o.sum(1, keepdims=True)
        o[:, y, np.arange(b)] -= 1
        seen = (x > 0).astype(np.float32)
        o *= (seen / max(seen.sum(), 1))[:, None, :]
        g = {k: np.zeros_like(a) for k, a in self.p.items()}
        g["c"] = o.sum((0, 2))[:, None]
        for d, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            g["V"][:, part] = np.einsum("tlb,thb->lh", o, h[d])
            back = np.matmul(v[:, part].T, o)  # (T, H, B)
            u, dh, ge = self.p["U" + d], np.zeros((n, b), np.float32), g["E" + d]
            for t, before, z, r, rh, c in reversed(kept[d]):
                dh = dh + back[t]
                dz = dh * (before - c) * z * (1 - z)
                dc = dh * (1 - z) * (1 - c * c)
                drh = u[2 * n :].T @ dc
                dr = drh * before * r * (1 - r)
                da = np.concatenate([dz, dr, dc])
                g["U" + d][: 2 * n] += da[: 2 * n] @ before.T
                g["U" + d][2 * n :] += dc @ rh.T
                for k in range(3 * n):
                    ge[k] += np.bincount(x[t], da[k], 256)
                dh = dh * z + drh * r + u[: 2 * n].T @ da[: 2 * n]
        return g


def train(texts: list[str], labels: list[int], n_out: int, steps: int = STEPS) -> Network:
    net, r = Network(n_out), np.random.default_rng(11)
    found = [windows(raw_bytes(t)) for t in texts]
    x = np.concatenate(found)
    y = np.repeat(np.array(labels), [len(f) for f in found])
    by = [np.flatnonzero(y == k) for k in range(n_out)]
    by = [b for b in by if len(b)]
    m = {k: np.zeros_like(a) for k, a in net.p.items()}
    s = {k: np.zeros_like(a) for k, a in net.p.items()}
    for step in range(1, steps + 1):
        at = np.concatenate([r.choice(b, -(-BATCH // len(by))) for b in by])
        g = net.gradients(np.ascontiguousarray(x[at].T), y[at])
        norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)) + 0.05)
        for k, a in g.items():
            a = a * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            s[k] = 0.99 * s[k] + 0.01 * a * a
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(texts: list[str], net: Network) -> np.ndarray:
    """(n, L): each text's mean probabilities over all its positions. Windows of many texts share a pass."""
    n_out = len(net.p["c"])
    total, count = np.zeros((len(texts), n_out)), np.zeros(len(texts))
    held, owner, size = [], [], 0

    def flush():
        x = np.ascontiguousarray(np.concatenate(held).T)
        own = np.concatenate(owner)
        for at in range(0, x.shape[1], LANES):
            part = np.ascontiguousarray(x[:, at : at + LANES])
            p = net.probabilities(part)
            seen = part > 0
            p *= seen[:, None, :]
            per = p.sum(0)
            o = own[at : at + LANES]
            for k in range(n_out):
                total[:, k] += np.bincount(o, per[k], len(texts))
            count[:] += np.bincount(o, seen.sum(0), len(texts))

    for i, t in enumerate(texts):
        raw = raw_bytes(t)
        for at in range(0, len(raw), WINDOW * LANES):  # a long text goes through in parts
            w = windows(raw[at : at + WINDOW * LANES])
            held.append(w)
            owner.append(np.full(len(w), i))
            size += len(w)
            if size >= LANES:
                flush()
                held, owner, size = [], [], 0
    if held:
        flush()
    return total / np.maximum(count, 1)[:, None]


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n


def smallest(ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, lang, k): the k ids of each language with the smallest hashes, in that order; ids: (doc_id, lang), each once.

    Ids are counted by language and the first BUCKET_BITS bits of their hash, and only those in the buckets that hold a
    language's first k go on to be ranked: k and a bucket's share, whatever the language has.
    """
    hashed = ids.withColumn("hash", F.xxhash64("doc_id")).withColumn("bucket", F.shiftright("hash", 64 - BUCKET_BITS))
    counts = hashed.groupBy("lang", "bucket").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("lang").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = counts.withColumn("before", before).filter(F.col("before") < k).select("lang", "bucket")
    rank = F.row_number().over(W.partitionBy("lang").orderBy("hash", "doc_id"))
    return hashed.join(first, ["lang", "bucket"], "left_semi").select("doc_id", "lang", rank.alias("k")).filter(F.col("k") <= k)


def sample(docs: DataFrame, most: int) -> list[tuple[str, str]]:
    """At most ``most`` (text, lang) pairs, or ``LEAST`` a language, shared out evenly among all languages.

    Ids are ranked first, in a pass that reads no text; then the chosen texts are read, ``FIT_CHARS`` of each.
    """
    some = docs.filter("lang is not null and text is not null and doc_id is not null")
    ranked = cut(smallest(some.select("doc_id", "lang").distinct(), max(LEAST, most)))
    n = ranked.filter("k = 1").count()
    if not n:
        return []
    chosen = ranked.filter(F.col("k") <= max(LEAST, most // n)).drop("k")
    got = some.join(F.broadcast(chosen), ["doc_id", "lang"]).select(F.substring("text", 1, FIT_CHARS).alias("text"), "lang", "doc_id")
    got = got.withColumn("k", F.row_number().over(W.partitionBy("lang", "doc_id").orderBy("text"))).filter("k = 1")
    return [(r.text, r.lang) for r in got.orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect()]


def label(docs: DataFrame, folds: int = 3, held: int = 1, most: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    pairs = sample(docs.select("doc_id", "text", "lang").filter(fold(F.col("doc_id"), folds) != held), most)
    pairs = [(t, x) for t, x in pairs if has_letter(t)]
    langs = sorted({x for _, x in pairs})
    net = train([t for t, _ in pairs], [langs.index(x) for _, x in pairs], len(langs), steps) if langs else None

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t if net and has_letter(t) else "" for t in f["text"]]
            pred, best = np.full(len(f), "und", object), np.zeros(len(f))
            if net:
                p = pooled(texts, net)
                ok = np.array([bool(t) for t in texts], bool)
                if len(p):
                    pred[ok] = np.array(langs, object)[p.argmax(1)][ok]
                    best[ok] = np.clip(p.max(1), 0, 1)[ok]
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang_pred": pred, "score": best})

    out = small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(each, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
