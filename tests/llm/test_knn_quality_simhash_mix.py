import hashlib
import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerspark.llm import knn, mixing, quality, simhash

from .fixture_rows import BASE, DOCS, TEXTS, docs, none, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_k(spark, k):
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (150, 6)).round(1)
    x[20:60] = x[7]  # ties in a hot cell
    data = [(i, v.tolist(), "clash", "clash") for i, v in enumerate(x)] + [(7, x[7].tolist(), "a", "b"), (40, x[40].tolist(), "", ""), (200, None, "", ""), (220, [float("nan")] * 6, "", ""), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0], "", ""), (None, x[0].tolist(), "", "")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, cell string, id string")
    got = [tuple(q) for q in knn.top_k(knn.integers(df), F.col("vec_id") % 20 == 0, k=k, pivots=5, block=16).select("query_id", "rank", "vec_id", "score").collect()]
    z = np.floor(64 * x).astype(int)
    want = []
    for q in range(0, 150, 20):
        best = sorted((-int(z[q] @ z[j]), j) for j in (*range(150), 7, 40) if j != q)[:k]  # each row is a candidate
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert knn.top_k(knn.integers(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_skip_far_tiles(spark):
    r = np.random.default_rng(8)
    centre = r.normal(0, 4, (40, 16))
    x = np.concatenate([c + r.normal(0, 0.3, (50, 16)) for c in centre])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent, every = knn.pairs(knn.integers(df), F.col("vec_id") % 20 == 0, k=10, block=50)
    assert 0 <= sent < every / 2
    z = np.floor(64 * x).astype(int)
    got = {(g.query_id, g.rank): (g.vec_id, g.score) for g in knn.top_k(knn.integers(df), F.col("vec_id") % 20 == 0, k=10, block=50).collect()}
    for q in range(0, 2000, 20):
        best = sorted((-int(z[q] @ z[j]), j) for j in range(2000) if j != q)[:10]
        assert [got[q, n + 1] for n in range(10)] == [(j, -s) for s, j in best]


def brute_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    twice = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute_quality(rows, max_docs=quality.MAX_DOCS, distinct="texts", spare_first=False):
    """rows: (doc_id, text, source) -> (doc_id, counts, failed, kept, text left)."""
    holders = {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            if len(w := WORD.findall(line)) >= quality.MIN_LINE_WORDS:
                holders.setdefault((s, ascii_lower(" ".join(w))), {}).setdefault(t, []).append(i if i is not None else -1)
    n_docs = {k: len(v) if distinct == "texts" else sum(map(len, v.values())) for k, v in holders.items()}
    gone = {k: min(v, key=lambda t: min(v[t])) if spare_first else object() for k, v in holders.items() if n_docs[k] > max_docs}
    out = []
    for i, t, s in rows:
        t = t or ""
        n, *rest = brute_counts(t)
        failed = n < 50 or 100 * rest[-1] > 50 * n
        cut = [x for x in t.split("\n") if gone.get((s, ascii_lower(" ".join(WORD.findall(x)))), t) != t]
        lost = sum(len(WORD.findall(x)) for x in cut)
        left = "\n".join(x for x in t.split("\n") if gone.get((s, ascii_lower(" ".join(WORD.findall(x)))), t) == t)
        out.append((i, (n, *rest), failed, not failed and not 100 * (n - lost) < quality.MIN_LEFT * n, left))
    return out


def common(spark):
    """40 texts that share a long line, of which some have little else, beside the hostile rows."""
    shared = "the Shared footer  line " + " ".join(f"w{i}" for i in range(60))
    texts = [f"{prose(70 if i % 2 else 4)}\n{shared}" for i in range(120)]
    return spark.createDataFrame([(100 + i, t, None, "web" if i < 90 else None, 1, *["clash"] * 8) for i, t in enumerate(texts)], DOCS).unionByName(docs(spark))


@pytest.mark.parametrize("salt", [1, 7])
def test_quality(spark, monkeypatch, salt):
    monkeypatch.setattr(quality, "SALT", salt)
    df = common(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    want = brute_quality(rows)
    got = quality.judge(df).collect()
    assert sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept) for r in got), key=str) == sorted(((i, c, f, k) for i, c, f, k, _ in want), key=str)
    assert 0 < sum(not r.kept and not r.base_failed for r in got)
    left = quality.filtered(df)
    assert left.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == sorted([(i, t) for i, _, _, k, t in want if k], key=str)
    assert all(r[c] == "clash" for r in left.collect() for c in df.columns[5:])
    for how in ({"spare_first": True}, {"distinct": "rows"}, {"distinct": "rows", "spare_first": True}):
        want = brute_quality(rows, **how)
        assert sorted([(r.doc_id, r.text) for r in quality.filtered(df, **how).collect()], key=str) == sorted([(i, t) for i, _, _, k, t in want if k], key=str)
    assert quality.judge(none(spark)).count() == 0 and quality.filtered(none(spark)).count() == 0


def brute_fp(text):
    w = WORD.findall(ascii_lower(text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows):
    fps = [(i, brute_fp(t)) for i, t in rows]
    different = sorted({f for _, f in fps})
    root = {f: f for f in different}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for n, a in enumerate(different):
        for b in different[n + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(least.get(find(f), 1 << 60), i)
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in fps]


@pytest.mark.parametrize("chunk", [3, 1024])
def test_simhash(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    words = prose(300).split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(0, 300, 10)]
    df = docs(spark, TEXTS + near + [BASE] * 20)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = brute_classes(rows)
    got = [tuple(r) for r in simhash.classes(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(a > 1 for a in Counter(c for _, _, c in want).values())
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for _, _, c in want}, key=str)
    assert simhash.classes(none(spark)).count() == 0


def test_no_text_is_lost_to_a_shared_or_null_id(spark):
    apart = [prose(60) for _ in range(6)]
    data = [(None, t, None, "web", 1, *[f"{i}"] * 8) for i, t in enumerate(apart[:4])] + [(9, apart[4], None, "web", 1, *["x"] * 8), (9, apart[5], None, "web", 1, *["y"] * 8), (9, apart[5], None, "web", 1, *["y"] * 8), (12, apart[0], None, "web", 1, *["z"] * 8)]
    df = spark.createDataFrame(data, DOCS)
    kept = simhash.deduplicated(df.repartition(5)).collect()
    assert sorted(r.text for r in kept) == sorted(apart)
    assert {r.doc_id for r in kept if r.text == apart[0]} == {12}  # a row with an id goes before those without
    assert sorted(map(str, kept)) == sorted(map(str, simhash.deduplicated(df.repartition(3)).collect()))


def test_pigeonhole_blocks_cover_every_bit():
    assert [a + w for a, w in simhash.BLOCKS] == [*[b for b, _ in simhash.BLOCKS[1:]], 64] and len(simhash.KEYS) == 35


def test_links_of_random_fingerprints(spark):
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 60, dtype=np.int64)
    flips = [int(x) ^ sum(1 << int(b) for b in r.choice(63, n, replace=False)) for x in a for n in (3, 4, 5)]
    fps = [*map(int, a), *flips]
    from ledgerspark.llm.components import components

    got = {x.node: x.root for x in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    for x in range(len(fps)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= 4 and fps[x] != fps[y]:
                assert got[fps[x]] == got[fps[y]]
    assert all(got.get(int(x), int(x)) != got.get(f5, f5) or (int(x) ^ f5).bit_count() <= 4 or got[int(x)] == got[f5] for x, f5 in zip(a, flips[2::3], strict=True))


STEP, RANGE = 1327217885, 2**31


def brute_targets(rows):
    sizes = [(i, s, len(WORD.findall(t or "")), hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()) for i, t, s in rows]
    sources = sorted({s for _, s, _, _ in sizes}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n, _ in sizes if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, list(sources), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    return sizes, sources, size, target


def brute_mix(rows, block=None, step=STEP):
    """(doc_id, size, source_size, target, taken, n_slots, first_slot), by filling slot after slot with words."""
    sizes, sources, size, target = brute_targets(rows)
    need = {s: math.floor(target[s] + 1e-9) for s in sources}
    every = sum(need.values())
    block = block or max(1, min(1024, every // max(65536, 256 * len(sources))))
    stream = {s: [k for k, x in sorted(((k, x) for k, x in enumerate(sizes) if x[1] == s), key=lambda kx: (kx[1][3], kx[1][0] or 0, kx[1][2])) for _ in range(x[2])] for s in sources}
    edge, at = [], 0
    for s in sources:
        at += need[s]
        if need[s]:
            edge.append((math.floor(at / every * RANGE), s))
    rank, taken, slots = Counter(), Counter(), {}
    for slot in range(-(-every // block)):
        s = next(s for hi, s in edge if slot * step % RANGE < hi)
        for w in range(rank[s] * block, min((rank[s] + 1) * block, 2 * size[s])):
            k = stream[s][w % size[s]]
            taken[k] += 1
            slots.setdefault(k, set()).add((slot, w // size[s]))
        rank[s] += 1
    return [(i, n, size[s], round(target[s], 5), taken[k], len(slots.get(k, ())), min(slots[k])[0] if k in slots else None) for k, (i, s, n, _) in enumerate(sizes)]


def same_mix(df, **how):
    rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    want = sorted(brute_mix(rows, **how), key=str)
    got = mixing.mix(df, **how).select("doc_id", "size", "source_size", F.round("target", 5), "taken", "n_slots", "first_slot").collect()
    assert sorted([tuple(r) for r in got], key=str) == want
    return want


@pytest.mark.parametrize("block", [7, None])
def test_mix(spark, block):
    df = docs(spark, repeat=False)
    want = same_mix(df, block=block)
    out = mixing.mixed_documents(df, block=block)
    assert out.columns == df.columns
    taken = Counter()
    rows = out.collect()
    for r in rows:
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert r[5:] == ("clash",) * 8
    assert all(taken[i] == t for i, _, _, _, t, _, _ in want)
    assert all(t <= 2 * n for _, n, _, _, t, _, _ in want)
    # the mix stands in slot order: documents come in the order of the slots that take them first
    first = {w[0]: w[6] for w in want}
    met = list(dict.fromkeys(r.doc_id for r in rows))
    assert [first[i] for i in met] == sorted(first[i] for i in met)
    assert mixing.mix(none(spark)).count() == 0 and mixing.mixed_documents(none(spark)).count() == 0


def test_the_schedule_decides_the_mix(spark):
    df = docs(spark, repeat=False)
    a, b = same_mix(df, block=50), same_mix(df, block=50, step=3)
    assert sum(x[4] != y[4] for x, y in zip(a, b, strict=True)) > 3  # slots that crowd into one source take other words


def test_mix_of_a_hot_source_and_repeats(spark):
    data = [(i, prose(1 + i % 9), None, "hot" if i % 3 else f"s{i % 7}", None, *["clash"] * 8) for i in range(200)]
    same_mix(spark.createDataFrame(data, DOCS), block=16)
    twice = spark.createDataFrame(data[:20] * 2, DOCS)
    assert mixing.mix(twice).count() == 40


def test_sources_come_near_their_targets(spark, small):
    got = mixing.mix(spark.read.parquet(f"{small}/documents.parquet")).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) > 1 and all(abs(r.taken - r.target) <= 0.01 * r.target for r in got)


def test_schedule_follows_weights(spark):
    shares = spark.createDataFrame([("a", 3000.0), ("b", 1000.0), (None, 2000.0)], "source string, target double")
    got = [r for r in mixing.schedule(shares, block=10).collect()]
    assert sorted(r.slot for r in got) == list(range(600))  # each slot draws one source
    for s, n in (("a", 300), ("b", 100), (None, 200)):
        drawn = sorted((r.slot, r["rank"]) for r in got if r.source == s)
        assert [k for _, k in drawn] == list(range(len(drawn))) and abs(len(drawn) - n) <= 2
        assert max(y - x for (x, _), (y, _) in pairwise(drawn)) <= 4 * 600 / n  # low discrepancy: no long gaps
