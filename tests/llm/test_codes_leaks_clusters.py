"""op11, op12 and op13 against plain Python, on hostile rows and on the SQL twins' tables."""

import hashlib
import re

import numpy as np
import pytest

from ledgerspark.llm import heap_lloyd, weighted_lloyd, winnowing
from ledgerspark.llm.lattice import bound, squared

from .fixture_rows import docs, none, prose

VECTORS = "vec_id long, embedding array<float>, label int, v string, x string, cluster string, weight string"
NAN, INF = float("nan"), float("inf")


def vectors(spark, x, repeat=(), odd=True):
    rows = [(i, list(map(float, v)), int(i) % 3 if i % 7 else None) for i, v in enumerate(x)]
    rows += [rows[i] for i in repeat]
    if odd:
        rows += [(900, None, 1), (901, [NAN] * len(x[0]), 1), (902, [None, *[0.0] * (len(x[0]) - 1)], 1), (903, [INF, *[0.0] * (len(x[0]) - 1)], 2), (None, list(map(float, x[0])), None)]
    return rows, spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], VECTORS).repartition(3)


def kept(rows, scale):
    """(vec_id, label, integer vector) of rows that take part, by id, then vector, null ids last."""
    ok = [(i, lab, [int(np.floor(scale * float(np.float32(a)))) for a in v]) for i, v, lab in rows if v is not None and all(a is not None and np.isfinite(a) for a in v)]
    return sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


def lloyd(x, c, rounds, weight=None):
    """Plain rounds of exact integers: final centroids, assignment, distances."""
    near = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(c)) for v in x]
    for _ in range(rounds):
        got = near()
        for j in range(len(c)):
            own = [v for v, (_, k) in zip(x, got, strict=True) if k == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return c, near()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    own = kept(rows, 256)
    width = max(1, -(-max(len(v) for *_, v in own) // parts))
    own = [(i, lab, v + [0] * (width * parts - len(v))) for i, lab, v in own]
    books, codes, error = [], [""] * len(own), [0] * len(own)
    for p in range(parts):
        x = [v[p * width : (p + 1) * width] for *_, v in own]
        c, got = lloyd(x, [list(v) for v in x[:entries]], rounds)
        books += [str(a) for e in c for a in e]
        for n, (d, j) in enumerate(got):
            codes[n], error[n] = codes[n] + f"{j:02x}", error[n] + d
    of = {}
    for (_, lab, _), e in zip(own, error, strict=True):
        of[lab] = of.get(lab, 0) + e
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    return sorted(((i, c, e, of[lab], sha) for (i, lab, _), c, e in zip(own, codes, error, strict=True)), key=str)


@pytest.mark.parametrize(("n", "dims", "block"), [(150, 32, 40), (70, 20, 1024), (3, 16, 8), (40, 3, 7)])
def test_codes(spark, n, dims, block):
    r = np.random.default_rng(n)
    x = (r.normal(0, 0.2, (n, dims)) + r.integers(-2, 3, (n, 1))).astype(np.float32)
    x[n // 2 :: 5] = x[1]  # a group of equal vectors
    rows, df = vectors(spark, x, repeat=(2, 2))
    got = sorted((tuple(g) for g in heap_lloyd.codes(df, block=block).collect()), key=str)
    assert got == plain_codes(rows)


def test_codes_of_vectors_of_different_lengths_and_sizes(spark):
    rows = [(1, [0.5, -0.25], 0), (2, [0.0], 0), (3, [], 1), (4, [-3.0, 2.0, 1.0], None), (4, [1.0, 2.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((tuple(g) for g in heap_lloyd.codes(df).collect()), key=str) == plain_codes(rows)
    huge = spark.createDataFrame([(1, [1e300] * 16, 0), (2, [-1e300] * 16, 0)], "vec_id long, embedding array<double>, label int")
    assert {g["error"] for g in heap_lloyd.codes(huge).collect()} == {0}
    assert heap_lloyd.codes(df.limit(0)).count() == 0 and heap_lloyd.codes(df.filter("false")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_heaps_leave_most_parts_alone(spark):
    """On clustered vectors far fewer parts are compared again than there are, with the codes of full comparisons."""
    r = np.random.default_rng(5)
    x = (r.integers(-8, 8, (64, 32))[np.arange(1280) % 64] + r.normal(0, 0.02, (1280, 32))).astype(np.float32)
    rows, df = vectors(spark, x, odd=False)
    state, books, popped = heap_lloyd.trained(df)
    assert popped[0] == 1280 * 16 and max(popped[1:]) < popped[0] / 2
    assert sorted((tuple(g)[:3] for g in heap_lloyd.coded(state, books).collect()), key=str) == [g[:3] for g in plain_codes(rows)]


def test_slack_never_keeps_a_wrong_entry():
    """Random walks of entries: what the heaps leave alone is what a full comparison gives."""
    r = np.random.default_rng(9)
    for entries in (1, 2, 9):
        x = r.integers(-40, 40, (300, 6)).astype(np.int32)
        entry = r.integers(-40, 40, (2, entries, 3))
        books = heap_lloyd.Books(entry, np.zeros((2, entries)), np.zeros((2, entries, 4), np.int64))
        code, key, heap, change, _ = heap_lloyd.rescanned(x, books)
        for _ in range(6):
            books = books.moved(change)
            code, key, heap, change, _ = heap_lloyd.rescanned(x, books, code, key, heap)
            for p in range(2):
                assert (code[p] == squared(x[:, 3 * p : 3 * p + 3].astype(np.int64), books.entry[p]).argmin(1)).all()
                n = np.bincount(code[p], minlength=entries)
                assert (books.total[p, :, 0] + change[p, :, 0] == n).all()


def test_distances_are_exact():
    top = bound(64)
    x = np.array([[top] * 64, [-top] * 64, [top - 1] * 64])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in x] for u in x]
    assert squared(x, x).astype(object).tolist() == want and max(map(max, want)) < 2**63


def plain_clusters(rows, k=16, dims=64):
    own = [(i, v) for i, _, v in kept(rows, 64) if len(v) == dims]
    place = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c, got = lloyd([v for _, v in own], [list(v) for _, v in sorted(own, key=place)[:k]], 3)
    per = {}
    for d, j in got:
        per[j] = per.get(j, 0) + d
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(own, got, strict=True)), key=str)


@pytest.mark.parametrize("n", [5, 120])
def test_clusters(spark, n, monkeypatch):
    monkeypatch.setattr(weighted_lloyd, "HEAVY", 4)  # the group of equal vectors is heavy, the others meet by a shuffle
    r = np.random.default_rng(n)
    x = r.normal(0, 1, (n, 64)).astype(np.float32)
    x[n // 2 :: 2] = x[0]
    rows, df = vectors(spark, x, repeat=(1, 1, 3))
    short = [(800, [1.0] * 63, 1), (801, [1.0] * 65, 1), (802, [], 1)]
    df = df.unionByName(spark.createDataFrame([(*s, *["clash"] * 4) for s in short], VECTORS))
    got = sorted((tuple(g) for g in weighted_lloyd.clusters(weighted_lloyd.quantised(df)).collect()), key=str)
    assert got == plain_clusters(rows)
    assert weighted_lloyd.clusters(weighted_lloyd.quantised(df.limit(0))).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_leaks(documents, items, span=10):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        n = min(len(w), span)
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in documents:
        w, hit, got = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    got |= windows[x]
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PASSAGE = prose(25)
ITEMS = [
    (1, PASSAGE), (2, PASSAGE.upper().replace(" ", " - ")), (2, "a second row of item two, which counts as the same item as its first one"), (10, "Short item: six words, no more!"),
    (11, "one"), (None, prose(12)), (12, None), (13, ""), (14, " \t--- !"), (15, "no no no no no no no no no no no no"), (16, "ÉCOLE école été"), (17, " ".join(PASSAGE.split()[5:17])),
]
LEAKY = [
    prose(30) + " " + PASSAGE + " " + prose(30), " ".join(PASSAGE.split()[:9]), " ".join(PASSAGE.split()[3:13]), PASSAGE.replace(" ", "\n\n"), "x " + " ".join(PASSAGE.split()[:14]) + " y " + " ".join(PASSAGE.split()[8:20]),
    "short ITEM six words, no more", "Short item: six words no", "no " * 40, "ÉCOLE école été", "école École été", "a\x00second\x7frow of item two which counts as the same item", prose(20_000) + " " + PASSAGE, "one",
]


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:1], ITEMS[5:8]])
def test_leaks(spark, items):
    df = docs(spark)
    more = spark.createDataFrame([(100 + i, t, None, "web", 1, *["clash"] * 8) for i, t in enumerate(LEAKY)] + [(100, LEAKY[0], None, "web", 1, *["clash"] * 8)] * 2, df.schema)
    df = df.unionByName(more)
    bench = spark.createDataFrame([(*x, "clash", "clash") for x in items], "item_id long, text string, doc_id string, words string")
    got = sorted((tuple(g) for g in winnowing.judge(df, bench).collect()), key=str)
    assert got == plain_leaks([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], items)


def test_leaks_of_nothing(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert winnowing.judge(none(spark), bench).count() == 0
    clean = winnowing.judge(docs(spark), bench.limit(0)).collect()
    assert len(clean) == docs(spark).count() and not any(r.contaminated or r.n_hit or r.n_items for r in clean)


@pytest.mark.parametrize("span", [1, 2, 3, 10, 17])
def test_shared_spans_share_a_kept_hash(spark, span):
    """Texts that share span words in a row keep a hash in common; a text keeps few of all."""
    common = prose(span)
    rows = [(str(i), plain_words(f"{prose(i)} {common} {prose(40)}")) for i in range(8)]
    df = spark.createDataFrame(rows, "key string, words array<string>")
    by = {}
    for r in winnowing.fingerprints(df, [span]).collect():
        by.setdefault(r.key, set()).add(r.hash)
    first, *others = by.values()
    assert all(first & o for o in others) and set.intersection(*by.values())
    if span == 10:
        assert sum(map(len, by.values())) < 0.5 * sum(len(w) for _, w in rows)
