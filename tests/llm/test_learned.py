import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerspark.llm import context_mixing, langid, lm, toxicity
from ledgerspark.llm.shared import stored

from .fixture_rows import DOCS, docs, none, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_learns_from_document_labels(spark):
    r = random.Random(1)
    data, labels = [], []
    for i in range(600):
        bad = r.random() < 0.3
        sentences = [prose(8, r) for _ in range(5)]
        if bad:
            sentences[r.randrange(5)] += f" {r.choice(['grudok', 'smefal', 'vrikta'])} {prose(2, r)}"
        data.append((i, ". ".join(sentences), None, "web", None, *["clash"] * 8))
        labels += [(i, None, int(bad) if i % 9 else None, "clash")]
    df, lab = spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string")
    got = toxicity.judge(df, lab).collect()
    truth = {x[0]: x[2] for x in labels}
    held = [g for g in got if g.held_out and truth[g.doc_id] is not None]
    assert all(g.held_out == (fold(g.doc_id, 4) == 2) for g in got) and len(got) == 600
    right = sum(g.predicted == truth[g.doc_id] for g in held)
    assert right / len(held) > 0.97
    text = {x[0]: x[1] for x in data}
    found = [text[g.doc_id][g.worst_start : g.worst_end] for g in held if g.predicted]
    assert sum(bool(re.search("grudok|smefal|vrikta", s)) for s in found) > 0.95 * len(found)


def test_toxicity_edges(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs(spark), lab).collect()
    assert len(got) == docs(spark).count() and all(0 <= g.score < 0.3 and g.predicted == 0 for g in got if g.doc_id in (1, 2, 3, 4))
    assert toxicity.judge(none(spark), lab).count() == 0


def test_noisy_or_of_sentences():
    theta = np.zeros(toxicity.SLOTS + 1, np.float32)
    theta[-1] = -1
    p = 1 / (1 + math.exp(1))
    score, *_ = toxicity.score_text("a. b! c\nd", toxicity.Weights(theta))
    assert abs(score - (1 - (1 - p) ** 4)) < 1e-6


LANGS = {"aa": "kalo mire tun sabe", "bb": "schtrum wegg zauft ich", "cc": "été où ça naïf"}


def test_language_id(spark):
    r = random.Random(2)
    data = [(i, " ".join(r.choice(LANGS[x].split()) for _ in range(12)), x if i % 11 else None, "web", None, *["clash"] * 8) for i in range(240) for x in [("aa", "bb", "cc")[i % 3]]]
    got = langid.label(spark.createDataFrame(data, DOCS), steps=60).collect()
    truth = {d[0]: ("aa", "bb", "cc")[d[0] % 3] for d in data}
    held = [g for g in got if g.held_out]
    assert len(got) == 240 and all(g.held_out == (fold(g.doc_id, 3) == 1) for g in got)
    assert sum(g.lang_pred == truth[g.doc_id] for g in held) > 0.97 * len(held)


def test_language_id_edges(spark):
    df = docs(spark).withColumn("lang", F.lit("xx"))
    got = langid.label(df, steps=2).collect()
    assert len(got) == df.count() and {g.lang_pred for g in got if g.doc_id in (1, 2, 3)} == {"und"} and all(0 <= g.score <= 1 for g in got)
    assert {g.lang_pred for g in langid.label(docs(spark), steps=2).collect()} == {"und"}
    assert langid.label(none(spark)).count() == 0


def test_backpropagation_through_time():
    net, r = langid.Network(3), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = r.integers(1, 255, (9, 4)).astype(np.uint8), np.array([0, 1, 2, 0])
    g = net.gradients(x, y)

    def loss():
        p = net.probabilities(x)
        return -np.mean(np.log(p[:, y, np.arange(4)]))

    for k in ("V", "c", "Uf", "Ub", "Ef", "Eb"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was = net.p[k][i]
        net.p[k][i] = was + 1e-3
        up = loss()
        net.p[k][i] = was - 1e-3
        down = loss()
        net.p[k][i] = was
        assert abs((up - down) / 2e-3 - g[k][i]) < 2e-3 * max(1, abs(g[k][i])) + 1e-3


def brute_base(rows):
    tokens = {k: [*WORD.findall(lower(t or "")), None] for k, (i, t) in enumerate(rows)}
    c = Counter(w for k, (i, _) in enumerate(rows) if i is None or fold(i, 10) for w in tokens[k])
    n, v = sum(c.values()), len(c)
    return [(i, len(tokens[k]), sum(c[w] > 0 for w in tokens[k]), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[k]), 4)) for k, (i, _) in enumerate(rows)]


def test_lm_base_score(spark):
    df = docs(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = lm.scores(df, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, words=20).collect()  # few words: most go through the join
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got], key=str) == sorted(brute_base(rows), key=str)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert all(bool(r.held_out) == (r.doc_id is not None and fold(r.doc_id, 10) == 0) for r in got)
    assert lm.scores(none(spark), F.lit(False)).count() == 0


def test_lm_learns_order(spark):
    r = random.Random(5)
    follow = {w: [f"w{r.randrange(60)}" for _ in range(2)] for w in (f"w{k}" for k in range(60))}

    def text():
        out = ["w0"]
        while len(out) < 80:
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    df = spark.createDataFrame([(i, text(), None, "web", None, *["clash"] * 8) for i in range(300)], DOCS)
    got = [g for g in lm.scores(df, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect() if g.held_out]
    assert sum(g.score for g in got) > 0.55 * sum(g.base_score for g in got)  # two ways on from each word: about 1 bit against 6


def test_tree_is_a_proper_code():
    t = context_mixing.Tree([5, 1, 1, 9, 3])
    assert abs(sum(2.0**-n for n in t.length) - 1) < 1e-12


def test_tree_paths_lead_to_their_symbols():
    t = context_mixing.Tree([5, 1, 1, 9, 3], base=7)
    paths = [tuple(zip(t.node[a : a + n].tolist(), t.bit[a : a + n].tolist(), strict=True)) for a, n in zip(t.first, t.length, strict=True)]
    assert len({tuple(b for _, b in p) for p in paths}) == 5 and {p[0][0] for p in paths} == {7 + 3}  # all from the root
    assert {n for p in paths for n, _ in p} == {7, 8, 9, 10}


def test_lm_model_grows_with_the_tokens():
    assert (lm.dictionary_size(1000), lm.table_bits(1000)) == (65_536, 22)
    for n in (1 << 28, 1 << 30, 3_000_000_000):
        assert lm.dictionary_size(4 * n) >= 1.99 * lm.dictionary_size(n) > 2 * 65_536
        assert lm.table_bits(4 * n) == lm.table_bits(n) + 1 and 32 * lm.dictionary_size(n) <= 1 << lm.table_bits(n) < 64 * lm.dictionary_size(n)
    code = context_mixing.Code([(b"a", 9), (b"b", 5)], 1, 1, np.ones(256), 24)
    assert all(len(t) == 2 << 24 for t in context_mixing.Counts(code).own)


def test_words_are_split_at_ascii_white_space_only():
    texts = [None, "", " A b\x0b\x0cC  d\x1ce\x85f\xa0g h\t\n\ri\x1fj ", "É x", " \n"]
    words, sizes = context_mixing.split_texts(texts)
    want = [WORD.findall(lower(t or "")) for t in texts]
    assert words.to_pylist() == [w.encode() for ws in want for w in ws] and sizes.tolist() == list(map(len, want))


def test_a_path_has_its_slots_side_by_side():
    r = np.random.default_rng(2)
    code = context_mixing.Code([(f"w{k}".encode(), int(n)) for k, n in enumerate(r.integers(1, 500, 300))], 3, 2, np.ones(256), 16)
    every = np.arange(len(code.length))
    paths = code.paths(every)
    slots = paths.slots(np.full(len(every), 9, np.uint32))
    of = {}
    for node, s in zip(code.node[paths.at].tolist(), slots.tolist(), strict=True):
        assert of.setdefault(node, s) == s  # one slot for a node, whichever symbol's path it is met on
    assert len(set(of.values())) > 0.98 * len(of)
    lo = np.cumsum(paths.n) - paths.n
    assert all(len({s >> 4 for s in slots[a + k : a + min(k + 4, n)]}) == 1 for a, n in zip(lo, paths.n, strict=True) for k in range(0, n, 4))


def test_lm_larger_tables_score_alike(spark, monkeypatch):
    df, held = docs(spark).select("doc_id", "text"), F.lit(False)
    small = {(r.doc_id, r.n_tokens): r.score for r in lm.scores(df, held).collect()}
    monkeypatch.setattr(lm, "table_bits", lambda tokens: 24)
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.scores(df, held).collect()}
    assert got.keys() == small.keys() and all(abs(got[k] - small[k]) < 0.05 * abs(small[k]) + 1 for k in got)


def small_model():
    r = np.random.default_rng(3)
    code = context_mixing.Code([(w.encode(), 9 - k) for k, w in enumerate("abcdefgh")], 3, 2, np.ones(256), 12)
    model = context_mixing.Model(code, context_mixing.packed([r.integers(0, 9, 2 << 12).astype(np.uint32) for _ in range(context_mixing.CONTEXTS)]))
    model.refine = r.normal(0, 0.3, model.refine.shape).astype(np.float32)
    docs = [[r.choice(list("abcdefgz")).encode() for _ in range(n)] for n in (0, 60, 3, 300, 127, 1, 60)]
    return model, docs


def given(docs):
    return pa.array([w for d in docs for w in d], pa.large_binary()), np.array([len(d) for d in docs], np.int64)


def one_by_one(model, doc):
    """A text's score, decision after decision, by loops."""
    b, own, seen, table, total = context_mixing.Batch(given([doc]), model.code), np.zeros(context_mixing.CONTEXTS), context_mixing.WARM, {}, 0.0
    k = 0
    while k < len(b.symbols):
        upto = k + min(64, 1 + k // 64)
        n, gate, x, kind, bit = model.inputs([s[k:upto] for s in b.seeds], b.symbols[k:upto], False)
        steps, moved = [], np.zeros(context_mixing.CONTEXTS)
        for j in range(int(n.sum())):
            z = float(model.weights[gate[j], -1] + (model.weights[gate[j], :-1] + own) @ x[:, j])
            cell = kind[j], int(model.bucket(np.array([z], np.float32))[0])
            fine = z + model.refine[cell] + table.get(cell, 0.0)
            total += math.log(1 / (1 + math.exp(-fine if bit[j] else fine)))
            moved += (bit[j] - 1 / (1 + math.exp(-z))) * x[:, j]
            steps.append((cell, context_mixing.REFINE * (bit[j] - 1 / (1 + math.exp(-fine)))))
        own += context_mixing.RATE / math.sqrt(context_mixing.WARM * seen) * moved
        seen += int(n.sum())
        k = upto
        for cell, up in steps:
            table[cell] = table.get(cell, 0.0) + up
    return total / math.log(10)


def test_corrections_are_refined_after_every_symbol(monkeypatch):
    model, docs = small_model()
    got, _ = model.score(given(docs))
    assert all(abs(a - one_by_one(model, d)) < 2e-3 * max(1, abs(a)) for a, d in zip(got, docs, strict=True))
    assert np.allclose(got, [model.score(given([d]))[0][0] for d in docs], rtol=1e-5)  # texts do not see one another
    monkeypatch.setattr(context_mixing, "RATE", 0.0)
    weights_only = model.score(given(docs))[0]
    monkeypatch.setattr(context_mixing, "REFINE", 0.0)
    frozen = model.score(given(docs))[0]
    short = [1, 4, 6]  # 60 and 127 words
    assert all(abs(got[k] - frozen[k]) > 0.01 and abs(weights_only[k] - frozen[k]) > 1e-3 for k in short)


def test_scores_of_all_texts_of_a_length_add_up_to_one():
    """A proper distribution: over every text of up to n known words and an end, and those that go on."""
    model, _ = small_model()
    symbols = [w.encode() for w in "abcdefgh"]
    one, two = [[]], [[a] for a in symbols]
    three = [[a, b] for a in symbols for b in symbols]
    ended = [sum(10.0 ** model.score(given(x))[0]) for x in (one, two, three)]
    # what does not end after two words goes on with a third one: with the escape, the open rest
    b = context_mixing.Batch(given([[*t, w] for t in three for w in (*symbols, b"zz")]), model.code)
    assert b.size.max() == 4
    prefix = []
    for t in [[*t, w] for t in three for w in (*symbols, b"zz")]:
        whole = 10.0 ** model.score(given([t]))[0][0]
        last = 10.0 ** (one_by_one(model, t) - one_by_one_upto(model, t, len(t)))
        prefix.append(whole / last)
    escaped = [10.0 ** one_by_one_upto(model, [*t, b"zz"], len(t) + 1) for t in [*one, *two]]
    assert abs(sum(ended) + sum(prefix) + sum(escaped) - 1) < 2e-3


def one_by_one_upto(model, doc, symbols):
    """log10 probability of a text's first symbols."""
    b = context_mixing.Batch(given([doc]), model.code)
    keep, context_mixing.Batch = context_mixing.Batch, lambda *_: type("", (), {"symbols": b.symbols[:symbols], "seeds": [s[:symbols] for s in b.seeds]})
    try:
        return one_by_one(model, doc)
    finally:
        context_mixing.Batch = keep


def test_noisy_or_by_hand():
    r = np.random.default_rng(1)
    theta = r.normal(0, 1, toxicity.SLOTS + 1).astype(np.float32)
    text = "One word here. Ünd zwei! Three four five?\n\nsix 7 eight_nine"
    got = toxicity.score_text(text, toxicity.Weights(theta))
    ps = []
    for s in re.split(r"[.!?\n]", text.lower()):
        if s:
            words = set(re.findall(r"[^\W\d_]+", s))
            feats = [f for w in words for f in [w, *(w[:k] + "*" for k in (4, 5, 6, 7) if len(w) > k)]]
            ps.append(1 / (1 + math.exp(-(float(theta[-1]) + sum(float(theta[zlib.crc32(f.encode()) & (toxicity.SLOTS - 1)]) for f in feats)))))
    assert abs(got[0] - (1 - math.prod(1 - p for p in ps))) < 1e-6 and abs(got[3] - max(ps)) < 1e-6
    assert len(got[4]) == sum(p >= toxicity.OFFENDS for p in ps)


def test_pooled_probabilities_are_means_over_positions():
    net = langid.Network(5, seed=2)
    texts = ["short", "x" * 300 + " end", "", "Ünï côdé " * 40]
    got = langid.pooled(texts, net)
    for t, row in zip(texts, got, strict=True):
        raw = t.encode().lower()
        total = np.zeros(5)
        for at in range(0, len(raw), langid.WINDOW):
            piece = raw[at : at + langid.WINDOW]
            p = net.probabilities(np.frombuffer(piece.ljust(langid.WINDOW, b"\0"), np.uint8)[:, None].copy())
            total += p[: len(piece), :, 0].sum(0)
        assert np.allclose(row, total / max(len(raw), 1), atol=1e-5)


def test_letters_are_those_of_isalpha(spark):
    assert not any(map(langid.has_letter, (None, "", "½ ² Ⅷ 12 _", "\U0001f600"))) and langid.has_letter("½é")


def test_lm_weights_come_from_every_training_text_and_word(spark):
    """More texts and words than a sample would hold, one text longer than any prefix, in several tasks."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(9000)}" for _ in range(40)) for _ in range(700)] + ["ab cd " * 100_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    counts = stored(lm.word_counts(df.withColumn("held_out", F.lit(False))))
    model, _ = lm.fitted(df, counts, words=50)
    code = model.code
    b = context_mixing.Batch(context_mixing.split_texts(texts), code)
    words = {w.encode() for t in texts for w in (t or "").split()} - {w.as_py() for w in code.words}
    spelled = context_mixing.Spelling(sorted(words), code)
    assert len(words) > 8000 and len(b.symbols) > 200_000
    half = context_mixing.GATES // 2
    assert [model.learned[:half].sum(), model.learned[half:].sum()] == [code.length[x.symbols].sum() for x in (b, spelled)]


def test_lessons_of_tasks_add_up_by_decisions():
    r = np.random.default_rng(4)
    model, _ = small_model()
    learnt = []
    for n in (300, 5000):
        t = context_mixing.Lessons()
        gate, x, bit = r.integers(0, 3, n), r.normal(0, 2, (context_mixing.CONTEXTS, n)).astype(np.float32), r.integers(0, 2, n).astype(np.uint8)
        t.learn(gate, x, np.zeros(n, np.int16), bit)
        learnt.append((np.bincount(gate, minlength=context_mixing.GATES), t))
    model.fit(sum(t.sent() for _, t in learnt))
    (a, s), (b, t) = learnt
    met = (a + b) > 0
    assert (model.learned == a + b).all() and met.sum() == 3
    assert np.allclose(model.weights[met], ((a[:, None] * s.weights + b[:, None] * t.weights)[met] / (a + b)[met, None]), atol=1e-5)
    assert np.array_equal(model.weights[~met], context_mixing.first_weights()[~met])


def test_a_part_is_predicted_before_it_is_counted():
    _, docs = small_model()
    code = context_mixing.Code([(w.encode(), 9 - k) for k, w in enumerate("abcdefgh")], 3, 2, np.ones(256), 12)
    b = context_mixing.Batch(given(docs), code)
    c = context_mixing.Counts(code)
    levels = []
    c.lessons[1].learn = lambda gate, x, kind, bit: levels.append((len(gate), int(gate.max()), float(np.abs(x[1:]).max())))
    c.add(b, 200)
    assert levels[0][1:] == (0, 0.0) and all(top > 0 and odds > 0 for _, top, odds in levels[1:]) and len(levels) == -(-len(b.symbols) // 200)
    decisions = code.length[b.symbols].sum()
    assert sum(n for n, _, _ in levels) == decisions
    assert [int(t.sum()) for t in c.tables()] == [decisions] * context_mixing.CONTEXTS


def test_lm_weights_do_not_depend_on_the_order_of_counted_words(spark):
    df = docs(spark).select("text").coalesce(1)
    counts = lm.word_counts(df.withColumn("held_out", F.lit(False)))
    one, other = (lm.fitted(df, stored(counts.repartition(n, "word").sortWithinPartitions(by)), words=20)[0] for n, by in ((3, F.col("word").asc()), (7, F.col("n").desc())))
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.refine, other.refine)


def test_unpickled_arrays_are_as_quick_as_new_ones():
    """Unpickled arrays have types of their own, for which ufunc.at takes some twenty times as long; these went on into what tasks made of them."""
    model, _ = small_model()
    for x in (model, model.code):
        arrays = [a for a in vars(pickle.loads(pickle.dumps(x))).values() if isinstance(a, np.ndarray)]
        assert arrays and all(a.dtype is np.dtype(a.dtype.type) for a in arrays)


def test_lessons_in_order_of_gates_are_those_of_plain_sums():
    r = np.random.default_rng(9)
    n, cells = 4000, context_mixing.DEPTHS * context_mixing.BUCKETS
    gate, kind, bit = r.integers(0, 128, n).astype(np.int8), r.integers(0, context_mixing.DEPTHS, n).astype(np.int16), r.integers(0, 2, n).astype(np.int16)
    x = r.normal(0, 2, (context_mixing.CONTEXTS, n)).astype(np.float32)
    t, first = context_mixing.Lessons(), context_mixing.first_weights()
    t.step = 79  # one turn
    t.learn(gate, x, kind, bit)
    z = (first[gate, :-1] * x.T).sum(1) + first[gate, -1]
    err = bit - 1 / (1 + np.exp(-z))
    want = np.stack([np.bincount(gate, err * a, context_mixing.GATES) for a in (*x, np.ones(n))], 1) / (np.bincount(gate, minlength=context_mixing.GATES)[:, None] + 50)
    assert np.allclose(t.m, 0.2 * want, atol=1e-6)
    cell = kind.astype(int) * context_mixing.BUCKETS + context_mixing.Model.bucket(z.astype(np.float32))
    assert np.abs(t.cells[0] - np.bincount(cell, minlength=cells)).sum() <= 4 and t.cells[0].sum() == n and t.cells[1].sum() == bit.sum()
    assert np.allclose(t.cells[2].sum(), z.sum(), rtol=1e-4)


def test_few_spellings_are_counted_by_few_tasks(spark):
    """A task that counts spellings has tables of its own, so a small corpus gets one, however many partitions a shuffle has."""
    df = docs(spark).select("text").coalesce(1)
    counts = stored(lm.word_counts(df.withColumn("held_out", F.lit(False))))
    dealt, keep = [], lm.table_counts

    def noted(rows, code, spelled):
        dealt.append(rows.rdd.getNumPartitions())
        return keep(rows, code, spelled)

    lm.table_counts = noted
    try:
        lm.fitted(df, counts, words=20)
    finally:
        lm.table_counts = keep
    assert dealt[1] == 1
