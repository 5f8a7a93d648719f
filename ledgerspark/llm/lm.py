"""Language-model scoring of documents by context mixing, beside a unigram base score.

Two passes over the training texts and one over all: words are counted (map-side in Arrow, then one
aggregation by word); each task counts its texts' decisions, and its distinct words' spellings, in the model's
hashed tables, and the tables are added up range by range; every text is then scored in its own task. The
model grows with the N training tokens: its dictionary has ``dictionary_size(N)`` words, 8 sqrt(N) and ``WORDS``
at least (distinct words grow about so), and each of its CONTEXTS tables 2 ** ``table_bits(N)`` slots, 32 for each
word of the dictionary and 2 ** BITS at least. So memory of a task grows as sqrt(N); both are filled from all training
texts. Weights are learned from all training texts and all their words' spellings while these are counted, each part
from what its task had counted before it, and are the tasks' mean by decisions; each text then refines them for itself. Words outside the dictionary meet the full word counts in a join, where each
distinct one has been spelled once: such a word's probability is the mean of its share of all such words
(weighted by what is not taken by words seen once) and its spelling.

Defined results: null and empty texts are one end; repeated rows each get a row and count each; without
training texts every base score is 0 and the model is its prior; no rows give no rows; a null id is never
held out; extra columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context_mixing import BITS, CONTEXTS, Batch, Code, Counts, Model, Spelling, Texts, filled, packed, split_texts, squeezed
from .shared import partitions, small_batches, stored

WORDS = 65_536
END = b"\n"
RANGE = 1 << 16  # slots that one row of a table holds
AT_ONCE = 1 << 22  # characters of text that are counted or scored together
WORDS_AT_ONCE, MERGED = 1 << 14, 1 << 20  # words in a batch, and counts that a task holds before it merges them
COUNTED = pa.schema([("word", pa.binary()), ("n", pa.int64())])
SPELT = 1 << 18  # words, about, whose spellings a task counts: each task has tables of its own
DEALT = 16  # parts below zero hold lessons, dealt by task
BYTES, TOTAL, DISTINCT, ENDS, SINGLE = 256, 256, 257, 258, 259  # keys of the totals, after those of bytes


def dictionary_size(tokens: int) -> int:
    return max(WORDS, 8 * math.isqrt(tokens))


def table_bits(tokens: int) -> int:
    """32 slots for each word of the dictionary, 2 ** BITS at least; a slot's number fits into a hash of 32 bits for any number of tokens that a long holds."""
    return min(31, max(BITS, (32 * dictionary_size(tokens) - 1).bit_length()))


def some(texts: pa.Array, most: int = AT_ONCE) -> Iterator[tuple[int, Texts]]:
    """Runs of texts of about ``most`` bytes: how many there are, and their words."""
    every = pc.fill_null(texts.cast(pa.large_string()), "")
    cuts = np.flatnonzero(np.diff(np.cumsum(pc.binary_length(every).to_numpy(zero_copy_only=False) + 1) // most)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(every)], strict=True):
        if hi > lo:
            yield hi - lo, split_texts(every[lo:hi])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): every word of texts (text, held_out) and its count where held_out is false; the ends are under END."""

    def summed(parts: list[pa.Table]) -> pa.Table:  # in one thread: each of Arrow's threads keeps memory of its own
        return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for b in batches:
            for learned in (True, False):
                own = b.filter(pc.equal(b["held_out"], not learned))["text"]
                for run, (words, _) in some(own):
                    met = words.value_counts()
                    n = met.field("counts") if learned else pa.array(np.zeros(len(met), np.int64))
                    parts.append(pa.table({"word": met.field("values"), "n": n}))
                    if learned:
                        parts.append(pa.table({"word": pa.array([END], pa.large_binary()), "n": pa.array([run], pa.int64())}))
                    rows += len(met)
            if rows > MERGED:
                parts = [summed(parts)]
                if (rows := parts[0].num_rows) > MERGED // 2:
                    yield from parts[0].cast(COUNTED).to_batches(WORDS_AT_ONCE)
                    parts, rows = [], 0
        if parts:
            yield from summed(parts).cast(COUNTED).to_batches(WORDS_AT_ONCE)
        parts.clear()
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return small_batches(texts).select("text", "held_out").mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def totals(counts: DataFrame) -> np.ndarray:
    """By key: each byte in the spellings of known words, with a stop after each word; TOTAL, DISTINCT, ENDS, SINGLE."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(SINGLE + 1, np.int64)
        for b in batches:
            b = b.filter(pc.greater(b["n"], 0))
            word = pc.not_equal(b["word"], END)
            own, n = b.filter(word), b["n"].to_numpy()
            out[:BYTES] += np.bincount(np.frombuffer(b"".join(own["word"].to_pylist()), np.uint8), minlength=BYTES)
            out[ord(" ")] += own.num_rows
            single = int(np.count_nonzero(own["n"].to_numpy() == 1))
            out[[TOTAL, DISTINCT, ENDS, SINGLE]] += n.sum(), len(n), n.sum() - own["n"].to_numpy().sum(), single
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], names=["key", "n"])

    out = np.zeros(SINGLE + 1, np.int64)
    for r in counts.mapInArrow(each, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        out[r.key] = r.n
    return out


def table_rows(tables: list[np.ndarray]) -> Iterator[tuple]:
    """(part, low, at, rest), squeezed: a range's counters as bytes, and what is above a byte by place; few counters go by place only."""
    for k, t in enumerate(tables):
        for r in range(len(t) // (2 * RANGE)):
            own = t[2 * r * RANGE : 2 * (r + 1) * RANGE]
            at = np.flatnonzero(own)
            if not len(at):
                continue
            if 8 * len(at) < len(own):
                low, rest = own[:0].astype(np.uint8), own[at]
            else:
                low, at = (own & 255).astype(np.uint8), np.flatnonzero(own > 255)
                rest = own[at] & ~np.uint32(255)
            yield k * (len(t) // (2 * RANGE)) + r, squeezed(low), squeezed(np.diff(at, prepend=0).astype("<u4")), squeezed(rest.astype("<u4"))


def unknown(words: pa.Array, code: Code) -> tuple[list[bytes], np.ndarray]:
    """Those of words (binary) that are not in the dictionary, and where they stand."""
    every = words.cast(pa.large_binary())
    at = np.flatnonzero(code.ids(every) < 0)
    return every.take(pa.array(at)).to_pylist(), at


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 8 * WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Small batches put together to about ``rows`` rows: a dictionary look-up hashes the whole dictionary first."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def parts_of(words: list[bytes], size: int = WORDS_AT_ONCE) -> Iterator[list[bytes]]:
    for at in range(0, len(words), size):
        yield words[at : at + size]


def table_counts(rows: DataFrame, code, spelled: bool) -> DataFrame:
    """Each task's tables of rows (text; or word, if spelled), a row for each range that has counts, and its lessons; code: a broadcast Code."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, schema = None, pa.schema([("part", pa.int32()), ("low", pa.binary()), ("at", pa.binary()), ("rest", pa.binary())])
        for b in gathered(batches) if spelled else batches:
            if not len(b):
                continue
            c = c or Counts(code.value)
            if spelled:
                for words in parts_of(unknown(b["word"], c.code)[0]):
                    c.add(Spelling(words, c.code))
            else:
                for _, words in some(b["text"]):
                    c.add(Batch(words, c.code))
        if c:
            lessons = (-1 - TaskContext.get().partitionId() % DEALT, squeezed(c.lessons[not spelled].sent()), b"", b"")
            for row in (*table_rows(c.tables()), lessons):
                yield pa.RecordBatch.from_arrays([pa.array([a], f.type) for a, f in zip(row, schema, strict=True)], schema=schema)

    return rows.mapInArrow(each, "part int, low binary, at binary, rest binary")


def table_sums(rows: DataFrame) -> DataFrame:
    """(part, full): each range added up and packed; lessons added up."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            for part, low, at, rest in zip(f["part"], f["low"], f["at"], f["rest"], strict=True):
                if part < 0:
                    sums[part] = sums.get(part, 0.0) + filled(low, np.float64)
                    continue
                t = sums.setdefault(part, np.zeros(2 * RANGE, np.int64))
                if len(low := filled(low, np.uint8)):
                    t += low
                t[np.cumsum(filled(at, "<u4"))] += filled(rest, "<u4")
        for part, t in sums.items():
            yield pd.DataFrame([(part, squeezed(t if part < 0 else packed([t])[0]))], columns=["part", "full"])

    # CONTEXTS * 2 ** bits / RANGE ranges in all
    return rows.repartition(2 * partitions(rows.sparkSession), "part").mapInPandas(each, "part int, full binary")


def fitted(texts: DataFrame, counts: DataFrame, words: int | None = None) -> tuple[Model, dict]:
    """The model and the corpus totals; texts: text to learn from; counts: their words and n, stored."""
    sc = texts.sparkSession.sparkContext
    known = counts.filter((F.col("n") > 0) & (F.col("word") != F.lit(END)))
    every = totals(counts)
    total, distinct, ends, single = (int(n) for n in every[BYTES:])
    words, bits = dictionary_size(total) if words is None else words, table_bits(total)
    size = 1 << bits
    top = known.orderBy(F.desc("n"), "word").limit(words).toLocalIterator()  # so that executors merge the tasks' shares
    top = [(bytes(r.word), r.n) for r in top]
    rare = total - ends - sum(n for _, n in top)
    unseen = (single - sum(n == 1 for _, n in top)) / rare if rare else 1.0
    code = Code(top, rare, ends, every[:BYTES], bits)
    full, lessons = [np.zeros(size, np.int16) for _ in range(CONTEXTS)], 0.0
    coded = sc.broadcast(code)
    # lessons depend on the order of words, which is the same in each run
    tasks = min(partitions(texts.sparkSession), 1 + distinct // SPELT)
    shuffled = known.select("word").repartition(tasks, "word").sortWithinPartitions(F.xxhash64("word"), "word")
    counted = table_counts(small_batches(texts).select("text"), coded, False).unionByName(table_counts(shuffled, coded, True))
    for r in stored(table_sums(counted)).toLocalIterator():  # a part at a time: the tables are large
        if r.part < 0:
            lessons = lessons + filled(r.full, np.float64)
            continue
        k, at = divmod(r.part, size // RANGE)
        full[k][at * RANGE : (at + 1) * RANGE] = filled(r.full, np.int16)
    model = Model(code, full)
    if np.ndim(lessons):
        model.fit(lessons)
    seen = {"train_tokens": total, "distinct": distinct, "ends": ends, "rare": rare, "top": [n for _, n in top], "seen_share": min(max(1 - unseen, 0.0), 0.98)}
    return model, seen


def scores(docs: DataFrame, held: Column, words: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs."""
    sc = docs.sparkSession.sparkContext
    marked = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    learned = marked.filter(~F.col("held_out")).select("doc_id", "text")
    counts = stored(word_counts(marked))
    model, seen = fitted(learned, counts, words)
    n_all, n_distinct, rare, share = seen["train_tokens"], seen["distinct"], seen["rare"], seen["seen_share"]
    base = n_all + 0.1 * (n_distinct + 1)
    # by symbol: dictionary words, escape (its words are added later), end, and the start, which comes last
    logs = np.append(np.log10((np.array([*seen["top"], 0, seen["ends"]], float) + 0.1) / base), 0.0)
    logs[len(seen["top"])] = 0.0
    shared = sc.broadcast((model, logs, bool(seen["ends"])))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs, ends = shared.value
        row = TaskContext.get().partitionId() << 40
        for f in batches:
            done = 0
            for n, words in some(f["text"]):
                total, b = model.score(words)
                tok = b.tokens.copy()
                tok[tok < 0] = len(logs) - 1  # starts, and unknown words, which the join adds
                known = ((tok >= 0) & (tok < model.code.escape)) | ((tok == model.code.end) & ends)
                base = np.add.reduceat(logs[tok], b.token_start)
                n_known = np.add.reduceat(known.astype(np.int64), b.token_start)
                edges = np.searchsorted(b.unknown_text, np.arange(n + 1))
                letters = np.append(0, np.cumsum(pc.binary_length(words[0]).to_numpy(zero_copy_only=False)))
                upto = np.append(0, np.cumsum(words[1]))
                own = f.slice(done, n)
                done += n
                out = {
                    "row": row + np.arange(n), "doc_id": own["doc_id"], "held_out": own["held_out"],
                    "n_tokens": words[1] + 1, "n_bytes": letters[upto[1:]] - letters[upto[:-1]] + words[1] + 1,
                    "n_known": n_known, "base": base, "total": total, "rest": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), b.unknown.cast(pa.binary())),
                }
                yield pa.RecordBatch.from_pydict(out)
                row += n

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value[0]
        for b in gathered(batches):
            own, at = unknown(b["word"], model.code)
            logs = [model.spell(part) for part in parts_of(own)]
            out = {"word": pa.array(own, pa.binary()), "n": b["n"].take(pa.array(at)), "spelled": np.concatenate([np.zeros(0), *logs])}
            yield pa.RecordBatch.from_pydict(out)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, total double, rest array<binary>"
    first = stored(small_batches(marked).mapInArrow(each, schema))
    spelled = counts.filter(F.col("word") != F.lit(END)).mapInArrow(spell, "word binary, n long, spelled double")
    met = first.select("row", F.explode("rest").alias("word")).join(spelled, "word")
    c, alone = F.col("n"), F.lit(math.log10(1 - share)) + F.col("spelled")
    mixed = F.when(c > 0, F.log10(F.lit(share / max(rare, 1)) * c + F.pow(F.lit(10.0), F.greatest(alone, F.lit(-300.0))))).otherwise(alone)
    per = met.groupBy("row").agg(F.sum(F.log10((c + 0.1) / F.lit(base))).alias("base_rest"), F.sum(mixed).alias("score_rest"), F.count_if(c > 0).alias("known_rest"))
    out = first.drop("rest").join(per, "row", "left")
    total = F.col("total") + F.coalesce("score_rest", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"), total.alias("score"), (-total / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
