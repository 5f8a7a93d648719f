"""Compression of vectors to codes, one byte for each of ``PARTS`` parts: codebooks by Lloyd's rounds with heaps.

Vectors become integers and are cut into parts; each part position has a codebook of its own. A row of the working table
is a block: up to ``BLOCK`` vectors of one partition, with the entry of each part, and its slack: how much nearer its
entry is than the next best, in plain distance, at the time it was last compared. When entries move, a part's slack shrinks by
the way of its own entry plus the longest way of any other. So each block keeps, for each entry, a heap of the
entry's parts keyed by slack plus the drift gathered till then; in the next round only parts are popped whose key the
drift since has reached, and only these are compared with all entries again, exactly, in integers. Other parts still
have the entry that a full comparison would give. A heap is laid down as its parts in order of key: popping is reading
its head.

A block's row also holds what its moved parts take from and give to each entry's count and sum. Spark adds these; the
driver holds the codebooks and their sums only (PARTS * entries rows). Each round writes the blocks to the shared
folder and goes on from there; blocks never leave their row, so nothing but the changes is shuffled.

Defined results: vectors that are null or hold a null or non-finite component are dropped; a vector shorter than the
longest, and a length that PARTS does not divide, counts as padded with zeros; repeated rows count once each;
null ids come last where the first entries are chosen, and among equal ids the smaller vector first; fewer vectors
than entries give as many entries; no vectors give no rows; components beyond lattice.bound(dims) count as that
bound; a label's error beyond 64 bits is null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import finite, floored, squared
from .shared import stored

PARTS, ENTRIES, BLOCK = 16, 64, 1024
BLOCKS = "ids array<long>, labels array<int>, x binary"
STATE = f"{BLOCKS}, code binary, key binary, heap binary, change array<long>, popped long"
CODED = "vec_id long, code string, error long, label int"


@dataclass
class Books:
    """entry: (parts, entries, width); drift: how far each entry's heap keys have been overtaken; total: count and sum of each entry's parts."""

    entry: np.ndarray
    drift: np.ndarray
    total: np.ndarray

    def moved(self, change: np.ndarray) -> Books:
        """After a round that changed the totals by ``change``; entries without parts stay."""
        total = self.total + change
        n = total[:, :, :1]
        entry = np.where(n > 0, total[:, :, 1:] // np.maximum(n, 1), self.entry).astype(np.int64)
        way = np.sqrt(((entry - self.entry).astype(float) ** 2).sum(2))
        two = np.sort(way, axis=1)[:, ::-1][:, :2]
        other = np.where(way == two[:, :1], two[:, -1:] if two.shape[1] > 1 else 0.0, two[:, :1])
        other = np.where((way == two[:, :1]).sum(1, keepdims=True) > 1, two[:, :1], other)
        return Books(entry, self.drift + (way + other) * (1 + 1e-9), total)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entry.reshape(-1).tolist())).encode()).hexdigest()


def blocks(vectors: DataFrame, dims: int, block: int) -> DataFrame:
    """Rows of up to ``block`` vectors (vec_id, label, v) of one partition."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                x = np.zeros((part.num_rows, dims), np.int32)
                lists = part.column("v")
                length = np.diff(lists.offsets.to_numpy())
                x[np.arange(dims) < length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"ids": pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), "labels": pa.array([part.column("label").to_pylist()], pa.list_(pa.int32())), "x": pa.array([x.tobytes()], pa.binary())})

    return vectors.mapInArrow(task, BLOCKS)


def compared(x: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, and its slack, rounded down."""
    d = squared(x, entry)
    near = d.argmin(1)
    at = np.arange(len(x))
    own = np.sqrt(d[at, near].astype(float))
    if len(entry) == 1:
        return near, np.full(len(x), np.inf)
    rest = d.astype(float)
    rest[at, near] = np.inf
    second = np.sqrt(rest.min(1))
    return near, second - own - 1e-9 * (second + own)


def heads(heap: np.ndarray, code: np.ndarray, key: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """The parts that are popped: of each entry's heap (heap: rows by entry, then key), those whose key its drift has reached."""
    edges = np.searchsorted(code[heap], np.arange(len(drift) + 1))
    out = []
    for e in np.flatnonzero(edges[1:] > edges[:-1]):
        run = heap[edges[e] : edges[e + 1]]
        if key[run[0]] <= drift[e]:
            out.append(run[: np.searchsorted(key[run], drift[e], "right")])
    return np.concatenate(out) if out else heap[:0]


def rescanned(x: np.ndarray, books: Books, code=None, key=None, heap=None):
    """A block's parts under new books: code, key, heap (each one row a part position), change of the totals, and how many parts were compared."""
    n, (parts, entries, width) = len(x), books.entry.shape
    fresh = code is None
    code = np.zeros((parts, n), np.uint8) if fresh else code.copy()
    key = np.zeros((parts, n)) if fresh else key.copy()
    heap = np.zeros((parts, n), np.int32) if fresh else heap.copy()
    change, popped = np.zeros((parts, entries, width + 1), np.int64), 0
    for p in range(parts):
        at = np.arange(n) if fresh else heads(heap[p], code[p], key[p], books.drift[p])
        if not len(at):
            continue
        popped += len(at)
        own = x[at, p * width : (p + 1) * width].astype(np.int64)
        near, slack = compared(own, books.entry[p])
        row = np.concatenate([np.ones((len(at), 1), np.int64), own], axis=1)
        other = np.ones(len(at), bool) if fresh else near != code[p, at]
        if not fresh:
            np.subtract.at(change[p], code[p, at[other]], row[other])
        np.add.at(change[p], near[other], row[other])
        code[p, at], key[p, at] = near, slack + books.drift[p, near]
        heap[p] = np.lexsort((key[p], code[p]))
    return code, key, heap, change, popped


KINDS = {"code": np.uint8, "key": np.float64, "heap": np.int32}


def block_of(row: dict, dims: int, parts: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A block's vectors, and what it has of code, key and heap."""
    x = np.frombuffer(row["x"], np.int32).reshape(-1, dims)
    return x, {k: np.frombuffer(row[k], kind).reshape(parts, len(x)) for k, kind in KINDS.items() if k in row}


def scanned(state: DataFrame, books: Books) -> DataFrame:
    """STATE after the books have moved; state: BLOCKS, or STATE from before."""
    parts, _, width = books.entry.shape
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("x", pa.binary()), ("code", pa.binary()), ("key", pa.binary()), ("heap", pa.binary()), ("change", pa.list_(pa.int64())), ("popped", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                row = one.select([c for c in one.schema.names if c not in ("ids", "labels")]).to_pylist()[0]
                x, before = block_of(row, parts * width, parts)
                code, key, heap, change, popped = rescanned(x, books, **before)
                new = [pa.array([v], t) for v, t in ((code.tobytes(), pa.binary()), (key.tobytes(), pa.binary()), (heap.astype(np.int32).tobytes(), pa.binary()), (change.reshape(-1), pa.list_(pa.int64())), (popped, pa.int64()))]
                yield pa.RecordBatch.from_arrays([one.column("ids"), one.column("labels"), one.column("x"), *new], schema=schema)

    return state.drop("change", "popped").mapInArrow(task, STATE)


def changes(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of all blocks' changes: a number for each entry and component."""
    got = state.select(F.posexplode("change").alias("at", "x")).filter("x <> 0").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).cast("long").alias("x")).collect()
    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in got:
        out[r["at"]] = r["x"]
    return out.reshape(shape)


def coded(state: DataFrame, books: Books) -> DataFrame:
    """CODED from blocks."""
    parts, _, width = books.entry.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                x, now = block_of(row, parts * width, parts)
                code = now["code"]
                error = sum(((x[:, p * width : (p + 1) * width] - books.entry[p][code[p]]) ** 2).sum(1) for p in range(parts))
                text = [c.tobytes().hex() for c in np.ascontiguousarray(code.T)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(text), pa.array(error, pa.int64()), pa.array(row["labels"], pa.int32())], ["vec_id", "code", "error", "label"])

    return state.drop("change", "popped", "key", "heap").mapInArrow(task, CODED)


def trained(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = 2, scale: int = 256, block: int = BLOCK) -> tuple[DataFrame, Books, list[int]] | None:
    """The blocks with their final codes, the books, and how many parts each assignment compared; None without vectors."""
    kept = embeddings.filter(finite("embedding")).select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "embedding")
    n, longest = kept.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return None
    width = max(1, -(-longest // parts))
    dims = width * parts
    vectors = kept.select("vec_id", "label", floored("embedding", scale, dims).alias("v"))
    first = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    entry = np.array([[*r["v"], *[0] * (dims - len(r["v"]))] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    books = Books(entry, np.zeros(entry.shape[:2]), np.zeros((*entry.shape[:2], width + 1), np.int64))
    state, popped = stored(scanned(blocks(vectors, dims, block), books)), []
    for _ in range(rounds):
        popped.append(state.agg(F.sum("popped")).first()[0])
        books = books.moved(changes(state, books.total.shape))
        state = stored(scanned(state, books))
    return state, books, [*popped, state.agg(F.sum("popped")).first()[0]]


def codes(embeddings: DataFrame, **how) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is kept."""
    if not (got := trained(embeddings, **how)):
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    state, books, _ = got
    each = coded(state, books)
    per = stored(each.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")))
    out = each.alias("e").join(per.alias("p"), F.col("e.label").eqNullSafe(F.col("p.label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
