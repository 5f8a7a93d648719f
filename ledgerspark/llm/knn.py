"""Exact top-k inner products by a Voronoi kNN join.

Pivots, a sample of about sqrt(n) vectors (``PIVOTS`` at most), cut the space into cells. A vector x goes to
its nearest pivot in the space where sqrt(M^2 - |x|^2) is one more component (M: the greatest norm): there the
nearest vectors are those of greatest inner product, and a cell holds vectors of like direction and norm. A
cell's summary is its size n, its radius r around pivot p and its greatest norm m; a query q scores in it at
most the least of q.p + |q| r, of |q| m, and of (|q|^2 + m^2 - max(0, |q - p| - r)^2) / 2.

Near cells share a tile of about ``BLOCK`` vectors, and a larger cell is dealt to several tiles, so that a cell
with a third of all vectors spreads over many tasks. Each query is first solved in the tiles of its home cell, the
one with the best q.p; its k-th best score there is a lower bound, and the query is then sent only to tiles with
a cell whose upper bound reaches it. A task holds one tile and streams queries past it.

Only pivots and cell summaries (at most PIVOTS rows) reach the driver. Data vectors are never copied; queries are.
``pairs`` tells how many (query, tile) pairs the bounds leave of all.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do null ids;
repeated rows are candidates of their own, and one query; a shorter vector counts as padded with zeros; ties
go to the smaller id; fewer than k candidates give all of them; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, partitions

PIVOTS, BLOCK, BATCH, CELLS = 1 << 16, 4096, 256, 1 << 22
FOUND = "query_id long, vec_id long, score long"


def integers(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, for vectors that take part."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok).select(F.col("vec_id").cast("long"), v.alias("v"))


def matrix(vs, dims: int) -> np.ndarray:
    out = np.zeros((len(vs), dims), np.int64)
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they hold every sum, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float) @ x.astype(float).T) if most < 2**53 else q @ x.T


def best(qid: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a tile (ids ascending) for each query, of scores that reach least."""
    s = products(q, x)
    none = -np.inf if s.dtype == float else np.iinfo(np.int64).min
    s[qid[:, None] == ids[None, :]] = none
    least = least - 1e-12 * np.abs(least)  # a bound only: rounding must not drop a tie
    floor = np.maximum(np.partition(s, -k, axis=1)[:, -k] if len(ids) > k else none, least if s.dtype == float else np.maximum(least, -(2.0**62)).astype(np.int64))
    r, c = np.nonzero((s >= floor[:, None]) & (s > none))
    got = s[r, c]
    order = np.lexsort((c, -got, r))
    r, c, got = r[order], c[order], got[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = rank < k
    return pd.DataFrame({"query_id": qid[r[keep]], "vec_id": ids[c[keep]], "score": got[keep].astype(np.int64)})


def solver(k: int, dims: int):
    """Rows sorted by (tile, data first, vec_id) -> candidates. One tile is held; queries stream past in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, vs, data = None, [], [], None
        for f in frames:
            same = ((f["tile"] != f["tile"].shift()) | (f["is_query"] != f["is_query"].shift())).cumsum()
            for _, g in f.groupby(same, sort=False):
                key = g["tile"].iat[0]
                if key != at:
                    at, ids, vs, data = key, [], [], None
                if not g["is_query"].iat[0]:
                    ids, vs = ids + g["id"].tolist(), vs + list(g["v"])
                    continue
                if not ids:
                    continue
                if data is None:
                    data = np.array(ids, np.int64), matrix(vs, dims)
                for b in range(0, len(g), BATCH):
                    h = g.iloc[b : b + BATCH]
                    yield best(h["id"].to_numpy(np.int64), matrix(list(h["v"]), dims), h["least"].to_numpy(float), *data, k)

    return run


def solved(data: DataFrame, asked: DataFrame, k: int, dims: int) -> DataFrame:
    """data: tile, id, v; asked: tile, id, v, least."""
    both = data.select("tile", F.lit(False).alias("is_query"), "id", "v", F.lit(None).cast("double").alias("least")).unionByName(asked.select("tile", F.lit(True).alias("is_query"), "id", "v", "least"))
    n = 2 * partitions(data.sparkSession)
    return both.repartition(n, "tile").sortWithinPartitions("tile", "is_query", "id").mapInPandas(solver(k, dims), FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass
class Cells:
    """Pivots with the summaries of their cells, and each cell's first tile and number of tiles."""

    pivot: np.ndarray
    size: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    first: np.ndarray
    tiles: np.ndarray

    def homes(self, q: np.ndarray) -> np.ndarray:
        return np.where(self.size > 0, q @ self.pivot.T, -np.inf).argmax(1)

    def most(self, q: np.ndarray) -> np.ndarray:
        """The most that each query can score in each cell; rounding never makes it less."""
        by, q2, p2 = q @ self.pivot.T, (q * q).sum(1)[:, None], (self.pivot**2).sum(1)
        size = np.sqrt(q2)
        far = np.maximum(0, np.sqrt(np.maximum(q2 - 2 * by + p2, 0)) * (1 - 1e-9) - 1e-3 - self.radius)
        out = np.minimum(np.minimum(by + size * self.radius, size * self.norm), (q2 + self.norm**2 - far**2) / 2)
        return out + 1e-9 * np.abs(out) + 1e-6

    def tiles_of(self, cells: np.ndarray) -> np.ndarray:
        many = cells[self.tiles[cells] > 1]
        return np.unique(np.concatenate([self.first[cells], *(np.arange(self.first[c], self.first[c] + self.tiles[c]) for c in many)])).astype("int32")


def dealt(p: np.ndarray, size: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first tile and number of tiles. Cells are gone through by the nearest of some sqrt(len(p)) pivots, so near ones share a tile."""
    heads = p[:: max(1, isqrt(len(p)))]
    near, away = np.zeros(len(p), int), np.zeros(len(p))
    for at in range(0, len(p), step := max(1, CELLS // len(heads))):
        d = ((p[at : at + step] ** 2).sum(1)[:, None] - 2 * p[at : at + step] @ heads.T) + (heads**2).sum(1)
        near[at : at + step], away[at : at + step] = d.argmin(1), d.min(1)
    first, tiles = np.zeros(len(p), int), np.zeros(len(p), int)
    tile, held = -1, block
    for c in np.lexsort((away, near)):
        if not size[c]:
            continue
        tiles[c] = -(-size[c] // block)
        if held + size[c] > block:  # a tile, or some, of its own to begin with
            first[c], tile, held = tile + 1, tile + tiles[c], size[c] if tiles[c] == 1 else block
        else:
            first[c], held = tile, held + size[c]
    return first, tiles


def placed(vectors: DataFrame, pivots: int | None, block: int) -> tuple[DataFrame, Cells] | None:
    """vectors (cut) with their cell, and the cells; None if there are no vectors."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, dims, most = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm2)).first()
    if not n:
        return None
    dims = max(dims, 1)
    picked = vectors.select("v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots or min(PIVOTS, isqrt(n) + 1)).collect()  # a bounded sample
    p = np.unique(matrix([r[0] for r in picked], dims).astype(float), axis=0)
    p2 = (p * p).sum(1)
    lift = np.sqrt(np.maximum(most - p2, 0))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), step := max(1, CELLS // len(p))):
                g = f.iloc[at : at + step]
                x = matrix(list(g["v"]), dims).astype(float)
                x2 = (x * x).sum(1)
                cell = (p2 + lift**2 - 2 * (x @ p.T + np.sqrt(np.maximum(most - x2, 0))[:, None] * lift)).argmin(1)
                yield g.assign(cell=cell.astype("int32"), away=np.sqrt(((x - p[cell]) ** 2).sum(1)), norm=np.sqrt(x2))

    out = cut(vectors.mapInPandas(assign, "vec_id long, v array<long>, cell int, away double, norm double"))
    size, radius, norm = np.zeros(len(p), int), np.zeros(len(p)), np.zeros(len(p))
    for r in out.groupBy("cell").agg(F.count(F.lit(1)), F.max("away"), F.max("norm")).collect():
        size[r[0]], radius[r[0]], norm[r[0]] = r[1:]
    return out, Cells(p, size, radius, norm, *dealt(p, size, block))


def sent(asked: DataFrame, cells, dims: int, home: bool) -> DataFrame:
    """A row (tile, id, v, least) for each tile that each query of asked (id, v, least) goes to: those of its home cell, or all others that it reaches."""

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = cells.value
        for f in frames:
            for at in range(0, len(f), step := max(1, CELLS // len(c.pivot))):
                g = f.iloc[at : at + step]
                q = matrix(list(g["v"]), dims).astype(float)
                own = [c.tiles_of(np.array([h])) for h in c.homes(q)]
                if not home:
                    ok = (c.most(q) >= g["least"].to_numpy(float)[:, None]) & (c.size > 0)
                    own = [np.setdiff1d(c.tiles_of(np.flatnonzero(row)), h) if row.any() else h[:0] for row, h in zip(ok, own, strict=True)]
                yield g.assign(tiles=own)[["id", "v", "least", "tiles"]]

    return asked.select("id", "v", "least").mapInPandas(reach, "id long, v array<long>, least double, tiles array<int>").withColumn("tile", F.explode("tiles")).drop("tiles")


def searched(vectors: DataFrame, queries, k: int, pivots: int | None, block: int):
    """The best of each query's home tiles, what else its bounds reach, the data by tile, and the cells; None without vectors."""
    vectors = cut(vectors)
    if not (got := placed(vectors, pivots, block)):
        return None
    rows, cells = got
    dims = cells.pivot.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(cells)  # PIVOTS rows at most

    @F.pandas_udf("int")
    def tile_of(cell: pd.Series, dealt: pd.Series) -> pd.Series:
        c = shared.value
        return pd.Series(c.first[cell] + dealt.to_numpy() % c.tiles[cell], dtype="int32")

    data = rows.select(tile_of("cell", F.xxhash64("vec_id", "v")).alias("tile"), F.col("vec_id").alias("id"), "v")
    asked = rows.filter(queries).select(F.col("vec_id").alias("id"), "v").distinct()
    none = F.lit(float("-inf"))
    first = cut(ranked(solved(data, sent(asked.withColumn("least", none), shared, dims, True), k, dims), k))
    least = first.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    bounded = asked.join(least, asked["id"] == least["query_id"], "left").select("id", "v", F.coalesce("least", none).alias("least"))
    return first, sent(bounded, shared, dims, False), data, cells


def top_k(vectors: DataFrame, queries, k: int = 20, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score; vectors: (vec_id, v long arrays); queries: the condition that picks query rows."""
    got = searched(vectors, queries, k, pivots, block)
    if not got:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first, wide, data, cells = got
    every = first.select("query_id", "vec_id", "score").unionByName(solved(data, wide, k, cells.pivot.shape[1]))
    return ranked(every, k).select("query_id", "rank", "vec_id", "score")


def pairs(vectors: DataFrame, queries, k: int = 20, pivots: int | None = None, block: int = BLOCK) -> tuple[int, int]:
    """How many (query, tile) pairs beyond the home cell's the bounds leave, and how many there are in all."""
    got = searched(vectors, queries, k, pivots, block)
    if not got:
        return 0, 0
    first, wide, _, cells = got
    return wide.count(), first.select("query_id").distinct().count() * int((cells.first + cells.tiles).max())
