"""Centroid clustering over distinct vectors.

Vectors become integers; equal ones are grouped, with their number as weight. Lloyd's rounds run on the distinct vectors
alone: a task sums weight and weight times vector for each centroid, as 64-bit integers, Spark adds the tasks' few rows
as decimals, and the driver divides. So sums are exact, and a round moves one row a centroid and task. In the end each
distinct vector's centroid and distance are joined back to the ids.

A vector with 1 / ``HEAVY`` of all rows or more would make its rows one key of that join. There are ``HEAVY`` of these at
most, so they are sent to all tasks; the others meet their rows in a shuffle whose keys are all small.

Defined results: vectors of another length than dims, or null, or with a null or non-finite component take no part;
a null id takes part, comes last among the first centroids, and gets a row; repeated rows count once each; of
equal hashes the smaller vector is first; fewer vectors than k give as many centroids; no vectors give no rows;
components beyond lattice.bound(dims) count as that bound; an inertia beyond 64 bits is null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import finite, floored, rows_of, squared
from .shared import stored

HEAVY, BATCH = 1024, 4096
CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantised(embeddings: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    return embeddings.filter(finite("embedding") & (F.size("embedding") == dims)).select(F.col("vec_id").cast("long"), floored("embedding", scale, dims).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest SHA-256 after the seed."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    picked = vectors.select(place.alias("place"), "v").orderBy(F.col("place").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in picked], np.int64)


def sums(distinct: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int]]]:
    """For each centroid with vectors, how many these are (with repeats) and their sum."""
    k, dims = centroids.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            x, w = rows_of(b.column("v"), dims).astype(np.int64), b.column("weight").to_numpy()
            near = np.concatenate([squared(x[at : at + BATCH], centroids).argmin(1) for at in range(0, len(x), BATCH)] or [np.zeros(0, int)])
            weighted = np.concatenate([w[:, None], x * w[:, None]], axis=1)
            for c in np.unique(near):
                total[c] += weighted[near == c].sum(0)
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "total": pa.array(list(total[some]), pa.list_(pa.int64()))})

    each = distinct.mapInArrow(task, "cluster int, total array<long>").select("cluster", F.posexplode("total").alias("at", "x"))
    got = each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k * (dims + 1) rows at most
    out: dict[int, list[int]] = {}
    for r in got:
        out.setdefault(r["cluster"], [0] * (dims + 1))[r["at"]] = int(r["x"])
    return [(c, x) for c, x in sorted(out.items())]


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """distinct with the cluster and squared distance of each vector."""
    dims = centroids.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                d = squared(rows_of(part.column("v"), dims).astype(np.int64), centroids)
                near = d.argmin(1)
                cols = [*part.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, "cluster", "distance"])

    return distinct.mapInArrow(task, "v array<int>, weight long, cluster int, distance long")


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round; those without vectors stay."""
    out = centroids.copy()
    for c, (n, *total) in sums(distinct, centroids):
        out[c] = [t // n for t in total]
    return out


def joined(vectors: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """vec_id, cluster, distance of every row."""
    heavy = F.col("weight") * HEAVY >= n
    ends = ends.select("v", "weight", "cluster", "distance")
    by_all, light = ends.filter(heavy).drop("weight"), ends.filter(~heavy).drop("weight")
    one = vectors.join(F.broadcast(by_all), "v")  # HEAVY rows at most
    rest = vectors.join(F.broadcast(by_all.select("v")), "v", "left_anti").join(light, "v")
    return one.unionByName(rest).select("vec_id", "cluster", "distance")


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """CLUSTERED for every row of vectors (vec_id, v)."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], CLUSTERED)
    distinct = stored(vectors.groupBy("v").agg(F.count(F.lit(1)).alias("weight")))
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    ends = stored(assigned(distinct, centroids))
    spread = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight"))
    per = {r["cluster"]: (r["n"], int(r["spread"])) for r in ends.groupBy("cluster").agg(F.sum("weight").alias("n"), spread.alias("spread")).collect()}  # k rows at most
    held = lambda x: x if x < 1 << 63 else None
    every = held(sum(s for _, s in per.values()))
    names = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in per}
    of = spark.createDataFrame([(c, held(s), every, names[c]) for c, (_, s) in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return joined(vectors, ends, sum(n for n, _ in per.values())).join(F.broadcast(of), "cluster").select(*CLUSTERED.replace(",", "").split()[::2])
