"""Vectors on an integer lattice, and exact distances between them; for the clustering operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """The vector is there, and so are all its components, as numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def bound(dims: int) -> int:
    """Components up to this size keep squared distances of dims components below 2**62."""
    return 1 << ((60 - max(0, dims - 1).bit_length()) // 2)


def floored(vector: str, scale: int, dims: int) -> Column:
    """floor(scale * x) of every component, as int; beyond ``bound(dims)`` it stays at that bound."""
    most = float(bound(dims))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(float(scale)) * x.cast("double")))).cast("int"))


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """A list column, all of dims components, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and c: in doubles where they hold every sum, else in 64-bit integers."""
    most = 2.0 * max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    kind = float if x.shape[1] * most * most < 2**52 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)
