"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Every round is two aggregations by node; edges are written to the checkpoint folder after each round, and
only two totals reach the driver. A hub's neighbours are dealt by their own hash to ``SALT`` tasks: the least of
each part, then of the parts (``SALT`` rows a node at most), goes back to the parts that there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SALT = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): from each node's neighbours, those on one side of it are linked to the least of neighbours and node."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
    parts = both.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.least("u", F.min("m")).alias("m"), F.collect_list("salt").alias("salts"))
    spread = least.select(F.col("u").alias("k"), "m", F.explode("salts").alias("part"))
    met = both.join(spread, (both["u"] == spread["k"]) & (both["salt"] == spread["part"]))
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(most_rounds):
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
