"""Repository tables: files changed most often, and what imports what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOP_FILES, TOP_IMPORTS = 20, 5


def commits(log: DataFrame) -> DataFrame:
    """log (file, line_no, raw) with ``COMMIT<tab>sha<tab>seconds`` headers, then a path a line -> sha, at, path.

    A path belongs to the header above it in its file; paths before the first header belong to none and go.
    """
    head = F.when(F.col("raw").startswith("COMMIT\t"), F.split("raw", "\t"))
    upto = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = log.withColumn("head", F.last(head, ignorenulls=True).over(upto)).filter(~F.col("raw").startswith("COMMIT\t") & (F.trim("raw") != "") & F.col("head").isNotNull())
    return rows.select(F.get("head", F.lit(1)).alias("sha"), F.get("head", F.lit(2)).try_cast("long").alias("at"), F.trim("raw").alias("path"))


def hot_files(changes: DataFrame, files: DataFrame, most: int = TOP_FILES) -> DataFrame:
    """path, changes: the files changed in most commits, of those that are there."""
    counted = changes.groupBy(F.translate("path", "\\", "/").alias("path")).agg(F.count(F.lit(1)).alias("changes"))
    return counted.join(files.select("path").distinct(), "path", "left_semi").orderBy(F.desc("changes"), "path").limit(most)


def dearest_imports(edges: DataFrame, most: int = TOP_IMPORTS) -> DataFrame:
    """edges (importer, imported) -> importer, place, imported, used_by: each file's imports, those of most importers first."""
    edges = edges.distinct()
    used = edges.groupBy("imported").agg(F.count(F.lit(1)).alias("used_by"))
    order = W.partitionBy("importer").orderBy(F.desc("used_by"), "imported")
    return edges.join(used, "imported").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("importer", "place", "imported", "used_by")
