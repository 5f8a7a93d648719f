"""Small stores as tables: append, keep the newest, last one wins, JSON reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DRIFT_KEEP, CONFIG_KEEP, SIGNAL_KEEP = 100, 400, 200


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by one aggregation that combines before the shuffle."""
    whole = F.max_by(F.struct(*rows.columns), F.col(order))
    return rows.groupBy(F.col(key).alias("_key")).agg(whole.alias("r")).select("r.*")


def newest(rows: DataFrame, order: str, keep: int, by: str | None = None) -> DataFrame:
    """The newest ``keep`` rows, of all or of each ``by``; ties go to the later of equal rows' other columns."""
    ties = [F.col(c).desc() for c in sorted(rows.columns) if c not in (order, by)]
    if by is None:
        return rows.orderBy(F.col(order).desc(), *ties).limit(keep)
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.col(order).desc(), *ties))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= keep).drop("_rank")


def pruned(rows: DataFrame, order: str, keep: int = DRIFT_KEEP, above: int = 2 * DRIFT_KEEP) -> DataFrame:
    """All rows up to ``above`` of them, else the newest ``keep``."""
    n = rows.limit(above + 1).count()
    return rows if n <= above else newest(rows, order, keep)


def event_sink(root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch goes to a folder of its number, in place of what is there, so that a batch that is replayed after a failure adds nothing. A root belongs to one query."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number:019d}")

    return put


def events(spark: SparkSession, root: str, order: str, keep: int | None = None) -> DataFrame:
    """What an event_sink() has put down, or the ``keep`` rows put down last (by batch, then by ``order``), for which only the last batches that hold so many are read."""
    rows = spark.read.parquet(root)
    if keep is None:
        return rows.drop("batch")
    counts = rows.groupBy("batch").count()
    later = F.coalesce(F.sum("count").over(W.orderBy(F.desc("batch")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a batch
    some = counts.withColumn("later", later).filter(F.col("later") < keep).select("batch")
    last = rows.join(F.broadcast(some.limit(keep)), "batch", "left_semi").withColumn("_at", F.struct("batch", order))
    return newest(last.drop("batch"), "_at", keep).drop("_at")


def report_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON object; nulls stay as nulls."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(name))


#: Fixed values of a badge.
LOGO, LABEL_COLOR = "github", "#0B0E0E"


def badge(score: Column, tier: Column, color: Column, label: str) -> Column:
    """A badge as JSON: the score and its tier."""
    message = F.concat(score.cast("string"), F.lit(" \u00b7 "), tier).alias("message")
    return F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(label).alias("label"), message, color.alias("color"), F.lit(LOGO).alias("namedLogo"), F.lit(LABEL_COLOR).alias("labelColor")))


def rewrite_report(stats: DataFrame) -> DataFrame:
    """For each rewriter: events, tokens saved, and the mean integrity of those that have one."""
    return stats.groupBy("rewriter_name").agg(
        F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"), F.avg("integrity").alias("avg_integrity"), F.count("integrity").alias("with_integrity")
    )


def rewrite_total(report: DataFrame) -> DataFrame:
    """The rewriters' totals; integrity is weighted by the events that have one."""
    weighted = F.sum(F.col("avg_integrity") * F.col("with_integrity")) / F.sum(F.when(F.col("avg_integrity").isNotNull(), F.col("with_integrity")))
    return report.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"), weighted.alias("avg_integrity"))


def snapshot_changes(snapshots: DataFrame, at: Column) -> DataFrame:
    """Per project: entries of the newest snapshot that the one in force at ``at`` lacks, and the other way round.

    snapshots: project, captured_at, entries (array of strings). Before the first snapshot nothing is in force.
    """
    both = snapshots.groupBy("project").agg(
        F.max_by("entries", "captured_at").alias("new"), F.max_by(F.when(F.col("captured_at") <= at, F.col("entries")), F.when(F.col("captured_at") <= at, F.col("captured_at"))).alias("old")
    )
    nothing = F.array().cast("array<string>")
    old, new = F.coalesce("old", nothing), F.coalesce("new", nothing)
    return both.select("project", F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed"))
