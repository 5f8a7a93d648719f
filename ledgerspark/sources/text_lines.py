"""Log files as numbered lines.

Files are split by Spark; a line's place in its file follows from its split's start and its order there, without a
shuffle: lines are parsed and projected where they are read, and only what is left of them is shuffled. Truncated zstd
files are dropped by the reader when it is told to ignore them, so unreadable() compares with the listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: What numbered_lines gives.
LINES = "path string, mtime timestamp, size long, line_no long, raw string"

#: Splits start this many bits of bytes apart at least (4 KB), and a partition reads under 2 ** ROW_BITS lines; files are under 4 TB.
START_BITS, ROW_BITS = 12, 33


def numbered_lines(spark: SparkSession, paths: list[str] | str, glob: str = "*.jsonl", recursive: bool = False, ignore_corrupt: bool = False) -> DataFrame:
    """path, mtime, size, line_no, raw. line_no orders a file's lines and tells them apart; it does not count them. Blank lines are left out."""
    read = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", ignore_corrupt)
    place = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), START_BITS), ROW_BITS).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit(2**ROW_BITS - 1)))
    t = read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"),
        place.alias("line_no"), F.col("value").alias("raw"),
    )
    return t.filter(F.trim("raw") != "")


def file_listing(spark: SparkSession, paths: list[str] | str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path (as in numbered_lines), open (what to pass to a reader), mtime, size of every file, by listing alone (no content column is read)."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(paths)
    name = F.regexp_replace("path", r"([\\*?{}\[\]])", r"\\$1")  # readers take paths as patterns
    return b.select(F.col("_metadata.file_path").alias("path"), name.alias("open"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"))


def unreadable(listing: DataFrame, lines: DataFrame) -> DataFrame:
    """Listed files with bytes but without a line."""
    return listing.filter("size > 0").join(lines.select("path").distinct(), "path", "left_anti")


def kind_at(v: Column, path: str) -> Column:
    """The type of a variant's value: STRING, VOID for a JSON null, null if there is none."""
    return F.schema_of_variant(v if path == "$" else F.try_variant_get(v, path, "variant"))  # what is looked up is copied


def text_at(v: Column, path: str) -> Column:
    """A string of a variant; null if the value there is no string."""
    return F.when(kind_at(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def filled(v: Column, path: str) -> Column:
    """A string of a variant that is not empty."""
    x = text_at(v, path)
    return F.when(F.length(x) > 0, x)


def count_at(v: Column, path: str) -> Column:
    """A number of a variant, 0 if missing, not a number or negative."""
    number = kind_at(v, path).rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT|SMALLINT|TINYINT)")
    return F.coalesce(F.when(number, F.greatest(F.try_variant_get(v, path, "double"), F.lit(0.0))), F.lit(0.0)).cast("long")


def present(v: Column, path: str, kind: str) -> Column:
    """Whether a variant has an OBJECT, ARRAY or other kind of value at path."""
    return F.coalesce(kind_at(v, path).startswith(kind), F.lit(False))
