"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Every source's documents are laid out one after another in a shuffled order (by MD5 of the id), which
makes a stream of words that starts again when it ends. The mix is a row of slots, each worth ``block`` words,
as many as make up the sum of all targets. A Weyl sequence fills them: slot k falls at the point
``k * step mod 2**31`` (step / 2**31 is the golden ratio), and the source whose share of [0, 2**31) holds the
point is drawn. Slots are ranked within their source, and the slot of rank r takes the words
[r * block, (r + 1) * block) of the source's stream, up to ``cap`` times its size. Nothing else takes words:
what a source gives is what the slots drew, which a low-discrepancy sequence keeps within a few blocks of
its target (exactly at the cap where the target is the cap and the slots overshoot it).

``block`` is, unless given, a share of all words: so that there are ``SLOTS`` slots and ``EACH`` a source at
least, but no more than ``BLOCK`` words.

No step gathers a source in one task: prefix sums run within (source, MD5 prefix) and (source, slot chunk)
groups, with a small table of group totals on top.

Defined results: null text has size 0; a null source is a source of its own, the last; repeated rows are
rows of their own; no rows give no rows; sources without words get target 0; extra columns are kept as they
are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, partitions, word_count

RANGE = 2**31
STEP = 1327217885  # odd, nearest to 2**31 times the golden ratio's fraction
CHUNK = 2**16
BIN_BITS = 19
BLOCK, SLOTS, EACH = 1024, 2**16, 256


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the place in the shuffle order: md5 and its first three digits."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("md5"), F.substring(digest, 1, 3).alias("bucket"))


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, weight, target for each source.

    Targets are the weights times a common level, or cap times the size where that is less; the level is
    such that all add up to share times all sizes. Sources are few against documents (one row each here),
    so ranking them in one window is fine.
    """
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    by_ratio = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    # sources in order of size / weight: the first ones stop at their caps; the level follows from the rest
    per = (
        per.withColumn("capped_before", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("all", F.sum("source_size").over(every) * share)
        .withColumn("level", (F.col("all") - F.col("capped_before")) / F.col("weight_from"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("source_size") * cap)
    )
    level = F.max(F.when(F.col("free"), F.struct(-F.col("source_size") / F.col("weight"), F.col("level")))).over(every)["level"]
    limit = F.col("source_size") * F.lit(float(cap))
    return per.select("source", "source_size", "weight", F.coalesce(F.least(limit, level * F.col("weight")), limit).alias("target"))


def block_of(shares: DataFrame) -> int:
    """Words of a slot: ``BLOCK``, or less where that would leave too few slots in all or for each source."""
    total, sources = shares.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0)), F.count(F.lit(1))).first()
    return int(max(1, min(BLOCK, total // max(SLOTS, EACH * sources))))


def schedule(shares: DataFrame, block: int, step: int = STEP) -> DataFrame:
    """(source, rank, slot): the source that each slot draws, and the slot's rank there."""
    total = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    bounds = shares.select("source", F.floor("target").alias("need")).filter("need > 0")
    bounds = bounds.withColumn("all", F.sum("need").over(total)).withColumn("hi", F.floor(F.sum("need").over(upto) / F.col("all") * RANGE))
    bounds = bounds.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy(F.col("source").asc_nulls_last())), F.lit(0)))
    chunks = bounds.agg(F.ceil(F.sum("need") / F.lit(block)).alias("slots")).filter("slots > 0")
    chunks = chunks.select("slots", F.explode(F.sequence(F.lit(0), ((F.col("slots") - 1) / CHUNK).cast("long"))).alias("chunk"))
    slots = chunks.repartition("chunk").select("chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("slot"))
    slots = slots.withColumn("point", (F.col("slot") % RANGE) * step % RANGE).withColumn("bin", F.shiftright("point", BIN_BITS))
    # shares cut at bin borders turn the range join into one on bins
    shared = bounds.filter("hi > lo").withColumn("bin", F.explode(F.sequence(F.shiftright("lo", BIN_BITS), F.shiftright(F.col("hi") - 1, BIN_BITS))))
    drawn = slots.join(shared, (slots["bin"] == shared["bin"]) & F.col("point").between(F.col("lo"), F.col("hi") - 1)).select("source", "chunk", "slot")
    counts = drawn.groupBy("source", "chunk").count()
    counts = counts.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).alias("d").join(counts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.chunk") == F.col("c.chunk")))
    return ranked.select("d.source", (F.col("inside") + F.col("before")).alias("rank"), "slot")


def laid_out(sizes: DataFrame) -> DataFrame:
    """Each row's place [start, start + size) in its source's stream; (bucket, nth) tells equal rows apart."""
    order = W.partitionBy("source", "bucket").orderBy("md5", "doc_id", "size")
    inside = sizes.withColumn("upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order))
    heads = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    heads = heads.withColumn("head", F.coalesce(F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    on = F.col("i.source").eqNullSafe(F.col("h.source")) & (F.col("i.bucket") == F.col("h.bucket"))
    return inside.alias("i").join(heads.alias("h"), on).select("i.doc_id", "i.source", "i.bucket", "nth", "size", (F.col("head") + F.col("upto") - F.col("size")).alias("start"))


def passes(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int | None = None, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """What the slots take, a row for each row of docs, pass over its source's stream and block: doc_id, source, bucket, nth, size, pass, slot, words.

    The second table has all rows: doc_id, source, bucket, nth, size, source_size, target.
    """
    sizes = cut(sized(docs))
    shares = cut(targets(sizes, weights, share, cap))
    block = block or block_of(shares)
    slots = cut(schedule(shares, block, step))
    drawn = slots.groupBy("source").agg((F.max("rank") + 1).alias("drawn")).alias("g")
    # written, so that its size is known and a small one is sent to the rows; a large one leaves hot sources to AQE
    shares = cut(shares.alias("t").join(drawn, F.col("t.source").eqNullSafe(F.col("g.source")), "left").select("t.*", F.coalesce("drawn", F.lit(0)).alias("drawn")))
    rows = laid_out(sizes).alias("r").join(shares.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("doc_id", "r.source", "bucket", "nth", "size", "source_size", "target", "start", "drawn")
    # which blocks of the stream hold the row's words, pass by pass; the slots that drew them come by a join
    at = F.col("start") + F.col("pass") * F.col("source_size")
    upto = F.least(F.floor(F.lit(float(cap)) * F.col("source_size")), F.col("drawn") * block)
    held = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(0, math.ceil(cap) - 1))))).withColumn("at", at).withColumn("end", F.least(F.col("at") + F.col("size"), upto)).filter("end > at")
    held = held.withColumn("piece", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block)))).alias("p")
    met = held.join(slots.hint("shuffle_hash").alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("piece") == F.col("rank")))
    words = F.least(F.col("end"), (F.col("piece") + 1) * block) - F.greatest(F.col("at"), F.col("piece") * block)
    return met.select("doc_id", "p.source", "bucket", "nth", "size", "pass", "slot", words.alias("words")), rows.drop("start", "drawn")


KEYS = ("doc_id", "source", "bucket", "nth", "size")


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words taken, repeats counted), n_slots, first_slot.

    n_slots: how many blocks of the mix hold words of it; first_slot: where the first of them stands in the mix
    (null if none does).
    """
    taken, rows = passes(docs, **how)
    took = taken.groupBy(*KEYS).agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_slots"), F.min("slot").alias("first_slot"))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in KEYS]
    out = rows.alias("r").join(took.alias("t"), on, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("r.doc_id", "r.source", "r.size", "source_size", "target", zero("taken"), zero("n_slots"), "first_slot")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in slot order: each document once for every pass that takes it, in the columns of documents.

    A document stands where the slot of its first word does. One that the slots take only in part (where a
    source's stream ends) keeps the words taken, joined by spaces. Partitions follow each other in slot order.
    """
    spark, cols = docs.sparkSession, docs.columns
    taken, _ = passes(docs, **how)
    taken = cut(taken.groupBy(*KEYS, "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot")))
    last = (taken.agg(F.max("slot")).first()[0] or 0) + 1
    taken = taken.groupBy(*KEYS).agg(F.collect_list(F.struct("words", "slot")).alias("parts"))  # one for each pass
    # rows with one id, source and size get their parts by a number of their own
    same = ("doc_id", "source", "size")
    taken = taken.withColumn("k", F.row_number().over(W.partitionBy(*same).orderBy("bucket", "nth"))).select(*same, "k", "parts")
    own = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("of_text"), F.struct(*cols).alias("row"))
    own = own.withColumn("k", F.row_number().over(W.partitionBy(*same).orderBy("of_text")))  # by a hash: the text itself would be shuffled twice
    on = [F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*same, "k")]
    out = own.alias("o").join(taken.alias("t"), on).select("o.row", "o.size", F.explode("t.parts").alias("part"))
    n = partitions(spark)
    out = out.repartitionById(n, F.floor(F.col("part.slot") * n / last).cast("int")).sortWithinPartitions("part.slot")
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    whole = F.col("part.words") >= F.col("size")
    text = F.when(whole, F.col("row.text")).otherwise(F.array_join(F.slice(words, 1, F.col("part.words").cast("int")), " "))
    changed = {"text": text}
    if "n_chars" in cols:
        changed["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in cols])
