"""Benchmark decontamination by winnowing. DataFrame functions only.

A text's words are its runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. A window is
``span`` consecutive words of an item, or the whole of a shorter item. Winnowing at span t hashes every k words
(k = t / 2) and keeps, of every t - k + 1 hashes in a row, the least (the first of equal ones). What is kept of t words
depends on those words alone, so two texts that share t words share a kept hash there, and a window keeps exactly one.

Documents' kept hashes (about 2 of t - k + 2) meet those of the windows in a semi-join of three narrow columns. Only texts
with a hash in common are read again: around each hit, every stretch of t words that holds it is compared with the
windows, word by word. Texts are told apart by their MD5, and copies are dealt to ``SALT`` tasks, so that they meet in
map-side parts of the aggregations; the items of a set of windows are looked up once for all documents that have it.

Nothing is sent to all tasks unless Spark finds it below its own broadcast limit. One value for each window length
(``span`` at most) reaches the driver.

Defined results: null text has no words; a text or item without words has no hits; rows of one item_id are one item with
the windows of all its rows; null item ids are one item, whose id is written as the empty text; repeated documents
each get a row; without documents there are no rows, without items no hits; extra columns are ignored, whatever their
names; a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

SPAN, SALT = 10, 16
#: What ends a word once A-Z are lower-cased, and a word before that.
BETWEEN, WITHIN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def gram(t: int) -> int:
    """Words of a hashed gram, at span t."""
    return max(1, t // 2)


def counted(n: Column) -> Column:
    """0, 1, ..., n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def exploded(array: Column | str) -> Column:
    """A row for each element, or a row of nulls. For explode(), Spark infers a filter on the array's size, whose copy of the expression it moves to the scan, where texts would be split once for every word."""
    return F.explode_outer(array)


def kept_hashes(df: DataFrame, t: int) -> DataFrame:
    """df, which has words, with ``kept``: the place and hash of every gram that winnowing at span t keeps."""
    k = gram(t)
    width, n = t - k + 1, F.size("words")
    own = df.withColumn("hashes", F.transform(counted(n - (k - 1)), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(k)])))

    def least(i: Column) -> Column:
        row = [F.get("hashes", i + j) for j in range(width)]
        return i if width == 1 else i + F.array_position(F.array(*row), F.least(*row)).cast("int") - 1

    own = own.withColumn("places", F.array_distinct(F.transform(counted(F.size("hashes") - (width - 1)), least)))
    return own.withColumn("kept", F.transform("places", lambda p: F.struct(p.alias("place"), F.get("hashes", p).alias("hash")))).drop("hashes", "places")


def fingerprints(texts: DataFrame, spans: list[int]) -> DataFrame:
    """(key, span, place, hash) of texts (key, words) at each span."""
    out = []
    for t in spans:
        out.append(kept_hashes(texts, t).select("key", F.lit(t).alias("span"), exploded("kept").alias("k")).select("key", "span", "k.place", "k.hash"))
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


def windows_of(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(window, item): the words of every window of every item, once."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    t = F.least(F.size("words"), F.lit(span))
    each = F.transform(F.when(t > 0, counted(F.size("words") - t + 1)), lambda i: F.slice("words", i + 1, t))
    return items.select("item", exploded(each).alias("window")).filter(F.col("window").isNotNull()).distinct()


def met_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, start, span, window_id) of each place where a text (key, text) has a window (window, window_id)."""
    spans = sorted(r[0] for r in windows.select(F.size("window")).distinct().collect())
    if not spans:
        return docs.limit(0).select("key", F.lit(0).alias("start"), F.lit(0).alias("span"), F.lit("").alias("window_id"))
    wanted = cut(fingerprints(windows.select(F.col("window_id").alias("key"), F.col("window").alias("words")), spans).select("span", "hash").distinct())
    own = fingerprints(docs.select("key", words_of(F.col("text")).alias("words")), spans)
    hits = cut(own.join(wanted, ["span", "hash"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("span", "place")).alias("hits")))
    # hits are extended: to each stretch of span words around the gram, wherever the text has so many
    dealt = docs.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    again = dealt.join(hits, ["key", "salt"]).select("key", "hits", words_of(F.col("text")).alias("words"))
    half = lambda x: F.greatest(F.lit(1), F.floor(x["span"] / 2).cast("int"))  # noqa: E731  as gram()
    around = lambda x: F.sequence(F.greatest(F.lit(0), x["place"] - (x["span"] - half(x))), F.least(x["place"], F.size("words") - x["span"]))
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.transform(around(x), lambda s: F.struct(s.alias("start"), x["span"].alias("span"))))))
    again = again.withColumn("starts", starts)
    stretch = F.transform("starts", lambda s: F.struct(s["start"].alias("start"), s["span"].alias("span"), F.slice("words", s["start"] + 1, s["span"]).alias("window")))
    found = again.select("key", exploded(stretch).alias("s")).select("key", "s.start", "s.span", "s.window")
    return found.join(windows, "window").select("key", "start", "span", "window_id")


def covered(places: Column) -> Column:
    """How many words lie in any of the places (start, span)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))

    def step(a: Column, x: Column) -> Column:
        end = x["start"] + x["span"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["words"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["start"]))).alias("words"))

    return F.aggregate(F.array_sort(places), zero, step, lambda a: a["words"])


def judge(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated of each document."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id"), "text", F.md5(text).alias("key"))
    with_items = cut(windows_of(benchmark, span).withColumn("window_id", F.md5(F.concat_ws(" ", "window"))))
    windows = cut(with_items.select("window", "window_id").distinct())
    met = met_windows(docs.select("key", "text"), windows)
    per = met.groupBy("key").agg(F.collect_set(F.struct("start", "span")).alias("places"), F.array_sort(F.collect_set("window_id")).alias("ids"))
    per = cut(per.select("key", covered(F.col("places")).cast("long").alias("n_hit"), F.md5(F.array_join("ids", ",")).alias("set"), "ids"))
    sets = per.groupBy("set").agg(F.first("ids").alias("ids")).select("set", F.explode("ids").alias("window_id"))
    items = sets.join(with_items.select("window_id", "item"), "window_id").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = items.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    per = cut(per.join(items, "set").select("key", "n_hit", "n_items", "items_sha256"))
    n_words = F.regexp_count(text, F.lit(WITHIN)).cast("long")
    none = F.lit(0).cast("long")
    out = docs.select("doc_id", "key", n_words.alias("n_words")).join(per, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"))
