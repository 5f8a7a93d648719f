"""SimHash near-duplicates by pigeonhole blocks.

Each text gives a 64-bit fingerprint (majority of the bits of its word shingles' XXH64). Two fingerprints
within ``MAX_BITS`` = 4 differing bits agree on at least three of seven blocks, so each distinct fingerprint
goes out under all 35 choices of three blocks (27 or 28 bits of key each); those that share a key are
compared. Documents with equal fingerprints are one node throughout.

A key's fingerprints are dealt into chunks of ``CHUNK``; each pair of chunks is a unit of work of its own, so
no task holds a whole large group. A unit compares its members with numpy and passes on a spanning forest of
the links found, at most one link less than members: never all pairs. Links feed connected components.

Defined results: null and word-free texts have fingerprint zero and link like any other; repeated rows each
get a row; no rows give no rows; extra columns are ignored; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .components import components
from .shared import cut, partitions, small_batches

SEED, SHINGLE, MAX_BITS = 42, 4, 4
#: First bit and width of each of the seven blocks.
BLOCKS = ((0, 9), (9, 9), (18, 9), (27, 9), (36, 9), (45, 9), (54, 10))
KEYS = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS))
CHUNK, SALT = 1024, 64


def fingerprint_of(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: ASCII only
    if not words:
        return 0
    whole = b" ".join(words)
    n = len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    h = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and whatever columns docs has besides doc_id and text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.array([fingerprint_of(t) for t in f["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp": fp} | {c: f[c] for c in rest})

    kept = docs.select(F.col("doc_id").cast("long"), "text", *rest)
    schema = ", ".join(["doc_id long", "fp long", *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest]])
    return small_batches(kept).mapInPandas(each, schema)


def block_key(fp: Column, chosen: tuple[int, ...]) -> Column:
    key = F.lit(0).cast("long")
    for b in chosen:
        first, width = BLOCKS[b]
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1)))
    return key


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest over pairs of a x b (or within a, if b is a) at MAX_BITS or fewer differing bits."""
    nodes = np.concatenate([a, b]) if b is not a else a
    left, right = np.arange(len(a)), np.arange(len(b)) + (len(a) if b is not a else 0)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, label = [], np.arange(len(nodes))
    for i in left:
        near = np.bitwise_count(nodes[i] ^ nodes[right]) <= MAX_BITS
        js = right[near]
        if b is a:
            js = js[js > i]
        if len(js) > 8:  # one of each part found so far is enough
            js = js[np.unique(label[js], return_index=True)[1]]
        for j in js.tolist():
            x, y = find(int(i)), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(i), j))
        if not i % 64:
            label = np.fromiter(map(find, range(len(nodes))), np.int64, len(nodes))
    v = nodes.view(np.int64)
    return [(int(v[x]), int(v[y])) for x, y in out]


def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by unit (choice, key, lo, hi) -> forest links. A unit never holds over two chunks of rows."""
    held: list[tuple] = []
    last = None

    def links():
        fp = np.array([h[1] for h in held], np.int64).view(np.uint64)
        side = np.array([h[0] for h in held])
        _, _, lo, hi = last
        return forest(fp, fp) if lo == hi else forest(fp[side == lo], fp[side == hi])

    for f in frames:
        out = []
        for unit, chunk, fp in zip(zip(f["choice"], f["key"], f["lo"], f["hi"], strict=True), f["chunk"], f["fp"], strict=True):
            if unit != last:
                if len(held) > 1:
                    out += links()
                held, last = [], unit
            held.append((chunk, fp))
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    if len(held) > 1:
        yield pd.DataFrame(links(), columns=["u", "v"], dtype="int64")


def links(fps: DataFrame) -> DataFrame:
    """(u, v) links between distinct fingerprints: enough of them to connect all that are within MAX_BITS."""
    # each row becomes one for every choice, so the few bytes of a fingerprint are dealt to many tasks first
    distinct = fps.select("fp").distinct().repartition(2 * partitions(fps.sparkSession), "fp")
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), block_key(F.col("fp"), c).alias("key")) for i, c in enumerate(KEYS)])).alias("k"))
    # a window counts a key's rows where they are sorted anyway; it spills, and rows with a key of their own go no further
    n = F.count(F.lit(1)).over(W.partitionBy("choice", "key"))
    shared = keyed.select("fp", "k.choice", "k.key").withColumn("n", n).filter("n > 1")
    # a member's chunk comes from its own bits, so dealing needs no numbering; parts are sized for CHUNK on average
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    member = shared.withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = member.withColumn("other", F.explode(other)).select("choice", "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "fp")
    tasks = 2 * partitions(fps.sparkSession)
    return pairs.repartition(tasks, "choice", "key", "lo", "hi").sortWithinPartitions("choice", "key", "lo", "hi").mapInPandas(linked, "u long, v long").distinct()


def named(fps: DataFrame, name: Column) -> DataFrame:
    """(of, name): each distinct fingerprint and the least ``name`` (an expression over fps) of its whole component.

    Only fingerprints with links take part in the join by component. It is salted: a component's row goes out
    ``SALT`` times, so that one with a third of all fingerprints is dealt to as many tasks.
    """
    own = cut(fps.groupBy("fp").agg(F.min(name).alias("name")))
    roots = cut(components(links(fps)).withColumnsRenamed({"node": "fp"}))
    inside = roots.join(own, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int"))
    least = inside.groupBy("root", "salt").agg(F.min("name").alias("name")).groupBy("root").agg(F.min("name").alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    some = inside.join(least, ["root", "salt"]).select(F.col("fp").alias("of"), F.col("least").alias("name"))
    return own.join(roots, "fp", "left_anti").select(F.col("fp").alias("of"), "name").unionByName(some)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row."""
    fps = cut(fingerprints(docs.select("doc_id", "text")))
    by_fp = named(fps, F.col("doc_id"))
    out = fps.join(by_fp, fps["fp"] == by_fp["of"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("name").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, in the columns of docs.

    It is the row with the smallest id (null ids last); of rows that share that id, the one whose text and
    then whose other columns have the smallest XXH64. So a shared or null id loses no text that is not a
    near copy of one that stays, and reruns agree. Columns of maps, which have no hash, decide nothing.
    """
    cols = docs.columns
    hashed = [f"row.`{c}`" for c in cols if not isinstance(docs.schema[c].dataType, (MapType, VariantType))]
    rows = docs.select(F.struct(*cols).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"), F.xxhash64("row.text").alias("of_text"), F.xxhash64(*hashed).alias("of_row"))
    fps = cut(fingerprints(rows.drop("row")))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "of_text", "of_row")
    keep = named(fps, place).select("name.id", "name.no_id", "name.of_text", "name.of_row").distinct()
    key = ["id", "no_id", "of_text", "of_row"]
    rows = rows.select("row", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "of_text", "of_row")
    kept = rows.join(keep, key, "left_semi")
    first = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))  # rows alike in every column: any of them
    return kept.withColumn("n", first).filter("n = 1").select("row.*")
