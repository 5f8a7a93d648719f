"""Prices: which table holds on a date, which row holds for a model, what a request costs.

Price rows: as_of (date), provider, model, input, output, cache_read, cache_write, cache_write_1h (dollars a
million tokens), long_over (tokens of prompt above which the long_ rates hold), long_input ... They are a few
dozen rows, so they are broadcast; PRICE_ROWS is the bound that is checked first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RATES = ("input", "output", "cache_read", "cache_write", "cache_write_1h")
DATE_SUFFIX = r"-(\d{8}|\d{4}-\d{2}-\d{2})$"
PRICE_ROWS = 100_000
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def small(prices: DataFrame, most: int = PRICE_ROWS) -> DataFrame:
    """Price rows with a broadcast hint if there are at most ``most`` of them, else as they are (a shuffle join then). Only they are counted."""
    return F.broadcast(prices) if prices.limit(most + 1).count() <= most else prices


def calendar(prices: DataFrame, undated: tuple[str, ...] = ()) -> DataFrame:
    """Price rows with the days on which each holds, from valid_from up to, but not on, valid_to.

    A provider's table holds from its date to the next one's, the oldest before that too; a model that it lacks is
    priced by the newest table. Of providers in ``undated`` the newest table holds on all days, for models
    that no other has.
    """
    first, last = F.to_date(F.lit(FIRST_DAY)), F.to_date(F.lit(LAST_DAY))
    own = prices.filter(~F.col("provider").isin(*undated)) if undated else prices
    tables = own.select("provider", "as_of").distinct()
    order = W.partitionBy("provider").orderBy("as_of")  # one row per table
    spans = tables.withColumn("valid_from", F.when(F.row_number().over(order) == 1, first).otherwise(F.col("as_of"))).withColumn("valid_to", F.coalesce(F.lead("as_of").over(order), last))
    held = own.join(spans, ["provider", "as_of"])
    newest = own.join(tables.groupBy("provider").agg(F.max("as_of").alias("as_of")), ["provider", "as_of"])
    lacking = newest.join(spans.select("provider", "valid_from", "valid_to"), "provider").join(held.select("provider", "model", "valid_from"), ["provider", "model", "valid_from"], "left_anti")
    out = held.unionByName(lacking)
    if undated:
        other = prices.filter(F.col("provider").isin(*undated))
        other = other.join(other.groupBy("provider").agg(F.max("as_of").alias("as_of")), ["provider", "as_of"]).join(out.select("model"), "model", "left_anti")
        out = out.unionByName(other.withColumn("valid_from", first).withColumn("valid_to", last))
    return out


def prices_on(prices: DataFrame, day: Column, undated: tuple[str, ...] = ()) -> DataFrame:
    """Price rows that hold on a date: the provider's latest table not after it, else its oldest; models it lacks come from the newest."""
    return calendar(prices, undated).filter((F.col("valid_from") <= day) & (day < F.col("valid_to"))).select(*prices.columns)


#: The names of the rates in price files. All but the last must be there.
IN_FILES = {"input": "input_per_mtok", "output": "output_per_mtok", "cache_read": "cache_read_per_mtok", "cache_write": "cache_creation_per_mtok", "cache_write_1h": "cache_creation_1h_per_mtok"}
NEEDED = RATES[:4]
UNDATED = ("openai",)


def price_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Price rows from dated JSON files: {"as_of": day, "models": {name: {rate: dollars a million tokens, "long_prompt": {"over_tokens": n, rate: ...}}}}.

    A file whose name (or folder's name) is a date with ``openai-`` before it is that provider's, any other the agent's own.
    A row, or a long_prompt, without one of the four needed rates is an error: its model would cost nothing.
    """
    rates = ", ".join(f"{x}: double" for x in IN_FILES.values())
    t = spark.read.schema(f"as_of string, models map<string, struct<{rates}, long_prompt: struct<over_tokens: double, {rates}>>>").option("multiLine", True).json(paths)
    provider = F.when(F.col("_metadata.file_path").rlike(r"[/=]openai-\d{4}-\d{2}-\d{2}[^/]*(/[^/]*)?$"), "openai").otherwise("anthropic")
    t = t.select(F.to_date("as_of").alias("as_of"), provider.alias("provider"), F.explode("models").alias("model", "r"))
    long = F.col("r.long_prompt")
    lacks = lambda x: F.greatest(*[x[IN_FILES[k]].isNull() for k in NEEDED])
    bad = lacks(F.col("r")) | (long.isNotNull() & (lacks(long) | long["over_tokens"].isNull()))
    first = F.when(bad, F.raise_error(F.concat(F.lit("a price row lacks rates: "), F.col("model"))).cast("double")).otherwise(F.col(f"r.{IN_FILES['input']}"))
    own = [first.alias("input"), *[F.col(f"r.{IN_FILES[k]}").alias(k) for k in RATES[1:]]]
    return t.select("as_of", "provider", "model", *own, long["over_tokens"].cast("long").alias("long_over"), *[long[IN_FILES[k]].alias(f"long_{k}") for k in RATES])


def cost(price: Column) -> Column:
    """Dollars of a request with columns input, output, cache_read, cache_write, cache_write_1h; null without a price.

    Above the long-prompt threshold (strictly) every rate is the long one. One-hour writes are part of the
    writes, at twice the input rate unless the table has a rate of its own.
    """
    long = F.coalesce(F.col("input") + F.col("cache_read") + F.col("cache_write") > price["long_over"], F.lit(False))
    rate = {r: F.when(long, F.coalesce(price[f"long_{r}"], price[r])).otherwise(price[r]) for r in RATES}
    hour = F.greatest(F.lit(0), F.least(F.col("cache_write_1h"), F.col("cache_write")))
    hour_rate = F.coalesce(rate["cache_write_1h"], rate["input"] * 2)
    spent = F.col("input") * rate["input"] + F.col("output") * rate["output"] + F.col("cache_read") * rate["cache_read"]
    return (spent + (F.col("cache_write") - hour) * rate["cache_write"] + hour * hour_rate) / 1_000_000


def priced(requests: DataFrame, prices: DataFrame, aliases: DataFrame | None = None, day: Column | None = None) -> DataFrame:
    """requests with price and usd (0 without a price) and priced (whether there is one).

    A price is there if its four needed rates are. A model's row is the one of its name, else of what its alias names, else of its name without a date at the
    end. With ``day`` (of the session), prices is a calendar() and each request meets the table of its day. Price rows are
    the small side of each join; requests are neither counted nor shuffled.
    """
    dated = day is not None
    rates = [c for c in prices.columns if c not in ("as_of", "provider", "model", "valid_from", "valid_to")]
    span = ["valid_from", "valid_to"] if dated else []
    rows = small(prices.groupBy("model", *span).agg(F.min_by(F.struct(*rates), "provider").alias("r")))
    out = requests.withColumns({"_plain": F.regexp_replace("model", DATE_SUFFIX, ""), "_day": day if dated else F.lit(None)})
    names = [("model", rows), ("_plain", rows)]
    if aliases is not None:
        names.insert(1, ("model", small(aliases.join(rows, "model").select(F.col("alias").alias("model"), *span, "r"))))
    for k, (name, found) in enumerate(names):
        p = found.select(F.col("model").alias(f"_m{k}"), F.col("r").alias(f"_r{k}"), *[F.col(c).alias(f"_{c}{k}") for c in span])
        on = F.col(name) == F.col(f"_m{k}")
        if dated:
            on = on & (F.col("_day") >= F.col(f"_valid_from{k}")) & (F.col("_day") < F.col(f"_valid_to{k}"))
        out = out.join(p, on, "left")
    out = out.withColumn("price", F.coalesce(*[f"_r{k}" for k in range(len(names))])).select(*requests.columns, "price")
    has = F.col("price").isNotNull()
    for k in NEEDED:
        has = has & F.col(f"price.{k}").isNotNull()
    return out.withColumn("usd", F.coalesce(cost(F.col("price")), F.lit(0.0))).withColumn("priced", has)


def total_tokens() -> Column:
    return F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")


def unpriced(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Usage without a price: tokens, requests, sorted models; requests: output of priced()."""
    some = requests.filter((total_tokens() > 0) & ~F.col("priced"))
    return some.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(total_tokens()), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("requests"), F.array_sort(F.collect_set(F.coalesce("model", F.lit("(unknown model)")))).alias("models")
    )
