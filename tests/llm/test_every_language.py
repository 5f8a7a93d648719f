"""Every language is learned."""

from pyspark.sql import functions as F

from ledgerspark.llm import langid


def test_every_language_is_sampled(spark):
    data = [(i, f"text {i}", f"l{i % 45:02d}" if i % 45 != 44 or i < 450 else "l00") for i in range(4500)]  # l44 is the rarest
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    counts = {}
    for _, x in langid.sample(df, 900):
        counts[x] = counts.get(x, 0) + 1
    assert len(counts) == 45 and counts.pop("l44") == 10 and set(counts.values()) == {20}
    assert len({x for _, x in langid.sample(df, 45)}) == 45 and len(langid.sample(df, 45)) == 45 * langid.LEAST


def test_the_smallest_hashes_are_found_by_buckets(spark):
    ids = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("lang"))
    got = {(r.lang, r.doc_id): r.k for r in langid.smallest(ids, 1200).collect()}
    rows = sorted((r.lang, r.h, r.doc_id) for r in ids.withColumn("h", F.xxhash64("doc_id")).collect())
    want = {}
    for x in "ab":
        want |= {(x, i): k for k, (lang, _, i) in enumerate((r for r in rows if r[0] == x), 1) if k <= 1200}
    assert got == want
    # what is ranked for a language is little more than what is asked for, however many ids it has
    near = langid.smallest(ids, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in near and langid.smallest(ids, 30).count() == 60


def test_more_than_forty_languages_are_told_apart(spark):
    data = [(i, "".join(chr(0x3000 + 64 * x + (i + j) % 9) if j % 5 else " " for j in range(60)), f"l{x:02d}") for i in range(44 * 20) for x in [i % 44]]
    got = langid.label(spark.createDataFrame([(i, t + " abc", x) for i, t, x in data], "doc_id long, text string, lang string"), steps=60)
    assert {r.lang_pred for r in got.select("lang_pred").distinct().collect()} - {"und"} and got.count() == len(data)
    assert got.filter(F.col("lang_pred") == "l43").count() > 0
