import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerspark.llm import secret_scan

from .test_knn_quality_simhash_mix import WORD, brute_classes, brute_mix, brute_quality


def test_stages_against_plain_python(spark, small):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    kept = [(i, left, s) for (i, _, s), (_, _, _, ok, left) in zip(rows, brute_quality(rows), strict=True) if ok]
    heads = {c for _, _, c in brute_classes([(i, t) for i, t, _ in kept])}
    alone = [r for r in kept if r[0] in heads]
    enc = secret_scan.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    masked = [(i, secret_scan.masked(t, secret_scan.spans_of(t, enc)[1]), s) for i, t, s in alone]
    mix = {i: (n, taken) for i, n, _, _, taken, *_ in brute_mix(masked)}
    text = {i: t for i, t, _ in masked}
    got = corpus_pipeline.run(spark, small).collect()
    rows_of = Counter(r.doc_id for r in got)
    assert set(rows_of) == {i for i, (_, taken) in mix.items() if taken}
    assert all(rows_of[i] == math.ceil(taken / n) for i, (n, taken) in mix.items() if taken)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    words = Counter()
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert sp.decode(ids) == r.text and len(ids) == r.n_tokens
        words[r.doc_id] += len(WORD.findall(r.text))
        if mix[r.doc_id][1] % mix[r.doc_id][0] == 0:  # only whole passes
            assert ids == sp.encode(text[r.doc_id], add_bos=True, add_eos=True)
    assert all(words[i] == taken for i, (_, taken) in mix.items())


def test_hostile_rows(spark, tmp_path):
    """Null and shared ids, clashing columns, empty and long texts, repeats: every stage keeps its columns and their values."""
    from .fixture_rows import DOCS, docs, none, prose

    apart = [prose(70) for _ in range(5)]
    more = [(None, apart[0], None, "web", 1, *["clash"] * 8), (None, apart[1], None, "web", 1, *["clash"] * 8), (77, apart[2], None, None, 1, *["clash"] * 8), (77, apart[3], None, None, 1, *["clash"] * 8), (78, apart[4], "en", "books", None, *["clash"] * 8)]
    df = docs(spark).unionByName(spark.createDataFrame(more, DOCS))
    for c in ("size", "k", "_words", "_hash", "salt", "rank", "slot", "pass", "id", "of_text", "no_id", "part", "parts", "hash", "gone", "d", "name"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.dtypes == now.dtypes
        assert all(r[c] == f"own {c}" for r in after.collect() for c in ("size", "k", "_words", "_hash", "salt", "rank", "slot", "hash", "name"))
        now = after
    left = {r.text for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert set(apart) <= left
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count() > 5
    none(spark).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
