"""Every offending sentence is located."""

import numpy as np

from ledgerspark.llm import toxicity


def bad_words():
    theta = np.zeros(toxicity.SLOTS + 1, np.float32)
    theta[toxicity.slot("grudok")], theta[-1] = 8, -6
    return theta


def test_every_offending_sentence_is_located(spark):
    texts = ["one grudok. fine here! Grudok again? plain", "nothing", None, "İ x. İİ grudok.İ grudok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, bad_words()).collect()}
    cut = {i: [texts[i][s.start : s.end] for s in r.offending] for i, r in got.items()}
    assert cut == {0: ["one grudok", " Grudok again"], 1: [], 2: [], 3: [" İİ grudok", "İ grudok"]}
    assert all(s.score >= toxicity.OFFENDS for r in got.values() for s in r.offending)
    assert all(r.worst_score == max(s.score for s in r.offending) for r in got.values() if r.offending)
