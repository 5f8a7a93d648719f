"""Benchmark corpora on folders written here."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.sources import corpus


def written(root, name, yaml, base="{}\n", best="{}\n"):
    (root / name).mkdir()
    for file, text in ((corpus.METADATA, yaml), (corpus.BASELINE, base), (corpus.OPTIMIZED, best)):
        if text is not None:
            (root / name / file).write_text(text)


def test_loads_all_tasks(spark, tmp_path):
    written(tmp_path, "T2", "id: two # remark\ntitle: \"A: b\"\ncategory: debug\nmodel: m-1\ncost_band: low\nnotes: 'x'\n", base="x" * 50)
    written(tmp_path, "T1", "# nothing\n\ncategory: unheard\r\n", base="x" * 9)
    written(tmp_path, "T3", "id: a\nid: three\nmodel_recommended: m-2\nmodel: no\n", base="x" * 20)
    (tmp_path / "loose.txt").write_text("no task")
    rows = corpus.load(spark, str(tmp_path)).collect()
    assert [r.task for r in rows] == ["T1", "T2", "T3"]
    one, two, three = rows
    assert (one.id, one.title, one.category, one.difficulty, one.model_recommended, one.estimated_cost_band, one.notes) == ("T1", "T1", "feature", "medium", "claude-opus-4", "medium", "")
    assert (two.id, two.title, two.category, two.model_recommended, two.estimated_cost_band, two.notes) == ("two", "A: b", "debug", "m-1", "low", "x")
    assert (three.id, three.title, three.model_recommended) == ("three", "three", "m-2")
    assert two.baseline.endswith(f"T2/{corpus.BASELINE}") and two.size == 53
    assert [r.task for r in corpus.quick(corpus.load(spark, str(tmp_path)), 2).collect()] == ["T1", "T3"]


def test_one_gap_fails_the_load(spark, tmp_path):
    written(tmp_path, "T1", "id: a\n")
    written(tmp_path, "T2", None, base=None)
    written(tmp_path, "T3", "id: c\n", base=None, best=None)
    with pytest.raises(corpus.IncompleteCorpus) as e:
        corpus.load(spark, str(tmp_path))
    said = str(e.value)
    assert "3 files" in said and f"T2/{corpus.METADATA}" in said and f"T3/{corpus.BASELINE}, T3/{corpus.OPTIMIZED}" in said
    assert f"T2/{corpus.BASELINE}" not in said and "T1" not in said


@pytest.mark.parametrize(
    ("line", "want"),
    [('a: "x # y"', [("a", "x")]), ("a:b", [("a", "b")]), ("a-b_1 :  c  ", [("a-b_1", "c")]), ("  a: b", []), ("1a: b", []), ("a:", [("a", "")]), ("#a: b", []), ('a: "', [("a", "")]), ("a: 'x\"", [("a", "'x\"")]), ("a: x#y", [("a", "x#y")])],
)
def test_pairs(spark, line, want):
    row = spark.createDataFrame([(line,)], "t string").select(corpus.pairs(F.col("t")).alias("p")).first()
    assert [(p.key, p.value) for p in row.p] == want
