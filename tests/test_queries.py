"""Every registered query of the session-log library against its SQL twin, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from ledgerspark.plans import registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, TABLES).toPandas()
    want = duck.execute(registry.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False, name=None)), key=str) for df in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-6) for u, v in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
