"""Every registered query with SQL against that SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from emberfield.plans import catalog, oracle

DATA = Path("/root/testdata/sf0.001")
SQL = oracle.sql()


def _plain(df):
    df = df[sorted(df.columns)]
    value = lambda x: None if x is None or x != x else (float(f"{x:.9g}") if isinstance(x, float) else x)
    return sorted((tuple(map(value, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.run(name, spark, str(DATA)).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _plain(got), _plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and math.isclose(u, v, abs_tol=2e-6))


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
def test_models_learn_more_than_the_largest_class(spark):
    got = {r["name"]: r["f1"] for r in catalog.run("train_fire_type", spark, str(DATA)).collect()}
    assert 0.5 < got["~accuracy"] <= 1
    batch = catalog.run("score_batch", spark, str(DATA)).collect()
    assert batch and all(abs(r["total"] - 1) < 1e-5 and r["confidence"] <= 1 for r in batch)
