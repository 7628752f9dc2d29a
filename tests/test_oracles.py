"""Every registered raster query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from quadrille.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in Q.ORACLES:
        return
    cursor = duck.execute(Q.ORACLES[name])
    have = [x[0] for x in cursor.description]
    assert sorted(have) == columns
    want = sorted((tuple(r[have.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)
