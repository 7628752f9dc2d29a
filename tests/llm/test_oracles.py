"""The registered training-data queries against their SQL in DuckDB, on the smallest tables; repeated in op8's targets, which have SQL of their own."""

import os

import duckdb
import pytest

from quadrille.llm import oracles, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows_of(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, duck, name):
    cursor = duck.execute(oracles.ORACLES[name])
    names = [x[0] for x in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    df = queries.QUERIES[name](spark, DATA)
    assert set(df.columns) == set(names) and rows_of(df, names) == want


def test_sizes_and_targets_of_the_mix(spark, duck):
    """Targets by water filling in SQL: a source is full if its share at the level of those after it, by cap to weight, is above its cap."""
    sql = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size) AS size FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
        o AS (SELECT *, 2.0 * size AS cap, sum(1.5 * size) OVER () AS budget FROM w),
        l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
        v AS (SELECT arg_min(level, cap / w) FILTER (WHERE level <= cap / w) AS level FROM l)
        SELECT doc_id, d.size, l.size, least(cap, coalesce(w * v.level, cap)) FROM d JOIN l ON l.source IS NOT DISTINCT FROM d.source, v"""
    want = {r[0]: r[1:] for r in duck.execute(sql).fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.target) for r in queries.op8_source_mix(spark, DATA).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(float(want[k][2])) for k in got)
