"""Every query of the catalogue beside its SQL on the smallest tables, in any partitioning."""

import os

import duckdb
import pytest

from lodestrata.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_rows_equal_sql(spark, con, name):
    got, want = QUERIES[name].plan(spark, SF), con.sql(QUERIES[name].sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    other = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    assert len(rows) == len(other)
    for a, b in zip(rows, other, strict=True):
        assert all(x == (pytest.approx(y, rel=1e-6, abs=1e-6) if isinstance(y, float) else y) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql and not n.startswith("e")))
def test_others_give_rows(spark, name):
    assert QUERIES[name].plan(spark, SF).count() > 0
