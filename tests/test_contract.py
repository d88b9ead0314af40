"""Every core query with SQL against DuckDB on the smallest test data."""

import glob
import os

import pytest

from tramline import feedqueries, queries

DATA = os.environ.get("TRAMLINE_TESTDATA", "/root/testdata/sf0.001")
NAMED = {**queries.QUERIES, **feedqueries.QUERIES}
SQL = {**queries.SQL, **feedqueries.SQL}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = NAMED[name](spark, DATA)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    text = lambda row: tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(text(r[c] for c in cols) for r in got.collect()) == sorted(map(text, cur.fetchall()))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(NAMED)
