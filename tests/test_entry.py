"""The driver's contract: every engine query has SQL, and both give the same rows."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.engine.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda rs: sorted(map(repr, rs))
    order = [want.columns.index(c) for c in cols]
    assert rows(tuple(r[c] for c in cols) for r in got.collect()) == rows(tuple(r[i] for i in order) for r in want.fetchall())
