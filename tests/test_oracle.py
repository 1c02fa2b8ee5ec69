"""Every query with SQL, run by both engines over the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import table
from checks.lake import RAW

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in RAW:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def test_registry():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 6


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[1]
        return
    rel = con.execute(SQL[name])
    want = table([c[0] for c in rel.description], rel.fetchall())
    assert got == want
