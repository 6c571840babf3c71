"""Every named query against its SQL in DuckDB, on the smallest data set."""

import os

import duckdb
import pytest

from foliant.plans.registry import load_all
from foliant.plans.views import RAW

FOLDER = os.environ.get("FOLIANT_CHECK_DIR", "/root/testdata/sf0.001")
QUERIES = load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in RAW:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def _plain(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    named = QUERIES[name]
    columns = [c for c, _ in named.columns]
    df = named.run(spark, FOLDER)
    assert df.columns == columns
    got = sorted([_plain(v) for v in row] for row in map(tuple, df.collect()))
    sql = named.check_sql()
    if sql is None:
        assert got
        return
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql}) checked").fetchall()
    assert got == sorted([_plain(v) for v in row] for row in want)
