"""The engine's registered queries against DuckDB on the same tables."""

import os

import duckdb
import pytest

from pipeloom.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DIR}/{t}'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        cur = con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert normal(rows, df.columns) == normal(cur.fetchall(), columns)
    else:
        assert rows
