"""Every query that has SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import pytest

from callspark.jobs import queries

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    return con


def rows_of(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted(names), sorted(tuple(shown(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, tables, name):
    out = queries.QUERIES[name](spark, DATA)
    want = tables.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert rows_of(out.collect(), out.columns) == rows_of(want.fetchall(), names)


def test_every_query_has_sql():
    assert set(queries.SQL) == set(queries.QUERIES)
