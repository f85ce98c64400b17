"""The registered queries of the operators against DuckDB on the smallest tables, and their contracts."""

import os

import pytest

from callspark.llm import collocations, decontaminate, exact, fingerprints, mixing, ngram_join, repeats, secrets, sharding, toxicity, trie, url_filter

DATA = "/root/testdata/sf0.001"
MODULES = [collocations, decontaminate, exact, fingerprints, mixing, ngram_join, repeats, secrets, sharding, toxicity, trie, url_filter]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    return con


WHOLE = ["op12_collocations", "op13_prefix_trie"]


@pytest.mark.parametrize("name", WHOLE)
def test_same_tables(spark, tables, name):
    """Queries whose rows aren't those of a table."""
    out, want = QUERIES[name](spark, DATA), tables.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, out.select(names).collect())) == sorted(want.fetchall()) and sorted(out.columns) == sorted(names)


@pytest.mark.parametrize("name", [x for x in QUERIES if x not in WHOLE])
def test_same_rows(spark, tables, name):
    out = QUERIES[name](spark, DATA)
    table, key = ("pages", "page_id") if name == "op1_url_filter" else ("documents", "doc_id")
    got = {r[key]: r for r in out.collect()}
    assert sorted(got) == [r[0] for r in tables.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]
    if name in SQL:
        want = tables.execute(SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(out.columns)
        shown = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
        for row in want.fetchall():
            row = dict(zip(names, row, strict=True))
            assert {c: shown(got[row[key]][c]) for c in names} == {c: shown(row[c]) for c in names}
