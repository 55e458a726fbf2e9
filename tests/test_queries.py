"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")) or n == "open_relay"))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    expected = duck.execute(entry.oracle_sql()[name])
    assert plain(df.columns, df.collect()) == plain([c[0] for c in expected.description], expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
