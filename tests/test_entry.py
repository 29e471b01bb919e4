"""The driver contract, and each query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tagloom import queries as html

from .conftest import SF


def test_entry(spark):
    assert entry.entry(spark).count() == 50


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(html.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = html.QUERIES[name](spark, SF)
    cursor = con.execute(html.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))
