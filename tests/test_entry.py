"""The driver contract: each query against its SQL, or at least rows of a stable schema."""

import duckdb
import pytest

import __spark_entry__ as entry
from quernstone.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert rows
    if name in ORACLE:
        con = duckdb.connect()
        for table in TABLES:
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        found = con.sql(ORACLE[name])
        assert sorted(found.columns) == columns
        places = [found.columns.index(c) for c in columns]
        key = lambda row: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)
        assert sorted(map(key, rows)) == sorted(key(tuple(r[i] for i in places)) for r in found.fetchall())
