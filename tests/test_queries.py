"""Every core query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__
from tallyloom.plans import queries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_query(spark, sql, name):
    found = queries.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted(repr(tuple(r)) for r in found.select(*columns).collect())
    result = sql.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
