"""Every registered query against its comparison SQL on the driver tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'")
    return connection


def cell(v):
    return ("float", repr(v)) if isinstance(v, float) else (type(v).__name__, str(v))


def normal(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in records])


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, DIRECTORY)
    sql = entry_module.oracle_sql()[name]
    expected = duck.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    assert normal(df.columns, df.collect()) == normal(expected.columns, expected.fetchall())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
