"""All registered queries that have SQL side by side with their SQL in DuckDB, and the contract of the registry."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from scanloom.jobs.oracles import oracle_sql
from scanloom.jobs.queries import queries

TABLES = "documents embeddings pages labels conversations lineitem".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


@pytest.fixture(scope="module")
def tables(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_equal_sql(spark, sf, tables, name):
    expected = tables.sql(oracle_sql()[name])
    found = queries()[name](spark, sf)
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    left = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert left == sorted((tuple(plain(r[i]) for i in places) for r in expected.fetchall()), key=repr)


def test_registry():
    known = entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(known) and set(oracle_sql()) <= set(queries())
