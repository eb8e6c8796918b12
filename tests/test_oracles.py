"""Every registered query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from turnloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    names = sorted(table.column_names)
    return sorted((tuple(r[n] for n in names) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, DATA)
    theirs = duck.execute(catalog.ORACLES[name]).to_arrow_table()
    assert sorted(ours.columns) == sorted(theirs.column_names)
    assert rows(ours.toArrow()) == rows(theirs)
