"""Queries of the llm operators with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from turnloom.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(table):
    names = sorted(table.column_names)
    return sorted((tuple(r[n] for n in names) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, DATA), duck.execute(ORACLES[name]).to_arrow_table()
    assert sorted(ours.columns) == sorted(theirs.column_names)
    assert {f.name: str(f.type) for f in ours.toArrow().schema} == {f.name: str(f.type) for f in theirs.schema}
    assert rows(ours.toArrow()) == rows(theirs)
