"""Registration of queries with their DuckDB counterparts, and what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import conversations as C
from turnloom.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.nest(turns_of(spark, sf_dir))


def long(column, name: str):
    return column.cast("long").alias(name)


def digest(messages, name: str = "digest"):
    """Roles and contents as one hash."""
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("")))), "|")).alias(name)


def values(rows) -> str:
    """Rows as a VALUES list for DuckDB."""
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    return ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows)


#: For DuckDB: messages m of a conversation, and their hash.
NEST = "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id"
DIGEST = "md5(array_to_string(list_transform({m}, lambda x: concat(x.role, ':', x.content)), '|'))"
