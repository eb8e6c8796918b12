"""Small helpers about columns that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of the struct in which an operator carries its input's columns, so that none meets its own.
ROW = "tl_row"


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns whose names, in any case, an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def text_of(df: DataFrame, name: str = "text") -> T.StructField:
    field = df.schema[name]
    if not isinstance(field.dataType, T.StringType):
        raise TypeError(f"column {name} must be a string, not {field.dataType.simpleString()}")
    return field


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])


def boxed(df: DataFrame, carried: list[str], **named) -> DataFrame:
    """One struct of the carried columns, and further columns by name."""
    row = F.struct(*([F.col(f"`{c}`") for c in carried] or [F.lit(None).cast("int").alias("tl_none")]))
    return df.select(row.alias(ROW), *(c.alias(n) for n, c in named.items()))


def unboxed(carried: list[str]) -> list:
    return [F.col(f"{ROW}.`{c}`").alias(c) for c in carried]
