"""Schemas of JSON lines, inferred over all lines, and lines typed by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def widened(found: T.DataType) -> T.DataType:
    """The type that rows get: numbers with fractions are doubles; what is always null, or of
    kinds that do not go together, is text (of JSON, where it is no string)."""
    if isinstance(found, T.StructType):
        return T.StructType([T.StructField(f.name, widened(f.dataType)) for f in found.fields])
    if isinstance(found, T.ArrayType):
        return T.ArrayType(widened(found.elementType))
    if isinstance(found, (T.DecimalType, T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(found, (T.NullType, T.VariantType)):
        return T.StringType()
    return found


def infer_schema(lines: DataFrame, column: str = "line") -> T.StructType:
    """The schema of all lines that are objects of JSON.

    Each line is parsed once, and each task sends one schema; schemas are joined
    key by key, in any order with the same result: a key may come late, null goes with every
    type, whole numbers with others to doubles, and what does not go together becomes text.
    """
    parsed = lines.select(F.try_parse_json(column).alias("v"))
    # a line that is no object would make the whole schema a text
    objects = parsed.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    found = objects.agg(F.schema_of_variant_agg("v").alias("s")).first()["s"]
    if found is None or not found.startswith("OBJECT"):
        return T.StructType([])
    return widened(T.DataType.fromDDL(_as_struct(found)))


def _as_struct(found: str) -> str:
    """OBJECT<...> of a schema's text as STRUCT<...>, outside of quoted names."""
    parts = found.split("`")
    return "`".join(p.replace("OBJECT<", "STRUCT<") if i % 2 == 0 else p for i, p in enumerate(parts))


def typed(lines: DataFrame, schema: T.StructType, column: str = "line") -> DataFrame:
    """The lines' fields, by one parse of each; a line that is no object has nulls."""
    return lines.select(F.from_json(column, schema).alias("r")).select("r.*")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Typed rows of files with one JSON object a line; blank lines are left out."""
    lines = spark.read.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "")
    return typed(lines, schema or infer_schema(lines))
