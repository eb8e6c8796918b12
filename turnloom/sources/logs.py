"""Training logs: lines with their numbers, read by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUN = "run"


def read_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """(run, pos, value): the lines of a log in order, numbered from 0; empty lines are left out.

    Progress bars that overwrite a line count as lines, as carriage returns end lines
    like line feeds do. Files are read by byte ranges: a task counts the lines of its
    range, the counts of the ranges before it (one row per range) give its first
    number. Without `run` the folder is partitioned by it. Several files of a run follow
    each other by name.
    """
    lines = spark.read.text(path)
    named = lines.withColumn(RUN, F.lit(run)) if run is not None else lines
    # within a range ids grow with the lines, whichever task reads it
    placed = named.select(RUN, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value").where("value != ''")
    counts = placed.groupBy(RUN, "file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy(RUN).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(RUN, "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy(RUN, "file", "block").orderBy("id"))
    return placed.join(firsts, [RUN, "file", "block"]).select(RUN, (F.col("first") + nth - 1).alias("pos"), "value")
