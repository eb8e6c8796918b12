"""Training plans and training logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.config import DEFAULTS

LOG = "loss double, grad_norm double, learning_rate double, entropy double, num_tokens double, mean_token_accuracy double, epoch double"
SUMMARY = "train_runtime double, train_samples_per_second double, train_steps_per_second double, train_loss double, entropy double, num_tokens double, mean_token_accuracy double, epoch double"


def total_steps(rows: Column, epochs: Column, batch: int = DEFAULTS.batch_size) -> Column:
    return (epochs * F.ceil(rows / batch)).cast("long")


def warmup_steps(total: Column, share: float = DEFAULTS.warmup_share) -> Column:
    return F.ceil(F.lit(share) * total).cast("long")


def learning_rates(spark: SparkSession, total: int, peak: float = DEFAULTS.peak_rate, share: float = DEFAULTS.warmup_share) -> DataFrame:
    """Rate as logged at steps 1 to total: linear warm-up, then a half cosine."""
    warm = math.ceil(share * total)
    t = F.col("step") - 1
    cosine = 0.5 * (1 + F.cos(F.lit(math.pi) * (t - warm) / max(total - warm, 1)))
    rate = F.when(t < warm, F.lit(peak) * t / max(warm, 1)).otherwise(F.lit(peak) * cosine)
    return spark.range(1, total + 1).select(F.col("id").alias("step"), rate.alias("learning_rate"))


def parse_log(lines: DataFrame, line: str = "value", run: str = "run", position: str = "pos", every: int = DEFAULTS.log_steps) -> DataFrame:
    """Log rows of each run with their step; other lines are skipped."""
    rows = lines.where(F.startswith(line, F.lit("{'loss'"))).select(run, position, F.from_json(line, LOG).alias("r")).select(run, position, "r.*")
    nth = F.row_number().over(Window.partitionBy(run).orderBy(position))
    return rows.withColumn("step", (nth * every).cast("long")).drop(position)


def run_summaries(lines: DataFrame, line: str = "value", run: str = "run") -> DataFrame:
    """The closing row of each run, with tokens per second."""
    rows = lines.where(F.startswith(line, F.lit("{'train_runtime'"))).select(run, F.from_json(line, SUMMARY).alias("r")).select(run, "r.*")
    return rows.withColumn("tokens_per_second", F.col("num_tokens") / F.col("train_runtime"))


def token_steps(log: DataFrame, run: str = "run") -> DataFrame:
    """Tokens between log rows, from the running total."""
    before = F.lag("num_tokens", 1, 0.0).over(Window.partitionBy(run).orderBy("step"))
    return log.withColumn("new_tokens", F.col("num_tokens") - before)


def running_tokens(steps: DataFrame, run: str = "run", tokens: str = "new_tokens") -> DataFrame:
    return steps.withColumn("total_tokens", F.sum(tokens).over(Window.partitionBy(run).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
