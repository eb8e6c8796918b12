"""Chat requests and client settings: projection and default rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.config import DEFAULTS, Settings
from turnloom.functions.text import if_absent, if_null, int_or_default, is_greedy, or_default, text_or_default

REQUEST = "model string, messages array<struct<role:string,content:string>>, temperature double, top_p double, max_tokens int, stream boolean"


def parse_requests(bodies: DataFrame, body: str = "body", gpu: bool = False, settings: Settings = DEFAULTS) -> DataFrame:
    """Requests from JSON bodies: unknown fields dropped, absent ones with their defaults, given nulls kept."""
    parsed, keys = F.from_json(body, REQUEST), F.json_object_keys(body)
    absent = lambda name, default: if_absent(parsed[name], F.array_contains(keys, name), default).alias(name)
    return bodies.select(
        *[c for c in bodies.columns if c != body],
        absent("model", settings.model_name),
        parsed["messages"].alias("messages"),
        absent("temperature", settings.temperature),
        absent("top_p", settings.top_p),
        absent("max_tokens", settings.max_tokens_gpu if gpu else settings.max_tokens),
        absent("stream", settings.stream),
    )


def generation_params(requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """What generation gets: null and 0 give defaults, on either server; sampling values are null where greedy."""
    temperature, top_p = or_default(F.col("temperature"), settings.temperature), or_default(F.col("top_p"), settings.top_p)
    greedy = is_greedy(temperature)
    return requests.withColumns({
        "greedy": greedy,
        "temperature": F.when(~greedy, temperature),
        "top_p": F.when(~greedy, top_p),
        "max_tokens": or_default(F.col("max_tokens"), settings.max_tokens),
    })


def load_settings(saved: DataFrame, settings: Settings = DEFAULTS, api_url: str = "http://127.0.0.1:8000/v1") -> DataFrame:
    """Client settings with their defaults: texts where empty, numbers only where null."""
    return saved.withColumns({
        "api_url": text_or_default(F.col("api_url"), api_url),
        "temperature": if_null(F.col("temperature"), settings.temperature),
        "top_p": if_null(F.col("top_p"), settings.top_p),
        "stream_mode": if_null(F.col("stream_mode"), True),
        "history_length": int_or_default(F.col("history_length").cast("string"), settings.history_length),
        "max_tokens": int_or_default(F.col("max_tokens").cast("string"), settings.max_tokens_gpu),
        "system_prompt": text_or_default(F.col("system_prompt"), settings.default_system),
    })


def model_listing(spark: SparkSession, created: int, settings: Settings = DEFAULTS, owner: str = "local") -> DataFrame:
    return spark.createDataFrame([("list", settings.model_name, "model", created, owner)], "list_object string, id string, object string, created long, owned_by string")


def models_of(requests: DataFrame, model: str = "model", created: str = "created", owner: str = "local") -> DataFrame:
    """One row for each model that requests name, since the first of these."""
    rows = requests.groupBy(F.col(model).alias("id")).agg(F.min(created).cast("long").alias("created"))
    return rows.select(F.lit("list").alias("list_object"), "id", F.lit("model").alias("object"), "created", F.lit(owner).alias("owned_by"))


def with_status(replies: DataFrame, status: Column, content: str = "content") -> DataFrame:
    """Failed requests show their error as content and are not stored."""
    failed = (status < 200) | (status > 299)
    return replies.withColumns({"stored": ~failed, content: F.when(failed, F.concat(F.lit("HTTP "), status.cast("string"))).otherwise(F.col(content))})
