"""Registered queries over streams that are written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.config import DEFAULT_SYSTEM
from turnloom.operators import streams as S
from turnloom.plans.registry import digest, long, query, turns_of
from turnloom.sources.shared import scratch
from turnloom.streaming import endpoint, sessions

_HISTORY = 4


@query(f"""
WITH s AS (SELECT *, coalesce(last_value(CASE WHEN role = 'system' AND trim(text) <> '' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '{DEFAULT_SYSTEM}') AS prompt FROM conversations),
m AS (SELECT *, array_agg(concat(role, ':', text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {_HISTORY - 1} PRECEDING AND CURRENT ROW) AS shown FROM s WHERE role IN ('user', 'assistant'))
SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn AS BIGINT) AS seq, CAST(len(shown) + 1 AS BIGINT) AS n_messages, md5(concat('system:', prompt, '|', array_to_string(shown, '|'))) AS digest
FROM m WHERE role = 'user'""")
def stream_sessions(spark, sf_dir):
    """Turns that arrive over several batches, out of order and partly twice, become the prompts of their sessions."""
    place = scratch(spark, "sessions")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn"))
    events = turns_of(spark, sf_dir).select(F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("long").alias("seq"), F.col("role").alias("kind"), F.col("text").alias("content"), at.alias("at"))
    again = events.where("seq % 3 = 1")
    events.unionAll(again).repartition(4, F.xxhash64("session", "seq") % 4).write.json(f"{place}/events")
    sessions.run_available(sessions.read_events(spark, f"{place}/events", 1), f"{place}/prompts", DEFAULT_SYSTEM, _HISTORY)
    rows = spark.read.schema(sessions.PROMPTS).parquet(f"{place}/prompts")
    return rows.select("session", "seq", long(F.size("messages"), "n_messages"), digest(F.col("messages")))


@query("""
SELECT concat_ws('-', conv_id, turn) AS request_id, CAST(CASE WHEN turn % 3 = 0 THEN 1 ELSE length(text) + 2 END AS BIGINT) AS n_events, md5(text) AS content FROM conversations WHERE role = 'user'""")
def request_files(spark, sf_dir):
    """Requests that arrive in files over two runs, answered with what they ask; every third whole, the others streamed."""
    place = scratch(spark, "requests")
    asked = turns_of(spark, sf_dir).where("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"), (F.col("turn") % 3 != 0).alias("stream"), F.col("conv_id").alias("c")
    )
    respond = lambda requests: requests.select("request_id", F.col("messages")[0]["content"].alias("content"))
    for half in (0, 1):
        part = asked.where(f"c % 2 = {half}")
        part.select(F.to_json(F.struct("request_id", "messages", "stream")).alias("value")).repartition(3).write.mode("append").text(f"{place}/in")
        endpoint.serve_available(endpoint.read_requests(spark, f"{place}/in", 2), respond, f"{place}/out")
    events = endpoint.answered(spark, f"{place}/out")
    streamed = S.decode(events.where("startswith(event, 'data: ')"), "request_id", "position", "event")
    whole = events.where("NOT startswith(event, 'data: ')").select("request_id", S.completion_content(F.col("event")).alias("content"))
    counts = events.groupBy("request_id").agg(long(F.count("*"), "n_events"))
    return streamed.unionAll(whole).join(counts, "request_id").select("request_id", "n_events", F.md5("content").alias("content"))
