"""Request files in, event files out, each request answered once.

Requests are lines of JSON with a `request_id` beside the fields of a chat
request. What answers them is a function from a table of parsed requests to
(request_id, content). A batch's events are written as one part of a versioned table
under the batch's name, and count once the part is committed; a batch that is run again
after a failure finds its part committed, or writes it anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.config import DEFAULTS
from turnloom.operators import requests as R
from turnloom.operators import streams as S
from turnloom.sources.shared import delete
from turnloom.sources.versions import VersionedTable

EVENTS = "request_id string, position long, event string"


def read_requests(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """(request_id, body): lines of request files as they arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    return lines.select(F.get_json_object("value", "$.request_id").alias("request_id"), F.col("value").alias("body")).where("request_id IS NOT NULL")


def events_of(replies: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, position, event): streamed replies as events by character, whole ones as one body; in order in each file."""
    told = requests.select("request_id", "model", F.coalesce("stream", F.lit(False)).alias("stream")).join(replies, "request_id")
    # a request's clock and id do not change when its batch is run again
    clock, name = F.lit(0), F.concat(F.lit("chatcmpl-"), F.md5("request_id"))
    live = S.encode_characters(told.where("stream"), "request_id", F.col("model"), clock, name).select("request_id", "position", "event")
    whole = told.where("NOT stream").select("request_id", F.lit(0).cast("long").alias("position"), S.completion(F.col("content"), F.col("model"), name, clock).alias("event"))
    return live.unionAll(whole).repartition("request_id").sortWithinPartitions("request_id", "position")


def serve_available(requests: DataFrame, respond: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Answers all requests that have arrived. Progress is kept beside `out`, so a later call goes on from there."""
    table = VersionedTable(requests.sparkSession, out)

    def answer(batch: DataFrame, number: int) -> None:
        part = f"batch-{number:012d}"
        if part in table.parts()[1]:
            return  # committed before the failure
        delete(table.spark, table.place(part))  # written, but not committed
        # of requests with one id in one batch the first body counts
        once = batch.groupBy("request_id").agg(F.min("body").alias("body"))
        parsed = R.parse_requests(once, settings=DEFAULTS)
        table.write(events_of(respond(parsed), parsed), part)
        table.change(lambda _, parts: [*parts, part])

    requests.writeStream.foreachBatch(answer).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()


def answered(spark: SparkSession, out: str) -> DataFrame:
    """All events of committed batches."""
    rows = VersionedTable(spark, out).read()
    return spark.createDataFrame([], EVENTS) if rows is None else rows
