"""Reply envelopes, and replies as streams of server-sent events."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATA = "data: "
DONE = "[DONE]"
_NULLS = {"ignoreNullFields": "false"}


def new_id() -> Column:
    return F.concat(F.lit("chatcmpl-"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def completion(content: Column, model: Column, reply_id: Column, created: Column) -> Column:
    """A whole reply as JSON; usage is always 0."""
    message = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    usage = F.struct(*(F.lit(0).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")))
    return F.to_json(F.struct(reply_id.alias("id"), F.lit("chat.completion").alias("object"), created.alias("created"), model.alias("model"), F.array(choice).alias("choices"), usage.alias("usage")), _NULLS)


def completion_content(reply: Column) -> Column:
    return F.coalesce(F.get_json_object(reply, "$.choices[0].message.content"), F.lit(""))


def chunk(content: Column, model: Column, reply_id: Column, created: Column, finish: Column) -> Column:
    """One event; an empty content gives an empty delta."""
    delta = F.when(F.coalesce(content, F.lit("")) != "", F.create_map(F.lit("content"), content)).otherwise(F.create_map().cast("map<string,string>"))
    choice = F.struct(F.lit(0).alias("index"), delta.alias("delta"), finish.cast("string").alias("finish_reason"))
    return F.concat(F.lit(DATA), F.to_json(F.struct(reply_id.alias("id"), F.lit("chat.completion.chunk").alias("object"), created.alias("created"), model.alias("model"), F.array(choice).alias("choices")), _NULLS), F.lit("\n\n"))


def characters(replies: DataFrame, content: str = "content") -> DataFrame:
    """One row per code point: seq and piece; none for an empty reply."""
    pieces = F.when(F.coalesce(F.length(content), F.lit(0)) > 0, F.split(content, ""))
    return replies.select("*", F.posexplode(pieces).alias("seq", "piece")).drop(content)


def encode(replies: DataFrame, pieces: DataFrame, key: str, model: Column, created: Column, reply_id: Column) -> DataFrame:
    """All events of each reply: its pieces in order, a stop event, the end line.

    replies: key; pieces: key, seq, piece, of which empty ones are left out.
    """
    said = pieces.where(F.coalesce(F.length("piece"), F.lit(0)) > 0).select(key, F.lit(0).alias("part"), F.col("seq").cast("long").alias("seq"), chunk(F.col("piece"), model, reply_id, created, F.lit(None)).alias("event"))
    stop = replies.select(key, F.lit(1).alias("part"), F.lit(0).cast("long").alias("seq"), chunk(F.lit(""), model, reply_id, created, F.lit("stop")).alias("event"))
    done = replies.select(key, F.lit(2).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(f"{DATA}{DONE}\n\n").alias("event"))
    return said.unionAll(stop).unionAll(done)


def encode_characters(replies: DataFrame, key: str, model: Column, created: Column, reply_id: Column, content: str = "content") -> DataFrame:
    """encode() of a reply's characters, in one pass, and each event's position in its reply.

    Replies are dealt out by key while they are short; their events, each a
    hundred times a character, then need no shuffle to be put together by key.
    """
    pieces = F.when(F.coalesce(F.length(content), F.lit(0)) > 0, F.split(content, "")).otherwise(F.array().cast("array<string>"))
    dealt = replies.repartition(int(replies.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    ends = F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = dealt.withColumn("n", F.coalesce(F.length(content), F.lit(0))).select("*", F.posexplode(F.concat(pieces, ends)).alias("pos", "piece"))
    said, stop = F.col("pos") < F.col("n"), F.col("pos") == F.col("n")
    event = F.when(said | stop, chunk(F.col("piece"), model, reply_id, created, F.when(stop, "stop"))).otherwise(f"{DATA}{DONE}\n\n")
    return rows.select(key, F.when(said, 0).when(stop, 1).otherwise(2).alias("part"), F.when(said, F.col("pos")).otherwise(0).cast("long").alias("seq"), F.col("pos").cast("long").alias("position"), event.alias("event"))


def data_of(line: Column) -> Column:
    """What a line carries; null if it carries nothing."""
    body = F.substring(line, len(DATA) + 1, 2**31 - 1)
    return F.when(F.startswith(line, F.lit(DATA)) & (body != DONE), body)


_DELTA = T.StructType([T.StructField("choices", T.ArrayType(T.StructType([T.StructField("delta", T.StructType([T.StructField("content", T.StringType())]))])))])


def delta_of(data: Column) -> Column:
    """The first choice's new text; null where the JSON is broken or has none."""
    return F.nullif(F.get(F.from_json(data, _DELTA)["choices"], F.lit(0))["delta"]["content"], F.lit(""))


def joined(deltas: DataFrame, key: str, *order: str) -> DataFrame:
    """Content per key: the deltas one after the other; empty where there are none."""
    pieces = F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct(*order, "delta"))))
    return deltas.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p["delta"]), "").alias("content"))


def texts_of_reads(reads: DataFrame, key: str, order: str = "seq", data: str = "data") -> DataFrame:
    """Reads of bytes as reads of text: (key, order, data).

    A read gives the characters that end in it; bytes of one that is not over wait
    for the next read of the same reply. Bytes that are no UTF-8 become replacement
    characters, a byte order mark at the start is left out, and bytes that still
    wait after the last read are dropped, as a decoder that is never told of the end drops them. One
    shuffle and sort by reply; a task holds a decoder, not a reply.
    """
    schema = T.StructType([T.StructField("k", reads.schema[key].dataType), T.StructField("o", reads.schema[order].dataType), T.StructField("d", T.StringType())])
    rows = reads.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(data).alias("d")).repartition("k").sortWithinPartitions("k", "o")

    def run(batches):
        decoder, last = None, object()
        for batch in batches:
            texts = []
            for k, d in zip(batch.column("k").to_pylist(), batch.column("d").to_pylist(), strict=True):
                if k != last or decoder is None:
                    decoder, last = codecs.getincrementaldecoder("utf-8-sig")("replace"), k
                texts.append(decoder.decode(d or b""))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("o"), pa.array(texts, pa.string())], ["k", "o", "d"])

    return rows.mapInArrow(run, schema).select(F.col("k").alias(key), F.col("o").alias(order), F.col("d").alias(data))


def decode_bytes(reads: DataFrame, key: str, order: str = "seq", data: str = "data", mode: str = "lossy") -> DataFrame:
    """decode() of reads of bytes, wherever they cut characters and events."""
    return decode(texts_of_reads(reads, key, order, data), key, order, data, mode)


def decode(reads: DataFrame, key: str, order: str = "seq", data: str = "data", mode: str = "lossy") -> DataFrame:
    """Content per key from the texts of network reads.

    `lossy` takes each read apart by itself, so an event cut by a read boundary
    is lost; `buffered` joins the reads of a reply first.
    """
    if mode == "buffered":
        whole = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d"))))
        reads = reads.groupBy(key).agg(F.array_join(F.transform(whole, lambda r: r["d"]), "").alias(data)).withColumn(order, F.lit(0))
    lines = reads.select(key, order, F.posexplode(F.split(data, "\n")).alias("line_no", "line"))
    return joined(lines.select(key, order, "line_no", delta_of(data_of(F.col("line"))).alias("delta")), key, order, "line_no")
