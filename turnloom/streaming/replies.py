"""Replies put together from a stream of event lines.

Every reply is one group. What a task reads of a reply at one time goes to its group as
one row, a chunk, so the shuffle carries texts and not lines. Each batch adds one entry with its lines to the reply's
state, unless the reply is over with them, and the entries are only read when the reply may be over, so the work
grows with the lines, in however many batches they come. Of lines with the same number the
first counts. A reply is given out once: when its end line and all lines before it have come, or when
event time has passed its last line by `late`. Then its lines are dropped and
a mark stays until event time has passed once more by `late`; later lines of it
are behind the watermark, so they cannot open it again. State holds open replies, and
marks of those that ended lately.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnloom.operators.streams import data_of, delta_of, joined
from turnloom.streaming.states import append_available

LINES = "reply_id string, seq long, line string, at timestamp"
REPLIES = "reply_id string, content string, done boolean"
_FACTS = T.StructType([T.StructField("ends", T.LongType()), T.StructField("lines", T.LongType()), T.StructField("latest", T.LongType()), T.StructField("due", T.LongType()), T.StructField("given", T.BooleanType())])
#: Lines of one reply and time: their pieces as one text, the length of each, its number less the one before it, and the number of the end line.
_SENT = "reply_id string, at timestamp, steps array<long>, sizes array<int>, text string, ends long"
_CHUNK = T.StructType([T.StructField("seqs", T.ArrayType(T.LongType())), T.StructField("pieces", T.ArrayType(T.StringType()))])


def read_lines(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Event lines from JSON files as they arrive."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", per_trigger).json(path)


def deltas(lines: DataFrame) -> DataFrame:
    return lines.select("reply_id", "seq", "at", delta_of(data_of(F.col("line"))).alias("delta"), (F.col("line") == "data: [DONE]").alias("done"))


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = pa.Table.from_batches([batch])
        keys = ["reply_id", "at"]
        if lines.group_by(["reply_id", "seq"], use_threads=False).aggregate([]).num_rows < lines.num_rows:
            # numbers come twice: each line by itself, so that the first one stays the first
            lines, keys = lines.append_column("line", pa.array(np.arange(lines.num_rows))), [*keys, "line"]
        chunks = lines.group_by(keys, use_threads=False).aggregate([("seq", "list"), ("delta", "list"), ("ends", "min")]).combine_chunks()
        if not chunks.num_rows:
            continue
        seqs, pieces = chunks["seq_list"].chunk(0), chunks["delta_list"].chunk(0)
        starts, numbers = seqs.offsets, seqs.values.to_numpy()
        steps, first = np.diff(numbers, prepend=0), starts.to_numpy()[:-1]
        steps[first] = numbers[first]
        yield pa.RecordBatch.from_arrays(
            [
                chunks["reply_id"].chunk(0), chunks["at"].chunk(0), pa.ListArray.from_arrays(starts, pa.array(steps)),
                pa.ListArray.from_arrays(starts, pc.utf8_length(pieces.values)), pc.binary_join(pieces, ""), chunks["ends_min"].chunk(0),
            ],
            ["reply_id", "at", "steps", "sizes", "text", "ends"],
        )


def chunks(lines: DataFrame) -> DataFrame:
    """Chunks of numbered lines, within what a task reads at once."""
    rows = deltas(lines.where("reply_id IS NOT NULL AND seq IS NOT NULL"))
    told = rows.select("reply_id", "at", "seq", F.coalesce("delta", F.lit("")).alias("delta"), F.when(F.col("done") & (F.col("seq") >= 0), F.col("seq")).alias("ends"))
    return told.mapInArrow(_chunks_of, _SENT)


class Replies(StatefulProcessor):
    def __init__(self, late_ms: int):
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", _FACTS)
        self.chunks = handle.getListState("chunks", _CHUNK)

    def _wait(self, ends: int, lines: int, latest: int, due: int, given: bool, watermark: int) -> None:
        """A reply waits once for its lines, and once more as a mark of having been given out."""
        if due:
            self.handle.deleteTimer(due)
        due = max(watermark + 1, latest + (2 if given else 1) * self.late_ms)
        self.handle.registerTimer(due)
        self.facts.update((ends, lines, latest, due, given))

    def _pieces(self, fresh=()) -> dict[int, str]:
        found: dict[int, str] = {}
        for seqs, pieces in (*self.chunks.get(), *fresh):
            for seq, piece in zip(seqs, pieces, strict=True):
                found.setdefault(seq, piece)
        return found

    def _over(self, key, pieces: dict[int, str], done: bool) -> pd.DataFrame:
        self.chunks.clear()
        return pd.DataFrame({"reply_id": [key[0]], "content": ["".join(p for _, p in sorted(pieces.items()))], "done": [done]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # ends: place of the end line, -1 while unknown; lines: how many have come, repeated ones included
        ends, lines, latest, due, given = self.facts.get() if self.facts.exists() else (-1, 0, 0, 0, False)
        fresh = []
        for batch in rows:
            latest = max(latest, int(batch["ms"].max()))
            if given:
                continue
            for steps, sizes, text, end in zip(batch["steps"], batch["sizes"], batch["text"], batch["ends"], strict=True):
                stops = np.cumsum(sizes).tolist()
                # lines with negative numbers are none
                said = [(seq, text[stop - size : stop]) for seq, size, stop in zip(np.cumsum(steps).tolist(), sizes, stops, strict=True) if seq >= 0]
                if said:
                    fresh.append(tuple(map(list, zip(*said, strict=True))))
                    lines += len(said)
                if not pd.isna(end):
                    ends = int(end) if ends < 0 else min(ends, int(end))
        over = False
        if not given and 0 <= ends < lines:
            pieces = self._pieces(fresh)
            if over := sum(seq <= ends for seq in pieces) == ends + 1:
                given = True
                yield self._over(key, pieces, True)
        if fresh and not over:
            self.chunks.appendValue(tuple([x for part in parts for x in part] for parts in zip(*fresh, strict=True)))
        self._wait(ends, lines, latest, due, given, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends, lines, latest, _, given = self.facts.get()
        if given:
            self.facts.clear()
            return
        yield self._over(key, self._pieces(), ends >= 0)
        self._wait(ends, lines, latest, 0, True, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def replies(lines: DataFrame, late_seconds: int = 600) -> DataFrame:
    """Each reply once, with its content and whether its end line came.

    Lines of a reply are numbered from 0 by seq and may come in any order and
    more than once, also after the reply was given out. Lines
    that are more than `late_seconds` behind the newest line of the stream are
    left out; a reply that pauses for longer is given out as it is.
    """
    # lines behind the watermark must not reach a reply whose mark is gone: the watermark cuts them off here
    marked = chunks(lines).withColumn("ms", F.unix_millis("at")).withWatermark("at", f"{late_seconds} seconds")
    return marked.groupBy("reply_id").transformWithStateInPandas(Replies(1000 * late_seconds), REPLIES, "append", "eventTime")


def replies_of_batch(lines: DataFrame) -> DataFrame:
    """The contents over a bounded table."""
    return joined(deltas(lines), "reply_id", "seq")


def run_available(lines: DataFrame, out: str, late_seconds: int = 600) -> None:
    """Takes in what has arrived and appends the replies that are over to the table at `out`, see states.append_available."""
    append_available(replies(lines, late_seconds), out)
