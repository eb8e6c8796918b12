"""Conversations that go on: events of a session arrive in a stream, each user turn becomes a prompt.

Events of one session are numbered from 0 by seq: what a user says (`user`), the reply
to it (`assistant`), a failed call (`failed`, which leaves the user turn in the
history and adds nothing), a new system prompt (`system`) and a cleared history
(`clear`). They may come in any order, over any number of batches, and more than once.

State of a session: its history, cut to the system message and the last
`history` others, which is all that a later prompt can show; the next number;
and the events that have come too early. What is early waits for at most
`late_seconds` of event time; then the gap is passed over. A session that is
silent for `idle_seconds` is forgotten but for its next number, and that too
once the watermark is as far again. So state is bounded by the history's length and
by what arrives within `late_seconds`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from turnloom.functions.text import strip
from turnloom.operators import conversations as C
from turnloom.streaming.states import append_available

EVENTS = "session string, seq long, kind string, content string, at timestamp"
PROMPTS = "session string, seq long, messages array<struct<role:string,content:string>>"
KINDS = ("user", "assistant", "failed", "system", "clear")

_HISTORY = T.StructType([T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("contents", T.ArrayType(T.StringType()))])
_PLACE = T.StructType([T.StructField("next", T.LongType()), T.StructField("latest", T.LongType()), T.StructField("due", T.LongType())])
_EARLY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("content", T.StringType()), T.StructField("ms", T.LongType())])
_SEQ = T.StructType([T.StructField("seq", T.LongType())])


def applied(messages: list[tuple[str, str]], kind: str, content: str | None, history: int) -> list[tuple[str, str]]:
    """The history after an event, as far as later prompts can show it."""
    content = content or ""
    if kind == "system":
        new = content.strip()
        return [("system", new), *messages[1:]] if new else messages
    if kind == "clear":
        return messages[:1]
    if kind not in ("user", "assistant"):
        return messages
    messages = [*messages, (kind, content)]
    return [*messages[:1], *messages[1:][-history:]] if history > 0 else messages[:1]


class Sessions(StatefulProcessor):
    def __init__(self, system: str, history: int, late_ms: int, idle_ms: int):
        self.system, self.history, self.late_ms, self.idle_ms = system, history, late_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getValueState("history", _HISTORY)
        self.place = handle.getValueState("place", _PLACE)
        self.early = handle.getMapState("early", _SEQ, _EARLY)

    def _load(self):
        next_, latest, due = self.place.get() if self.place.exists() else (0, 0, 0)
        messages = list(zip(*self.messages.get(), strict=True)) if self.messages.exists() else [("system", self.system)]
        return messages, next_, latest, due

    def _take(self, messages, next_: int, rows: list, skip: bool):
        """Goes on from `next_` through the events that are there; skip passes over the gap before the first early one."""
        waiting = {k[0]: v for k, v in self.early.iterator()}
        if skip and waiting and next_ not in waiting:
            next_ = min(waiting)
        while next_ in waiting:
            kind, content, _ = waiting.pop(next_)
            self.early.removeKey((next_,))
            messages = applied(messages, kind, content, self.history)
            if kind == "user":
                rows.append((next_, messages))
            next_ += 1
        return messages, next_, min((v[2] for v in waiting.values()), default=None)

    def _save(self, messages, next_: int, latest: int, due: int, oldest: int | None, watermark: int) -> None:
        self.messages.update(([r for r, _ in messages], [c for _, c in messages]))
        if due:
            self.handle.deleteTimer(due)
        due = max(watermark + 1, latest + self.idle_ms if oldest is None else min(oldest + self.late_ms, latest + self.idle_ms))
        self.handle.registerTimer(due)
        self.place.update((next_, latest, due))

    def _rows(self, key, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            said = [[{"role": r, "content": c} for r, c in messages] for _, messages in rows]
            yield pd.DataFrame({"session": [key[0]] * len(rows), "seq": [s for s, _ in rows], "messages": said})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        messages, next_, latest, due = self._load()
        for batch in rows:
            for seq, kind, content, ms in zip(batch["seq"], batch["kind"], batch["content"], batch["ms"], strict=True):
                latest = max(latest, int(ms))
                # what has been taken already, or waits already, has come again
                if seq >= next_ and not self.early.containsKey((int(seq),)):
                    self.early.updateValue((int(seq),), (kind, None if pd.isna(content) else content, int(ms)))
        found: list = []
        messages, next_, oldest = self._take(messages, next_, found, skip=False)
        self._save(messages, next_, latest, due, oldest, timerValues.getCurrentWatermarkInMs())
        yield from self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        messages, next_, latest, due = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        found: list = []
        messages, next_, oldest = self._take(messages, next_, found, skip=True)
        if oldest is None and watermark >= latest + 2 * self.idle_ms:
            self.messages.clear()
            self.place.clear()
        elif oldest is None and watermark >= latest + self.idle_ms:
            self.messages.clear()
            due = latest + 2 * self.idle_ms + 1
            self.handle.registerTimer(due)
            self.place.update((next_, latest, due))
        else:
            self._save(messages, next_, latest, 0, oldest, watermark)
        yield from self._rows(key, found)

    def close(self) -> None:
        pass


def read_events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Events from JSON files as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).json(path)


def prompts(events: DataFrame, system: str, history: int, late_seconds: int = 600, idle_seconds: int = 86_400) -> DataFrame:
    """One row for each user turn: the messages that are sent for it. Each turn once, in order of its session."""
    usable = events.where(F.col("session").isNotNull() & F.col("seq").isNotNull() & F.col("kind").isin(*KINDS))
    marked = usable.withColumn("ms", F.unix_millis("at")).withWatermark("at", f"{late_seconds} seconds")
    work = Sessions(system, history, 1000 * late_seconds, 1000 * idle_seconds)
    return marked.groupBy("session").transformWithStateInPandas(work, PROMPTS, "append", "eventTime")


def prompts_of_batch(events: DataFrame, system: str, history: int) -> DataFrame:
    """The prompts over a bounded table whose events are all there, by window functions."""
    once = events.where(F.col("kind").isin(*KINDS)).dropDuplicates(["session", "seq"])
    w = Window.partitionBy("session").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    text = F.coalesce("content", F.lit(""))
    new = F.when((F.col("kind") == "system") & (strip(text) != ""), strip(text))
    said = F.col("kind").isin("user", "assistant")
    facts = once.withColumns({"tl_system": F.coalesce(F.last(new, ignorenulls=True).over(upto), F.lit(system)), "tl_cleared": F.sum((F.col("kind") == "clear").cast("int")).over(upto)})
    told = Window.partitionBy("session", "tl_cleared").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    nth = facts.where(said).withColumn("tl_nth", F.count("*").over(told))
    # the last `history` messages since the history was cleared
    last = Window.partitionBy("session", "tl_cleared").orderBy("tl_nth").rowsBetween(-history + 1, 0)
    rows = nth.withColumn("tl_shown", F.collect_list(F.struct(F.col("kind").alias("role"), text.alias("content"))).over(last))
    first = F.array(C.message("system", F.col("tl_system")))
    return rows.where("kind = 'user'").select("session", "seq", F.concat(first, "tl_shown").alias("messages"))


def run_available(events: DataFrame, out: str, system: str, history: int, late_seconds: int = 600, idle_seconds: int = 86_400) -> None:
    """Takes in what has arrived and appends its prompts to the table at `out`, see states.append_available."""
    append_available(prompts(events, system, history, late_seconds, idle_seconds), out)
