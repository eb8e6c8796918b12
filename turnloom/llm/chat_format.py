r"""Chat formatting: conversations as marked text, assembled by byte in numpy.

Format: a turn is `### <role>:\n<text></turn>\n`. Inside texts and roles every
`\`, `#` and `<` gets a backslash before it (in roles `:` and line feed too), so
no control string can appear there and the text can be read back exactly.

Method: for a batch of whole conversations all segment lengths are computed,
their cumulative sums give each segment's place in one output buffer of the
final size, and constants, roles and texts are scattered there by index arrays.
The buffer becomes the Arrow column without another copy.

Scale: turns are shuffled by conversation and sorted inside partitions; a task
streams over them and formats whole conversations of about SLICE bytes at a
time. Index arrays cover SLICE bytes at most, also inside one long text, so a
conversation that is longer than a slice costs a few times its size, as it is
one value of the result. Spark's limit for a value is 2 GiB; a conversation
beyond it raises an error.

Defined cases: null text and null role are empty; turns with equal numbers are
ordered by role, then text, nulls first; a null turn number comes first; rows
without a conversation id form one conversation; repeated rows are repeated
turns; an empty table gives an empty result. Only the columns named in the
arguments are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import textops
from turnloom.llm.workspace import ship

LOSS_ROLE = b"assistant"
#: Bytes that are formatted, or have index arrays, at a time.
SLICE = 1 << 20
#: Bytes that one value of Spark can hold.
MOST = 2**31 - 16
_OPEN, _MIDDLE, _CLOSE = (np.frombuffer(x, np.uint8) for x in (b"### ", b":\n", b"</turn>\n"))
_IN_TEXT = np.zeros(256, bool)
_IN_TEXT[list(b"\\#<")] = True
_IN_ROLE = _IN_TEXT.copy()
_IN_ROLE[list(b":\n")] = True
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*):\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.DOTALL)
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(raw: np.ndarray, at: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values with a backslash before each special byte, and their new offsets."""
    extra = textops.counts_before(raw, special, np.append(at, len(raw)))
    out, begin = np.empty(len(raw) + int(extra[-1]), np.uint8), 0
    for a in range(0, len(raw), SLICE):
        part = raw[a : a + SLICE]
        hit = special[part]
        place = np.arange(begin, begin + len(part)) + np.cumsum(hit)
        begin = int(place[-1]) + 1
        out[place] = part
        out[place[hit] - 1] = 0x5C
    return out, at + extra[:-1]


def _scatter(out: np.ndarray, raw: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
    """Copies value i of raw to out from to[i] on, with indices for SLICE bytes at a time."""
    for a in range(0, len(raw), SLICE):
        b = min(a + SLICE, len(raw))
        first, last = int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b, "left"))
        sizes = np.diff(np.clip(at[first : last + 1], a, b))
        out[np.arange(a, b) + np.repeat(to[first:last] - at[first:last], sizes)] = raw[a:b]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' formatted bytes, offsets of turns, and start and end of each text in them."""
    role_raw, role_at = textops.buffers(roles)
    text_raw, text_at = textops.buffers(texts)
    role_raw, role_at = escape(role_raw, role_at, _IN_ROLE)
    text_raw, text_at = escape(text_raw, text_at, _IN_TEXT)
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    size = len(_OPEN) + role_size + len(_MIDDLE) + text_size + len(_CLOSE)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(at[-1]), np.uint8)
    role_to = at[:-1] + len(_OPEN)
    text_to = role_to + role_size + len(_MIDDLE)
    out[at[:-1, None] + np.arange(len(_OPEN))] = _OPEN
    out[(text_to - len(_MIDDLE))[:, None] + np.arange(len(_MIDDLE))] = _MIDDLE
    out[(at[1:] - len(_CLOSE))[:, None] + np.arange(len(_CLOSE))] = _CLOSE
    _scatter(out, role_raw, role_at, role_to)
    _scatter(out, text_raw, text_at, text_to)
    return out, at, text_to, text_to + text_size


def _format(table: pa.Table) -> pa.RecordBatch:
    """One row per conversation of a table of whole conversations in order."""
    table = table.combine_chunks()
    ids = table.column("conv").chunk(0)
    out, at, begin, end = assemble(table.column("role"), table.column("text"))
    n = len(ids)
    key = ids.cast(pa.string()).fill_null("\x00").to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    turns = np.diff(first, append=n)
    offsets = np.append(at[first], at[-1])
    role_raw, role_at = textops.buffers(table.column("role"))
    whole = role_raw.tobytes()
    loss = np.array([whole[a:b] == LOSS_ROLE for a, b in zip(role_at[:-1].tolist(), role_at[1:].tolist(), strict=True)])
    chosen = np.flatnonzero(loss)
    starts, ends, base = begin[chosen], end[chosen], np.repeat(at[first], turns)[chosen]
    places = np.unique(np.concatenate((starts, ends, base)))
    points = textops.counts_before(out, _FIRST_BYTE, places)
    points_at = lambda x: points[np.searchsorted(places, x)]
    per = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(first)), turns)[chosen], minlength=len(first)))))
    spans = pa.StructArray.from_arrays([
        pa.array(points_at(starts) - points_at(base), pa.int64()),
        pa.array(points_at(ends) - points_at(starts), pa.int64()),
    ], names=["start", "length"])
    if int(np.diff(offsets).max(initial=0)) > MOST:
        raise ValueError(f"a conversation has more than {MOST} bytes, which is the most that a value can hold")
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    return pa.RecordBatch.from_pydict({
        "conv": ids.take(pa.array(first, pa.int64())),
        "n_turns": pa.array(turns, pa.int64()),
        "formatted": formatted,
        "loss_spans": pa.ListArray.from_arrays(pa.array(per, pa.int32()), spans),
    })


def _conversations(batches):
    """Formats whole conversations, as many as make up about SLICE bytes."""
    waiting: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv").cast(pa.string()).fill_null("\x00").to_numpy(zero_copy_only=False)
        until = sum(textops.buffers(batch.column(c))[1] for c in ("role", "text"))
        first = np.flatnonzero(np.concatenate(([ids[0] != last], ids[1:] != ids[:-1])))
        begin = 0
        for a in first.tolist():  # a conversation begins at row a
            if (waiting or a > begin) and size + until[a] - until[begin] >= SLICE:
                yield _format(pa.Table.from_batches([*waiting, batch.slice(begin, a - begin)]))
                waiting, size, begin = [], 0, a
        waiting.append(batch.slice(begin))
        size, last = size + int(until[-1] - until[begin]), ids[-1]
    if waiting:
        yield _format(pa.Table.from_batches(waiting))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, n_turns, formatted, loss_spans.

    loss_spans: start and length, in code points of formatted, of each text of
    role `assistant` as it stands there, escapes included.
    """
    ship(turns.sparkSession)
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    schema = T.StructType([rows.schema["conv"], T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", span)])
    return rows.select("conv", "role", "text").mapInArrow(_conversations, schema).withColumnRenamed("conv", conv_id)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; an error if it is not one."""
    found, at = [], 0
    while at < len(formatted):
        match = _TURN.match(formatted, at)
        if match is None:
            raise ValueError(f"no turn at {at}")
        found.append((_ESCAPED.sub(r"\1", match[1]), _ESCAPED.sub(r"\1", match[2])))
        at = match.end()
    return found


def masked(formatted: str, spans: list[dict]) -> str:
    """All text under the loss mask, without escapes."""
    return "".join(_ESCAPED.sub(r"\1", formatted[s["start"] : s["start"] + s["length"]]) for s in spans)


def _read_back(batches):
    for batch in batches:
        columns = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for value, spans in zip(batch.column("formatted"), batch.column("loss_spans"), strict=True):  # one text at a time
            formatted = value.as_py()
            turns = parse(formatted)
            columns["n_turns"].append(len(turns))
            columns["turns_sha256"].append(_sha256(x for r, t in turns for x in (r, "\n", t, "\n")))
            del turns
            loss = masked(formatted, spans.as_py())
            columns["loss_chars"].append(len(loss))
            columns["loss_sha256"].append(_sha256([loss]))
            columns["formatted_chars"].append(len(formatted))
        yield pa.RecordBatch.from_pydict({"conv": batch.column("conv")} | {k: pa.array(v, pa.string() if k.endswith("sha256") else pa.int64()) for k, v in columns.items()})


def _sha256(parts) -> str:
    found = hashlib.sha256()
    for part in parts:
        found.update(part.encode())
    return found.hexdigest()


def digests(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Read back from the output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = formatted.select(F.col(conv_id).alias("conv"), "formatted", "loss_spans")
    long, text = T.LongType(), T.StringType()
    schema = T.StructType([rows.schema["conv"], *(T.StructField(n, t) for n, t in (("n_turns", long), ("turns_sha256", text), ("loss_chars", long), ("loss_sha256", text), ("formatted_chars", long)))])
    return rows.mapInArrow(_read_back, schema).withColumnRenamed("conv", conv_id)
