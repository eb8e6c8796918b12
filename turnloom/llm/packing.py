"""Packing of tokenized documents into fixed-length sequences by best-fit decreasing.

Method: a document longer than a sequence is first cut into full windows and a
rest. Pieces are placed longest first, each into the open sequence with the
least remaining room that still holds it; a segment tree over remaining room
finds that sequence. Lengths are whole numbers up to the sequence length, so
the placement is worked out on the number of pieces of each length: sequences
with equal room move together as runs. This gives exactly the sequences that
best-fit decreasing gives piece by piece, in a time that does not depend on
the number of pieces.

Scale: texts are tokenized in one pass, without shuffle, and only a few numbers
per piece are kept. The driver sees one count per length (at most `capacity`);
the placement it broadcasts has a bounded number of rows for any corpus (see
place()). A piece's rank among those of its length comes from counts per task, so
no length is gathered or sorted anywhere.

Defined cases: null and empty texts are one piece, the end token; repeated rows
and null ids are packed like any others; the order of pieces of one length
follows the input partitions.
"""

from __future__ import annotations

import json
import math
import os
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnloom.llm import textops
from turnloom.llm.columns import ROW, boxed, text_of, unboxed, with_fields, without
from turnloom.llm.workspace import Workspace

CAPACITY = 4096
END = 2
#: Parts of words whose ids a worker remembers.
KNOWN = 1_500_000
_SEGMENT = 1 << 20
#: What may stand behind a head; the apostrophe can begin a token with letters.
_TAIL = np.zeros(256, bool)
_TAIL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True
#: Bytes of heads: ASCII letters, and those of U+00C0 to U+00FF, of which two are no letters.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = True
_NO_LETTER_AFTER_C3 = np.zeros(256, bool)
_NO_LETTER_AFTER_C3[[0x97, 0xB7]] = True


class WordEncoder:
    """Ids of texts from the ids of parts of words, each of which is encoded once and remembered.

    This holds for tokenizers that lower-case, never let a token reach over
    ASCII white space, and part letters from the punctuation after them; then a
    text's ids are those of its words in order, and a word's those of its
    lower-case head of letters and of its tail of punctuation. Other words are
    encoded as they are. Parts are told apart by 64-bit hashes, kept in order of
    these; beyond KNOWN parts the longer unused half is forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as this machine's unsigned ints, which must be little-endian and 32 bits")
        self.tokenizer = Tokenizer.from_file(path)
        self.keys, self.begin, self.size, self.used = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
        self.pool, self.turn = np.zeros(0, np.uint32), 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys, and which are known."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return at, known

    def _forget(self) -> None:
        keep = self.used > np.median(self.used)
        size = self.size[keep]
        until = np.cumsum(size)
        self.pool = self.pool[np.arange(int(until[-1]) if len(until) else 0) + np.repeat(self.begin[keep] - until + size, size)]
        self.keys, self.size, self.used, self.begin = self.keys[keep], size, self.used[keep], until - size

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        """Remembers parts that are not known yet; keys: their hashes, in order."""
        if len(self.keys) + len(keys) > KNOWN and len(self.keys):
            self._forget()
        ids, sizes = array("I"), []
        for first in range(0, len(parts), 10_000):
            for found in self.tokenizer.encode_batch_fast([w.decode() for w in parts[first : first + 10_000]], add_special_tokens=False):
                own = found.ids
                ids.extend(own)
                sizes.append(len(own))
        size = np.array(sizes, np.int64)
        at = np.searchsorted(self.keys, keys)
        self.begin = np.insert(self.begin, at, np.cumsum(size) - size + len(self.pool))
        self.size, self.keys, self.used = np.insert(self.size, at, size), np.insert(self.keys, at, keys), np.insert(self.used, at, self.turn)
        self.pool = np.concatenate((self.pool, np.frombuffer(ids, np.uint32)))

    def _segment(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at raw[s:e], and ids per word."""
        low, n = textops.LOWER[raw], len(raw)
        solid = np.maximum.accumulate(np.where(_TAIL[raw], 0, np.arange(1, n + 1)))
        head = np.maximum(solid[e - 1], s)
        head[head == s] = e[head == s]
        odd = ~_LETTER[raw]
        odd[1:] |= _NO_LETTER_AFTER_C3[raw[1:]] & (raw[:-1] == 0xC3)
        odds = np.concatenate(([0], np.cumsum(odd)))
        whole = odds[head] != odds[s]
        head[whole] = e[whole]
        hashes = textops.span_hashes(low, np.concatenate((s, head)), np.concatenate((head, e)))
        if whole.any():
            hashes[: len(s)][whole] = ~textops.span_hashes(raw, s[whole], e[whole])
        both = np.stack((hashes[: len(s)], hashes[len(s) :]), axis=1).ravel()
        there = np.stack((np.ones(len(s), bool), head < e), axis=1).ravel()
        distinct, which = np.unique(both[there], return_inverse=True)
        place = np.empty(len(distinct), np.int64)
        place[which] = np.flatnonzero(there)
        self.turn += 1
        _, known = self._find(distinct)
        if not known.all():
            part = place[~known]
            word, tail = part // 2, part % 2 == 1
            first, last = np.where(tail, head[word], s[word]).tolist(), np.where(tail, e[word], head[word]).tolist()
            raw_bytes, low_bytes = raw.tobytes(), low.tobytes()
            self._learn(distinct[~known], [(raw_bytes if w else low_bytes)[a:b] for a, b, w in zip(first, last, whole[word].tolist(), strict=True)])
        at, known = self._find(distinct)
        if not known.all():  # forgotten on the way
            self.used[at[known]] = self.turn
            return self._segment(raw, s, e)
        self.used[at] = self.turn
        size, begin = self.size[at][which], self.begin[at][which]
        until = np.cumsum(size)
        ids = self.pool[np.arange(int(until[-1])) + np.repeat(begin - until + size, size)]
        per = np.zeros(len(both), np.int64)
        per[there] = size
        return ids, per.reshape(-1, 2).sum(1)

    def ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and ids per text."""
        _, counts, starts, ends = textops.words(raw, at)
        ids, per, first = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while first < len(starts):  # segments of whole words, so that a long text needs no more than others
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + _SEGMENT)))
            a, b = int(starts[first]), int(ends[last - 1])
            found, size = self._segment(raw[a:b], starts[first:last] - a, ends[first:last] - a)
            ids.append(found)
            per.append(size)
            first = last
        return np.concatenate(ids), textops.per_text(np.concatenate(per), np.concatenate(([0], np.cumsum(counts))))


class TextEncoder:
    """Ids of whole texts, for any tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = raw.tobytes()
        texts = [whole[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)


#: The rules of a tokenizer file for which WordEncoder holds (fixed values).
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def by_word(path: str) -> bool:
    """Whether a tokenizer file has these rules, and no added token that could reach over white space."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    added = [t["content"] for t in rules["added_tokens"]]
    return all(rules[k] == v for k, v in _BY_WORD.items()) and not any(c.isspace() for t in added for c in t)


_encoders: dict[str, WordEncoder | TextEncoder] = {}


def encoder(path: str) -> WordEncoder | TextEncoder:
    if path not in _encoders:
        _encoders[path] = (WordEncoder if by_word(path) else TextEncoder)(path)
    return _encoders[path]


def _pieces(path: str, text: str, capacity: int, names: list[str], with_ids: bool):
    def run(batches):
        task, seen, coder = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)
        for batch in textops.slices(batches, text, 1 << 20):
            flat, per = coder.ids(*textops.buffers(batch.column(text)))
            flat = np.insert(flat, np.cumsum(per), END)
            until = np.cumsum(per + 1)
            row, start, length, crc, total, nth, ids = [], [], [], [], [], [], []
            for i, (n, stop) in enumerate(zip((per + 1).tolist(), until.tolist(), strict=True)):
                for first in range(0, n, capacity):
                    size = min(capacity, n - first)
                    piece = flat[stop - n + first : stop - n + first + size]
                    row.append(i)
                    start.append(first)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    nth.append(int(seen[size]))
                    seen[size] += 1
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            columns = {c: batch.column(c).take(pa.array(row, pa.int64())) for c in batch.schema.names if c in names}
            columns |= {"start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "task": pa.array([task] * len(row), pa.int32()), "nth": pa.array(nth, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in names})

    return run


class RoomTree:
    """Segment tree over remaining room: which amounts some open sequence has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def set(self, room: int, open_: bool) -> None:
        at = room + self.size
        self.any[at] = open_
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open room that is not below `least`."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def place(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing on counts per length.

    Rows (length, rank, n, sequence, offset, each): of the n * each pieces of this
    length from rank on, the first n go to the n sequences from `sequence` on, at
    `offset`, the next n to the same at offset + length, and so on.

    At most two runs of sequences are opened for a length and one is split, so
    there are at most 3 * capacity runs; a sequence holds fewer than
    sqrt(2 * capacity) different lengths, and a run gets one row for each: for
    capacity 4096 at most 1.1 million rows, whatever the number of pieces.
    """
    tree, runs, used, rows = RoomTree(capacity), {}, 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, []).append((first, n))
            tree.set(room, True)

    def fill(length: int, rank: int, first: int, n: int, room: int, each: int) -> int:
        rows.append((length, rank, n, first, capacity - room, each))
        put(room - each * length, first, n)
        return rank + n * each

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            room, left = tree.tightest(length), end - rank
            if room is None:
                room, each = capacity, capacity // length
                first, n = used, -(-left // each)
                used += n
            else:
                each = room // length
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            full = min(n, left // each)
            if full:
                rank = fill(length, rank, first, full, room, each)
            first, n, left = first + full, n - full, end - rank
            if left and n:
                rank = fill(length, rank, first, 1, room, left)
                first, n = first + 1, n - 1
            put(room, first, n)
    return np.array(rows, np.int64).reshape(-1, 6)


def spread_order(n: int) -> tuple[int, int]:
    """(factor, n) of a renumbering i * factor % n of n sequences that leaves no stretch of neighbours together."""
    factor = max(1, min(int(n * 0.6180339887), (1 << 28) - 1))
    while math.gcd(factor, max(n, 1)) != 1:
        factor += 1
    return factor, max(n, 1)


def _assign(plan, names: list[str], order: tuple[int, int] | None = None):
    def run(batches):
        length, rank, n, sequence, offset, _ = plan.value.T
        starts = (length << 44) | rank
        for batch in batches:
            if not batch.num_rows:
                continue
            own, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            at = np.searchsorted(starts, (own << 44) | nth, "right") - 1
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            layer, place_ = np.divmod(nth - rank[at], n[at])
            number = sequence[at] + place_
            if order:
                number = number * order[0] % order[1]
            columns |= {"sequence_id": pa.array(number, pa.int64()), "offset": pa.array(offset[at] + layer * own, pa.int64())}
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in names})

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", with_ids: bool = False, spread: bool = False, workspace: Workspace | None = None) -> DataFrame:
    """One row per piece: the row's other columns, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences are numbered as they are opened, long pieces first; with `spread`, pieces of
    all lengths lie evenly over the numbers. With `with_ids`, also the piece's ids. tokenizer: path of a tokenizer file.
    """
    text_of(docs, text)
    spark = docs.sparkSession
    ws = workspace or Workspace(spark)
    numbers = ("start", "length", "ids_crc32", "doc_tokens")
    rows = without(docs, *numbers, "sequence_id", "offset", "ids")
    carried = [c for c in rows.columns if c != text]
    boxes = boxed(rows, carried, tl_text=F.col(text))
    extra = [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = with_fields(T.StructType([boxes.schema[ROW]]), *((n, T.LongType()) for n in numbers), *extra, ("task", T.IntegerType()), ("nth", T.LongType()))
    pieces = ws.keep(boxes.mapInArrow(_pieces(tokenizer, "tl_text", capacity, schema.names, with_ids), schema), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("task")
    before = ws.keep(by_task.withColumn("before", F.sum("n").over(order) - F.col("n")), "ranks")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one per length
    rows_ = place(counts, capacity)
    plan = spark.sparkContext.broadcast(rows_[np.lexsort((rows_[:, 1], rows_[:, 0]))])
    # merged, not broadcast: the ranks grow with the number of tasks
    ranked = pieces.join(before.select("task", "length", "before").hint("merge"), ["task", "length"])
    out = with_fields(T.StructType([boxes.schema[ROW]]), *((n, T.LongType()) for n in numbers), *extra, ("sequence_id", T.LongType()), ("offset", T.LongType()))
    used = int((rows_[:, 3] + rows_[:, 2]).max()) if len(rows_) else 0
    return ranked.mapInArrow(_assign(plan, out.names, spread_order(used) if spread else None), out).select(*unboxed(carried), *out.names[1:])
