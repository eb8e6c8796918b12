"""Removal of word windows that occur more than once in the corpus.

Method: every window of `window` consecutive words gets a Rabin-Karp hash; the
hashes are counted over the whole corpus; words under a repeated window form
maximal intervals, which are cut out.

Hashes have 64 bits or more: with n windows as many whole bytes as make the
expected number of pairs of different windows with one hash less than
FALSE_PAIRS (8 bytes for up to about 2e8 windows, 12 for 1e13). The bits beyond
64 come from other hashes of the words.

Scale: texts are packed once into compressed chunks of bounded size. A chunk
sends each distinct hash once (with a flag if it repeats inside the chunk), in
sorted, delta-coded blocks, one block for each range of hashes; so a passage in
a third of all documents costs one entry per chunk, and the shuffle about six
bytes per window. A range is counted in one task of bounded size, and only the
repeated hashes go back to the chunks that have them. The number of ranges
grows with the corpus, but a chunk sends at most FAN blocks: where there are
more ranges, blocks of one coarse range are gathered from many chunks, in tasks
of bounded memory, and split into FAN finer ranges, as often as it takes.

Defined cases: null text counts as no words and stays null; texts with fewer
words than the window lose nothing; repeated rows repeat all their windows;
very long texts are hashed in slices, whole; null and repeated ids are carried
through, as rows are never matched by id; an input column that has the name of
an added one is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import textops
from turnloom.llm.columns import text_of, with_fields, without
from turnloom.llm.workspace import Workspace

WINDOW = 35
#: Bytes of text in a chunk, and windows that one range of hashes should hold.
CHUNK_BYTES = 4 << 20
RANGE_WINDOWS = 1 << 20
#: Bits of a hash by which blocks are parted in one exchange, and windows that are gathered for a further one.
FAN_BITS = 10
GATHER_WINDOWS = 1 << 22
#: Expected number of pairs of different windows that are taken for equal.
FALSE_PAIRS = 1e-3

_BLOCK = "part long, chunks binary, owners binary, hashes binary, twice binary"
_SECOND = np.uint64(0x5851F42D4C957F2D)


def hash_bytes(windows: int) -> int:
    """Bytes of a hash, 8 at least and 16 at most, for a corpus with so many windows."""
    bits = 2 * math.log2(max(windows, 2)) - 1 - math.log2(FALSE_PAIRS)
    return min(16, max(8, math.ceil(bits / 8)))


def encode(values: np.ndarray, more: np.ndarray | None = None, extra: int = 0) -> bytes:
    """Sorted uint64 values as byte planes of their differences, compressed; then `extra` bytes of each of `more`."""
    n = len(values)
    if not n:
        return b""
    tail = np.ascontiguousarray(more.view(np.uint8).reshape(-1, 8)[:, :extra]).tobytes() if extra else b""
    if n < 16:  # too few to be worth a frame
        return n.to_bytes(4, "little") + b"\0" + values.tobytes() + tail
    gaps = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    used = max(1, max((i + 1 for i in range(8) if planes[i].any()), default=1))
    body = pa.Codec("zstd", compression_level=1).compress(planes[:used].tobytes(), asbytes=True)
    return n.to_bytes(4, "little") + bytes([used]) + len(body).to_bytes(4, "little") + body + tail


def decode(blob: bytes, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The values, and what `more` was, zeros without extra bytes."""
    n = int.from_bytes(blob[:4], "little") if blob else 0
    more = np.zeros(n, np.uint64)
    if not n:
        return np.zeros(0, np.uint64), more
    used = blob[4]
    if not used:
        values, end = np.frombuffer(blob, np.uint64, n, 5), 5 + 8 * n
    else:
        end = 9 + int.from_bytes(blob[5:9], "little")
        planes = np.zeros((8, n), np.uint8)
        planes[:used] = np.frombuffer(pa.Codec("zstd").decompress(blob[9:end], decompressed_size=n * used, asbytes=True), np.uint8).reshape(used, n)
        values = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
    if extra:
        more.view(np.uint8).reshape(-1, 8)[:, :extra] = np.frombuffer(blob, np.uint8, n * extra, end).reshape(n, extra)
    return values, more


def _pack(window: int, text: str):
    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for batch in textops.slices(batches, text, CHUNK_BYTES):
            raw, at = textops.buffers(batch.column(text))
            _, counts, _, _ = textops.words(raw, at)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([(task << 32) | seq], pa.int64()),
                "n_windows": pa.array([int(np.maximum(counts - window + 1, 0).sum())], pa.int64()),
                "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            })
            seq += 1

    return run


def _unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_next_batch()


def _hashes(batch: pa.RecordBatch, window: int, text: str, extra: int = 0):
    raw, at = textops.buffers(batch.column(text))
    h, counts, starts, ends = textops.words(raw, at)
    where, _ = textops.window_starts(counts, window)
    none = np.zeros(len(where), np.uint64)
    values = textops.windows(h, window)[where] if len(where) else none
    more = none
    if extra and len(where):
        own = textops.span_hashes(raw, starts, ends, second=True)
        more = textops.windows(textops.mix(own ^ _SECOND), window)[where] & np.uint64(2 ** (8 * extra) - 1)
    return raw, at, counts, starts, ends, where, values, more


def _blocks(values: np.ndarray, more: np.ndarray, twice: np.ndarray, owners: np.ndarray, chunks: np.ndarray, bits: int, extra: int) -> pa.RecordBatch:
    """One row for each range of the sorted values: chunks that they are from, and whose each is."""
    parts = (values >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1], [True])))
    names, whose, hashes, flags = [], [], [], []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own, index = np.unique(owners[a:b], return_inverse=True) if len(chunks) > 1 else (np.zeros(1, np.int64), None)
        names.append(chunks[own].tobytes())
        whose.append(b"" if len(own) == 1 else pa.compress(index.astype(np.uint32).tobytes(), "zstd", asbytes=True))
        hashes.append(encode(values[a:b], more[a:b], extra))
        flags.append(np.packbits(twice[a:b]).tobytes() if twice[a:b].any() else b"")
    return pa.RecordBatch.from_pydict({"part": pa.array(parts[cut[:-1]], pa.int64()), "chunks": pa.array(names, pa.binary()), "owners": pa.array(whose, pa.binary()), "hashes": pa.array(hashes, pa.binary()), "twice": pa.array(flags, pa.binary())})


def _read(rows, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All values of some blocks in order, what more there is of each, whether it repeats in its chunk, its chunk."""
    values, more, twice, owner = [], [], [], []
    for row in rows:
        v, m = decode(row["hashes"], extra)
        chunks = np.frombuffer(row["chunks"], np.int64)
        index = np.zeros(len(v), np.uint32) if not row["owners"] else np.frombuffer(pa.decompress(row["owners"], decompressed_size=4 * len(v), codec="zstd", asbytes=True), np.uint32)
        values.append(v)
        more.append(m)
        owner.append(chunks[index])
        twice.append(np.unpackbits(np.frombuffer(row["twice"], np.uint8), count=len(v)).astype(bool) if row["twice"] else np.zeros(len(v), bool))
    values, more, twice, owner = (np.concatenate(x) for x in (values, more, twice, owner))
    order = np.lexsort((more, values)) if extra else np.argsort(values, kind="stable")
    return values[order], more[order], twice[order], owner[order]


def _post(window: int, text: str, bits: int, extra: int):
    def run(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                *_, values, more = _hashes(_unpack(payload.as_buffer()), window, text, extra)
                if not len(values):
                    continue
                if extra:
                    order = np.lexsort((more, values))
                    values, more = values[order], more[order]
                else:
                    values.sort()
                first = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (more[1:] != more[:-1]))))
                twice = np.diff(first, append=len(values)) > 1
                values, more = values[first], more[first]
                yield _blocks(values, more, twice, np.zeros(0), np.array([chunk], np.int64), bits, extra)

    return run


def _gather(bits: int, extra: int):
    """Blocks of one range, which come one after the other, as blocks of its finer ranges."""

    def merged(rows):
        values, more, twice, owner = _read(rows, extra)
        chunks, index = np.unique(owner, return_inverse=True)
        return _blocks(values, more, twice, index, chunks, bits, extra)

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                size = int.from_bytes(row["hashes"][:4], "little")
                if waiting and (row["part"] != waiting[0]["part"] or n + size > GATHER_WINDOWS):
                    yield merged(waiting)
                    waiting, n = [], 0
                waiting.append(row)
                n += size
        if waiting:
            yield merged(waiting)

    return run


def _count(extra: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one range of hashes: for each chunk, those that occur more than once in the corpus."""
        values, more, twice, owner = _read(table.to_pylist(), extra)
        same = (values[1:] == values[:-1]) & (more[1:] == more[:-1])
        twice[1:] |= same
        twice[:-1] |= same
        # a hash flagged inside one chunk need not be elsewhere; one seen in two chunks is flagged in each
        values, more, owner = values[twice], more[twice], owner[twice]
        order = np.argsort(owner, kind="stable")
        values, more, owner = values[order], more[order], owner[order]
        cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else np.zeros(1, np.int64)
        found = [(int(owner[a]), encode(values[a:b], more[a:b], extra)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"chunk": pa.array([c for c, _ in found], pa.int64()), "hashes": pa.array([b for _, b in found], pa.binary())})

    return run


def _among(values: np.ndarray, more: np.ndarray, blobs, extra: int) -> np.ndarray:
    """Which hashes some blocks hold."""
    hit = np.zeros(len(values), bool)
    found = [decode(b.as_py(), extra) for b in blobs]
    if not found:
        return hit
    known, rest = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((rest, known))
    known, rest = known[order], rest[order]
    first, last = np.searchsorted(known, values, "left"), np.searchsorted(known, values, "right")
    for step in range(int((last - first).max(initial=0))):  # one step, unless hashes agree in their first 64 bits only
        at = np.minimum(first + step, len(known) - 1)
        hit |= (first + step < last) & (rest[at] == more)
    return hit


def _cut(raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without runs of removed words; each run goes with the white space after it."""
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    kept, at = [], 0
    for a, b in edge.reshape(-1, 2):
        kept.append(raw[at : starts[a]])
        at = starts[b] if b < len(starts) else ends[b - 1]
    return b"".join([*kept, raw[at:]])


def _remove(window: int, text: str, digest: bool, names: list[str], extra: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        outs = []
        for payload in left.column("payload"):
            batch = _unpack(payload.as_buffer())
            raw, at, counts, starts, ends, where, values, more = _hashes(batch, window, text, extra)
            hit = _among(values, more, right.column("hashes"), extra)
            gone = textops.covered(where[hit], window, len(starts))
            edges = np.concatenate(([0], np.cumsum(counts)))
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[edges])
            whole, valid = raw.tobytes(), batch.column(text).is_valid().to_pylist()
            texts, digests = [], []
            for i in range(batch.num_rows):
                own = whole[at[i] : at[i + 1]]
                a, b = edges[i], edges[i + 1]
                if removed[i]:
                    texts.append(_cut(own, starts[a:b] - at[i], ends[a:b] - at[i], gone[a:b]).decode())
                else:
                    texts.append(own.decode() if valid[i] else None)
                if digest:
                    kept = own.split()
                    if removed[i]:
                        kept = compress(kept, (~gone[a:b]).tolist())
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {text: pa.array(texts, pa.string()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            if digest:
                columns["kept_sha256"] = pa.array(digests, pa.string())
            outs.append(pa.table({n: columns[n] for n in names}))
        return pa.concat_tables(outs)

    return run


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, text: str = "text", digest: bool = False, workspace: Workspace | None = None) -> DataFrame:
    """The rows with repeated windows cut out of `text`, and n_words, n_removed (long).

    With `digest`, also kept_sha256: of the kept words, joined by one space.
    """
    text_of(docs, text)
    added = ["n_words", "n_removed", *(["kept_sha256"] if digest else [])]
    docs = without(docs, *added)
    ws = workspace or Workspace(docs.sparkSession)
    packed = ws.keep(docs.mapInArrow(_pack(window, text), "chunk long, n_windows long, payload binary"), "chunks", "none")
    total = packed.agg(F.sum("n_windows")).first()[0] or 0
    extra = hash_bytes(total) - 8
    bits = max(6, math.ceil(math.log2(max(total, 1) / RANGE_WINDOWS)))
    steps = [min(k, bits) for k in range(FAN_BITS, bits + FAN_BITS, FAN_BITS)]
    posts = packed.select("chunk", "payload").mapInArrow(_post(window, text, steps[0], extra), _BLOCK)
    for coarse, fine in zip(steps[:-1], steps[1:], strict=True):
        # several tasks share a range, each with enough of it to fill finer blocks
        share = F.pmod(F.xxhash64("chunks"), F.lit(max(1, (total >> coarse) // (4 * GATHER_WINDOWS))))
        posts = posts.repartition("part", share).sortWithinPartitions("part").mapInArrow(_gather(fine, extra), _BLOCK)
    # written, so that the shuffle of all hashes need not stay while texts are cut
    repeated = ws.keep(posts.groupBy("part").applyInArrow(_count(extra), "chunk long, hashes binary"), "repeated", "none")
    kinds = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    schema = with_fields(docs.schema, *((n, kinds[n]) for n in added))
    return packed.select("chunk", "payload").groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_remove(window, text, digest, schema.names, extra), schema)
