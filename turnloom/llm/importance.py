"""Importance resampling towards a target corpus: hashed word-run weights, noisy scores, an exact ranked draw.

Method: all runs of up to MAX_WORDS consecutive words are counted by bucket of
their hash, over the documents and over the target. A bucket's gain says how
much likelier the target uses it; a document's weight, read from one array of
gains, is their sum, and its score the weight with a fixed pseudo-random noise, so that the
highest scores are a draw without replacement by weight.

Drawing: scores are cut into ranges that hold about RANGE_ROWS rows each. Each
partition sorts its eligible rows into a run and cuts it at the range borders into
blocks. A range's blocks meet in one task in order of their first rows; a
tournament tree over one open block of each run gives the smallest row until the
next block must join, so a task holds at most one block of each run and
the rest waits in Spark's sorted, spilled shuffle. A range knows its first rank from
the counts before it; ranges wholly below the draw are never merged, and the
range at its border stops at the exact number.

Scale: two passes over the texts; the counts have one row per bucket, a fixed
number; ranges and their counts are at most RANGES, cut by a
sample of about SAMPLE rows for each (whole keys, so that a score that many rows
share is cut by ids). Texts are not shuffled, only
ids and scores are. Written tables cut the lineage before the draw.

Defined cases: null and empty texts have no features and weight 0; a null id has
the noise of the empty id and comes after all others of its score; rows that
agree in score and id keep the order of the written table, so repeated rows are
drawn as often as they occur; an empty table or target is counted as it is
(gains then come from the added one of each bucket); very long texts are taken whole;
columns named like those added are replaced, all others are kept.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import textops
from turnloom.llm.columns import text_of, with_fields, without
from turnloom.llm.workspace import Workspace, ship

BUCKETS = 10_000
MAX_WORDS = 1
SEED = 2024
#: The share of eligible documents that is drawn, in hundredths, and the words that make a document eligible.
PERCENT, LEAST_WORDS = 10, 20
#: Rows that a range should hold, and the most ranges.
RANGE_ROWS, RANGES = 50_000, 4096
#: Rows for each range that are looked at to cut the ranges.
SAMPLE = 20
#: Rows of a run that are open at once in a merge.
BLOCK_ROWS = 512
_BATCH = 1 << 20
#: Words are runs of ASCII letters and digits and of all characters from 0x80 on, A-Z lower-cased.
_WORDS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


class _Buckets(dict):
    """Bucket of each feature seen lately; starts anew when it has grown, so that it stays small."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.n
        return bucket


def _texts(batches: Iterator[pa.RecordBatch], text: str, known: _Buckets, most: int):
    """(batch, words per text, features per text, buckets of all features) of slices of the batches."""
    for batch in textops.slices(batches, text, _BATCH):
        raw, at = textops.buffers(batch.column(text))
        whole = raw.tobytes().translate(_WORDS)
        words, features, buckets = [], [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            found = whole[a:b].split()
            own = [np.fromiter(map(known.__getitem__, found), np.int64, len(found))]
            for k in range(2, most + 1):
                grams = [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)]
                own.append(np.fromiter(map(known.__getitem__, grams), np.int64, len(grams)))
            words.append(len(found))
            features.append(sum(map(len, own)))
            buckets += own
        yield batch, np.array(words, np.int64), np.array(features, np.int64), np.concatenate(buckets) if buckets else np.zeros(0, np.int64)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = MAX_WORDS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    text_of(texts, text)
    ship(texts.sparkSession)

    def run(batches):
        total, known = np.zeros(buckets, np.int64), _Buckets(buckets)
        for _, _, _, found in _texts(batches, text, known, most):
            total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for row in texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of B buckets."""
    all_s, all_t, n = int(source.sum()), int(target.sum()), len(source)
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(((t + 1) * (all_s + n)) / ((s + 1) * (all_t + n)))) for s, t in pairs], np.int64)


def noise_of(key: str, seed: int) -> int:
    """floor of 1000 times a standard Gumbel value, fixed by the key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(docs: DataFrame, gains: np.ndarray, doc_id: str, text: str, keep_text: bool, most: int, seed: int, least: int) -> DataFrame:
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = with_fields(T.StructType(kept), ("n_features", T.LongType()), ("weight", T.LongType()), ("score", T.LongType()), ("tl_eligible", T.BooleanType()))
    sent = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def run(batches):
        known = _Buckets(len(sent.value))
        for batch, words, features, found in _texts(batches, text, known, most):
            weight = textops.per_text(sent.value[found], np.concatenate(([0], np.cumsum(features))))
            noise = np.array([noise_of("" if i is None else str(i), seed) for i in batch.column(doc_id).to_pylist()], np.int64)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"n_features": pa.array(features), "weight": pa.array(weight), "score": pa.array(weight + noise), "tl_eligible": pa.array(words >= least)}
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in schema.names})

    return docs.mapInArrow(run, schema)


# ---------------------------------------------------------------- the draw


class Tournament:
    """A tree of matches between the heads of sorted runs: each node knows which leaf below it has the smallest head."""

    def __init__(self):
        self.heads: list[tuple | None] = [None]  # the head of each leaf, None where no run is open
        self.best = [0, 0]
        self.free = [0]

    def _play(self, node: int) -> None:
        size, heads = len(self.heads), self.heads
        a, b = ((2 * node - size, 2 * node + 1 - size) if 2 * node >= size else (self.best[2 * node], self.best[2 * node + 1]))
        self.best[node] = b if heads[b] is not None and (heads[a] is None or heads[b] < heads[a]) else a

    def add(self, head: tuple) -> int:
        """The leaf of a new run; the tree doubles when none is free."""
        if not self.free:
            size = len(self.heads)
            self.free = list(range(2 * size - 1, size - 1, -1))
            self.heads += [None] * size
            self.best = [0] * (2 * size)
            for node in range(2 * size - 1, 0, -1):
                self._play(node)
        leaf = self.free.pop()
        self.replace(leaf, head)
        return leaf

    def replace(self, leaf: int, head: tuple | None) -> None:
        """The leaf's next row, None at its end; matches are played again from it to the top."""
        self.heads[leaf] = head
        if head is None:
            self.free.append(leaf)
        node = (leaf + len(self.heads)) // 2
        while node:
            self._play(node)
            node //= 2

    @property
    def winner(self) -> tuple[int, tuple] | None:
        leaf = self.best[1]
        return None if self.heads[leaf] is None else (leaf, self.heads[leaf])


def merged(blocks: Iterator[list[tuple]], most: int) -> Iterator[tuple]:
    """The `most` smallest rows of sorted blocks that come in order of their first rows.

    A block joins when no open one has a row before its first, so of each run
    one block is open at a time.
    """
    tree, open_, given = Tournament(), {}, 0
    waiting = next(blocks, None)
    while given < most:
        best = tree.winner
        while waiting is not None and (best is None or waiting[0] <= best[1]):
            rows = iter(waiting)
            open_[tree.add(next(rows))] = rows
            waiting, best = next(blocks, None), tree.winner
        if best is None:
            return
        leaf, row = best
        yield row
        given += 1
        tree.replace(leaf, next(open_[leaf], None))


Row = tuple[int, int, int]


def _range_of(batch: pa.RecordBatch, bounds: list[Row]) -> np.ndarray:
    """The range of each row: how many bounds are not above it."""
    keys = batch.column("tl_key").to_numpy()
    firsts = np.array([b[0] for b in bounds], np.int64)
    out, upto = np.searchsorted(firsts, keys, "left"), np.searchsorted(firsts, keys, "right")
    for i in np.flatnonzero(out != upto).tolist():  # a bound has the same key: ids decide
        out[i] = bisect.bisect_right(bounds, tuple(batch.column(n)[i].as_py() for n in _KEY))
    return out


def _count_ranges(bounds: list[Row]):
    def run(batches):
        total = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            total += np.bincount(_range_of(batch, bounds), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"range": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    return run


def _cut_runs(bounds: list[Row], rows: int):
    """Blocks of at most `rows` rows of a partition's sorted rows, each inside one range."""

    def run(batches):
        for batch in batches:
            at = _range_of(batch, bounds)
            first = 0
            while first < batch.num_rows:
                last = min(first + rows, int(np.searchsorted(at, at[first], "right")))
                part = [batch.column(n).slice(first, last - first) for n in _KEY]
                yield pa.RecordBatch.from_arrays([pa.array([at[first]], pa.int32()), *(c.slice(0, 1) for c in part), *(pa.ListArray.from_arrays([0, last - first], c) for c in part)], schema=_BLOCK_ARROW)
                first = last

    return run


_KEY = ("tl_key", "tl_id", "tl_uid")
_BLOCK = "range int, first_key long, first_id long, first_uid long, keys array<long>, ids array<long>, uids array<long>"
_BLOCK_ARROW = pa.schema([("range", pa.int32()), *((n, pa.int64()) for n in ("first_key", "first_id", "first_uid")), *((n, pa.list_(pa.int64())) for n in ("keys", "ids", "uids"))])


def _merge_ranges(starts: list[int], sizes: list[int]):
    """Ranks of the rows of each range that a task holds; its blocks come sorted by range and first row."""

    def run(batches):
        def blocks():
            for batch in batches:
                for i in range(batch.num_rows):
                    keys, ids, uids = (batch.column(n)[i].as_py() for n in ("keys", "ids", "uids"))
                    yield batch.column("range")[i].as_py(), list(zip(keys, ids, uids, strict=True))

        source = blocks()
        ahead = next(source, None)
        while ahead is not None:
            here = ahead[0]

            def of_range(here=here):
                nonlocal ahead
                while ahead is not None and ahead[0] == here:
                    rows = ahead[1]
                    ahead = next(source, None)
                    yield rows

            group = of_range()
            uids, rank = [], starts[here]
            for row in merged(group, sizes[here]):
                uids.append(row[2])
                if len(uids) == 10_000:
                    yield _ranked(uids, rank)
                    rank, uids = rank + len(uids), []
            if uids:
                yield _ranked(uids, rank)
            for _ in group:  # what the draw leaves of the last range
                pass

    return run


def _ranked(uids: list[int], rank: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"tl_uid": pa.array(uids, pa.int64()), "rank": pa.array(np.arange(rank + 1, rank + 1 + len(uids)), pa.int64())})


def draw(rows: DataFrame, count: Callable[[int], int], score: str = "score", doc_id: str = "doc_id", eligible: str = "tl_eligible", range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(tl_uid, rank) of the count(n) first of n eligible rows, by falling score, then id, then tl_uid.

    rows must be a written table with a column tl_uid of unique whole numbers.
    """
    spark = rows.sparkSession
    last = 2**63 - 1
    keyed = rows.where(eligible).select((-F.col(score)).alias("tl_key"), F.coalesce(F.col(doc_id).cast("long"), F.lit(last)).alias("tl_id"), "tl_uid")
    n = keyed.count()
    most = count(n)
    if most <= 0:
        return spark.createDataFrame([], "tl_uid long, rank long")
    parts, bounds = max(1, min(RANGES, -(-n // range_rows))), []
    if parts > 1:
        # a sample says where to cut; counts and ranks are exact wherever the cuts are
        chosen = F.pmod(F.xxhash64("tl_uid"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE * parts / n) * (1 << 30)))
        sample = sorted(tuple(r) for r in keyed.where(chosen).collect())  # about SAMPLE * RANGES rows at most
        bounds = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []
    found = {r["range"]: r["n"] for r in keyed.mapInArrow(_count_ranges(bounds), "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).collect()}  # at most RANGES rows
    starts, sizes, before = [], [], 0
    for i in range(len(bounds) + 1):
        starts.append(before)
        sizes.append(min(found.get(i, 0), max(0, most - before)))
        before += found.get(i, 0)
    needed = max(i for i, size in enumerate(sizes) if size) + 1
    row = lambda values: F.struct(*(v.cast("long").alias(n) for n, v in zip(_KEY, values, strict=True)))
    top = keyed.where(row([F.col(n) for n in _KEY]) < row([F.lit(v) for v in bounds[needed - 1]])) if needed <= len(bounds) else keyed
    runs = top.sortWithinPartitions(*_KEY).mapInArrow(_cut_runs(bounds, block_rows), _BLOCK)
    dealt = runs.repartition(needed, "range").sortWithinPartitions("range", "first_key", "first_id", "first_uid")
    return dealt.select("range", "keys", "ids", "uids").mapInArrow(_merge_ranges(starts, sizes), "tl_uid long, rank long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep_text: bool = True, percent: int = PERCENT, least_words: int = LEAST_WORDS, most_words: int = MAX_WORDS, buckets: int = BUCKETS, seed: int = SEED, workspace: Workspace | None = None) -> DataFrame:
    """The rows with n_features, weight, score and rank (1, 2, 3, ... of the drawn ones, else null).

    Of n rows with at least least_words words, floor(percent * n / 100) are
    drawn. Ids must be whole numbers.
    """
    text_of(docs, text)
    ws = workspace or Workspace(docs.sparkSession)
    rows = without(docs, "n_features", "weight", "score", "rank", "tl_eligible", "tl_uid")
    gains = gains_of(bucket_counts(docs, text, buckets, most_words), bucket_counts(target, target_text, buckets, most_words))
    weighed = _weighed(rows, gains, doc_id, text, keep_text, most_words, seed, least_words)
    scored = ws.keep(weighed.withColumn("tl_uid", F.monotonically_increasing_id()), "scored")
    ranks = draw(scored, lambda n: percent * n // 100, doc_id=doc_id)
    return scored.join(ranks, "tl_uid", "left").drop("tl_uid", "tl_eligible")
