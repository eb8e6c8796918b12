"""Periodic runs: stretches of words that repeat with a fixed lag.

A run is a stretch with smallest period q and at least max(24, 3q) words that
neither neighbour extends. Method: the words of a text get whole-number ids, and
each bit of the ids is one big integer with a bit per word (a plane). For a lag
q, every plane is compared with itself shifted by q (XOR), the mismatches of all
planes are joined (OR), and ANDs with shifts that double keep those places
from which the words agree for as long as a run needs.

Lags are not tried blindly, which would take time with the square of a text.
A run of period q, 2**k <= q < 2**(k+1), k >= 3, agrees with itself over 2q words,
so the window of 2**(k+1) words at its start occurs again q words later; it
cannot occur earlier, since two periods in one stretch of that length have
their greatest common divisor as a period, and q would not be the smallest. So
the distances between neighbouring equal windows hold all periods from 8 on;
shorter ones are tried always. Windows get exact names by doubling (pairs of
names of half the length). A text of n words has at most about the square root
of n such lags. A text in which no window of 16 words comes twice has no run
at all and needs no more than that look.

Scale: one pass over the texts, nothing is shuffled; memory is a small multiple
of the longest text, time about n log n for texts of n words with few runs.

Defined cases: null and empty texts and texts of fewer than 24 words have no
runs, null and empty ones the empty collapsed text; very long texts are taken
whole, a run may span all of it; runs with equal exponents are ordered by start,
then period; repeated rows give repeated results, an empty table an empty one;
columns named like those added are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import textops
from turnloom.llm.columns import text_of, with_fields, without
from turnloom.llm.workspace import ship

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The shortest agreement of any run: of period q, max(24 - q, 2q) words.
_WINDOW = 16
_BATCH = 1 << 20


def planes_of(ids: np.ndarray) -> list[int]:
    """Bit planes of ids: bit i of the k-th number is bit k of ids[i]."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> k) & 1 == 1, bitorder="little").tobytes(), "little") for k in range(width)]


def agreement(planes: list[int], n: int, lag: int) -> int:
    """Bit i is set where words i and i + lag are the same."""
    differs = 0
    for plane in planes:
        differs |= plane ^ (plane >> lag)
    everywhere = (1 << (n - lag)) - 1
    return ~differs & everywhere


def long_stretches(bits: int, n: int, least: int) -> list[tuple[int, int]]:
    """(first, end) of the maximal stretches of at least `least` set bits."""
    have = 1
    while have < least and bits:
        step = min(have, least - have)
        bits &= bits >> step
        have += step
    if not bits:
        return []
    flags = np.unpackbits(np.frombuffer(bits.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n]
    edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) + least - 1).tolist(), strict=True))


def lags_of(ids: np.ndarray) -> list[int]:
    """All lags at which a run is possible, in order."""
    n = len(ids)
    most = n // LEAST_PERIODS
    lags = set(range(1, min(most, _WINDOW // 2 - 1) + 1))
    names, width = ids.astype(np.int64), 1
    while width <= most:
        # names of windows of twice the width, from pairs of names
        m = len(names) - width
        if m < 2:
            break
        pairs = names[:m] * (int(names.max()) + 1) + names[width : width + m]
        _, names = np.unique(pairs, return_inverse=True)
        width *= 2
        if width < _WINDOW:
            continue
        order = np.argsort(names, kind="stable")
        again = np.flatnonzero(names[order[1:]] == names[order[:-1]])
        if not len(again):
            break
        apart = order[again + 1] - order[again]
        lags.update(np.unique(apart[(2 * apart >= width) & (apart < width) & (apart <= most)]).tolist())
    return sorted(lags)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of ids, by start and period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    planes, found = planes_of(ids), {}
    for lag in lags_of(ids):
        least = max(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag)
        for first, end in long_stretches(agreement(planes, n, lag), n, least):
            # the same stretch at a multiple of its smallest period has been found already
            found.setdefault((first, end + lag - first), lag)
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact exponent; of equal ones the first, then that of the smallest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _numbered(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def _may_repeat(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts have a window of 16 words twice, by hashes: equal windows have equal hashes."""
    hashes, counts, _, _ = textops.words(raw, at)
    starts, per = textops.window_starts(counts, _WINDOW)
    out = np.zeros(len(counts), bool)
    if len(starts):
        window = textops.windows(hashes, _WINDOW)[starts]
        owner = np.repeat(np.arange(len(counts)), per)
        order = np.lexsort((window, owner))
        window, owner = window[order], owner[order]
        out[owner[1:][(window[1:] == window[:-1]) & (owner[1:] == owner[:-1])]] = True
    return out


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_RUN_ARROW = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def _struct(run):
    return None if run is None else dict(zip(("start", "length", "period"), run, strict=True))


def find_runs(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with n_words, runs, strongest and collapsed.

    runs: all runs by start and period; strongest: the one with the greatest
    length in periods, null without a run; collapsed: the text of the words that
    are left when each run keeps its first period, joined by one space.
    """
    text_of(docs, text)
    ship(docs.sparkSession)
    docs = without(docs, "n_words", "runs", "strongest", "collapsed")
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = with_fields(T.StructType(kept), ("n_words", T.LongType()), ("runs", T.ArrayType(_RUN)), ("strongest", _RUN), ("collapsed", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.slices(batches, text, _BATCH):
            raw, at = textops.buffers(batch.column(text))
            whole, repeats = raw.tobytes(), _may_repeat(raw, at)
            sizes, runs, left = [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                words = whole[a:b].split()  # bytes split at 0x20 and 0x09-0x0D only
                found = runs_of(_numbered(words)) if repeats[i] else []
                sizes.append(len(words))
                runs.append(found)
                left.append(b" ".join(collapsed(words, found)).decode())
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {
                "n_words": pa.array(sizes, pa.int64()),
                "runs": pa.array([[_struct(r) for r in found] for found in runs], pa.list_(_RUN_ARROW)),
                "strongest": pa.array([_struct(strongest(found)) for found in runs], _RUN_ARROW),
                "collapsed": pa.array(left, pa.string()),
            }
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in schema.names})

    return docs.mapInArrow(run, schema)


def repeat_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, where one text in ten has its words from some place on replaced by repetitions of a few of them.

    With h = crc32 of the decimal id and g = h // 10, a text of n words is
    changed where h % 10 = 0: each word i >= a becomes word a + (i - a) % p, with
    a = g % n and p = 1 + (n - a) // (3 + g % 8). Null ids leave their texts alone.
    """
    text_of(docs, text)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(doc_id).to_pylist(), batch.column(text)
            hashes = [None if i is None else zlib.crc32(str(i).encode()) for i in ids]
            changed = {}
            for row, h in enumerate(hashes):
                if h is None or h % 10 or not texts[row].is_valid:
                    continue
                words, g = texts[row].as_py().encode().split(), h // 10
                if n := len(words):
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    block, rest = words[a : a + p], n - a
                    changed[row] = b" ".join(words[:a] + (block * (rest // p + 1))[:rest]).decode()
            if changed:
                new = pa.array([changed.get(row) for row in range(len(ids))], texts.type)
                texts = pc.if_else(pa.array([row in changed for row in range(len(ids))]), new, texts)
            yield pa.RecordBatch.from_arrays([texts if n == text else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def run_digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts, the strongest run and hashes of the runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select(
        doc_id,
        F.size("runs").cast("long").alias("n_runs"),
        *(best[n].alias(n) for n in ("start", "length", "period")),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
