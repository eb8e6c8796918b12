"""Vectorised word and window hashing over UTF-8 buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D. All of these
separators are ASCII, so cutting the bytes cuts the characters alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A pseudo-random 64-bit value for each byte.
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
#: Another one, for hashes that are independent of the first.
_BYTE_2 = np.random.default_rng(20240608).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SLICE = 1 << 19
_tables: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables grow by doubling and are kept."""
    size = 1 << max(10, (n - 1).bit_length())
    for (b, have), table in list(_tables.items()):
        if b == base and have >= n:
            return table[:n]
    table = np.full(size, base, np.uint64)
    table[0] = 1
    table = np.cumprod(table, dtype=np.uint64)
    for key in [k for k in _tables if k[0] == base]:
        del _tables[key]
    if size <= 1 << 23:
        _tables[base, size] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on all bits."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `most` bytes in column `name`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(name))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def words(raw: np.ndarray, at: np.ndarray, separator: np.ndarray = SEPARATOR):
    """64-bit hashes of all words in order, words per text, and the words' byte spans.

    The bytes are taken in slices cut at a separator, so that one very long
    text needs a few megabytes beyond its words' hashes.
    """
    found, starts, ends, begin, total = [], [], [], 0, len(raw)
    while begin < total:
        end = min(begin + _SLICE, total)
        if end < total:
            back = np.flatnonzero(separator[raw[begin:end]])
            if len(back):
                end = begin + int(back[-1]) + 1
            else:
                while end < total and not separator[raw[end]]:
                    end += 1
        part = raw[begin:end]
        gap = separator[part]
        cuts = at[np.searchsorted(at, begin) : np.searchsorted(at, end, "right")] - begin
        before, after = np.empty(len(part), bool), np.empty(len(part), bool)
        before[0] = after[-1] = True
        before[1:], after[:-1] = gap[:-1], gap[1:]
        before[cuts[cuts < len(part)]] = True
        after[cuts[cuts > 0] - 1] = True
        inside = ~gap
        s, e = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        if len(s):
            found.append(span_hashes(part, s, e))
            starts.append(s + begin)
            ends.append(e + begin)
        begin = end
    if not found:
        empty = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64), empty, empty)
    s, e = np.concatenate(starts), np.concatenate(ends)
    counts = np.diff(np.searchsorted(s, at)).astype(np.int64)
    return np.concatenate(found), counts, s, e


def span_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of raw[first:last] for each pair of positions; `second` gives other ones."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_BYTE_2 if second else _BYTE)[raw] * powers(_BASE, len(raw)), out=sums[1:])
    h = (sums[last] - sums[first]) * powers(_INVERSE, len(raw) + 1)[first]
    return mix(h + (last - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of the k values from each position on; len(hashes)-k+1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for begin in range(0, n, _SLICE):
        part = hashes[begin : min(begin + _SLICE, n) + k - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(_BASE, len(part)), out=sums[1:])
        m = len(part) - k + 1
        out[begin : begin + m] = mix((sums[k:] - sums[:-k]) * powers(_INVERSE, m))
    return out


def window_starts(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in the run of all words, at which a window lies in one text; and windows per text."""
    per = np.maximum(counts - k + 1, 0)
    first = np.cumsum(counts) - counts
    total = int(per.sum())
    shift = np.repeat(first - (np.cumsum(per) - per), per)
    return np.arange(total, dtype=np.int64) + shift, per


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words from one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1) if len(starts) < 1000 else edge.__iadd__(np.bincount(starts, minlength=n + 1).astype(np.int32))
    ends = np.minimum(starts + k, n)
    edge -= np.bincount(ends, minlength=n + 1).astype(np.int32)
    return np.cumsum(edge[:-1]) > 0


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive offsets."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def counts_before(raw: np.ndarray, counted: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For sorted places in raw, how many bytes before each are counted, in memory of one slice."""
    found, before = np.empty(len(places), np.int64), 0
    at = 0
    for begin in range(0, max(len(raw), 1), _SLICE):
        part = counted[raw[begin : begin + _SLICE]]
        until = len(places) if begin + _SLICE >= len(raw) else int(np.searchsorted(places, begin + _SLICE))
        if until > at:
            sums = np.concatenate(([0], np.cumsum(part)))
            found[at:until] = before + sums[places[at:until] - begin]
            at = until
        before += int(np.count_nonzero(part))
    return found
