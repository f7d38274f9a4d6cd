"""Vectorised text kernels shared by the corpus operators.

All of them work on one Arrow string column at a time: the UTF-8 bytes of a
chunk of documents lie in one flat ``uint8`` array, so tokenising, hashing and
shingling are a fixed number of NumPy passes over the bytes, with no Python
loop over words.  Chunks are bounded in bytes, so memory does not depend on how
many rows an Arrow batch holds; a single document longer than the bound forms a
chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
CHUNK_BYTES = 1_000_000
#: Words in a shingle.
SHINGLE = 5

_GOLDEN = 0x9E3779B97F4A7C15
_MASK = 0xFFFFFFFFFFFFFFFF


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64); wraps silently."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(_GOLDEN)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    """``mix`` for one Python integer."""
    x = (x + _GOLDEN) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting: on long arrays of hashes several times faster than by a hash table."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its ``n + 1`` offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, dtype=np.uint8, count=int(ends[-1] - ends[0]), offset=int(ends[0])), ends - ends[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, most: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``limit`` bytes and at most ``most`` rows."""
    data, ends = flat(column)
    row, n = 0, len(ends) - 1
    while row < n:
        stop = min(row + most, max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1))
        yield row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def _table(words: bool) -> np.ndarray:
    """Per byte: 0 for a separator, else the byte, A-Z lowered."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if words:
        keep = np.zeros(256, bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
        keep[95] = True
        t[~keep] = 0
    else:
        t[[9, 10, 11, 12, 13, 32]] = 0
    return t


def tokenize(data: np.ndarray, ends: np.ndarray, words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a chunk: (hash, first byte, end byte, row), in text order.

    With ``words`` False a token is a run of anything but space, tab to carriage
    return, with A-Z lowered.  With ``words`` True it is a run of letters, digits
    and underscores (every non-ASCII byte counts as a letter), and the capital
    letters of Latin-1 are lowered too.  A NUL byte separates in both modes only
    if ``words`` is True; otherwise it is an ordinary byte.
    """
    t = _table(words)[data]
    if words and len(t):
        lead = data == 0xC3
        after = np.zeros(len(t), bool)
        after[1:] = lead[:-1]
        after &= (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        t[after] += 0x20
        mask = t != 0
    else:
        mask = (t != 0) | (data == 0)
    n = len(t)
    empty = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), empty, empty, empty
    edge = np.zeros(n + 1, bool)
    edge[ends[:-1][ends[:-1] < n]] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    before &= ~edge[:n]
    starts = np.flatnonzero(mask & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), empty, empty, empty
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    after &= ~edge[1 : n + 1]
    stops = np.flatnonzero(mask & ~after) + 1
    lens = stops - starts
    at = np.flatnonzero(mask)
    within = at - np.repeat(starts, lens)
    power = np.empty(int(lens.max()), np.uint64)
    power[0] = 1
    power[1:] = 0x100000001B3 | 1 << 41
    power = np.cumprod(power, dtype=np.uint64)
    value = (t[at].astype(np.uint64) + np.uint64(1)) * power[within]
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    h = np.add.reduceat(value, first)
    h = mix(h ^ (lens.astype(np.uint64) << np.uint64(48)))
    rows = np.searchsorted(ends, starts, side="right") - 1
    return h, starts, stops, rows


def shingle(h: np.ndarray, rows: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of ``size`` tokens: (hash, row, index of its first token).

    A row with fewer tokens, but at least one, has one shingle of all of them.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    same = np.arange(n)
    full = np.zeros(n, bool)
    if n >= size:
        full[: n - size + 1] = rows[: n - size + 1] == rows[size - 1 :]
    for i in range(size):
        m = n - i
        odd = np.uint64(mix_int(i + 77) | 1)
        part = np.zeros(n, np.uint64)
        inside = rows[i:] == rows[:m]
        part[:m] = np.where(inside, h[i:] * odd, np.uint64(0))
        acc += part
    first = np.ones(n, bool)
    first[1:] = rows[1:] != rows[:-1]
    short = first & ~full
    keep = full | short
    return mix(acc[keep]), rows[keep], same[keep]


def counted(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with their counts, by row and then hash."""
    if not len(h):
        return h, rows, np.zeros(0, np.int64)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return h[at], rows[at], np.diff(np.append(at, len(h)))
