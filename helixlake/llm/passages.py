"""Passages that repeat across documents, by compact windows.

For one hash function over five-word shingles, all stretches of a text whose
minimum is the same shingle form a compact window (left, centre, right): the
subtree of that shingle in the Cartesian tree of the hashes.  Only windows long
enough for a passage are made; their centres are the minima of the stretches of
just that length, which sliding minima give for a whole batch at once.

Windows of different texts meet on their shingle; each is held against the
first window of its key.  Where windows pair the same two texts, the intervals
they have in common are joined, the texts' shingles are aligned there, and the
passages verified.

The first text of a key may share no more than a common line with the others,
while two of these share a passage around that line.  So there are more rounds:
a window that isn't in a passage gets a new centre, the least shingle of those
that its first text was not found to share, and meets others under a key of both
centres.  What two texts share around a centre is held against the same first
text in both, so they leave out the same of it and meet again, under ever rarer
shingles, until one is held against the other or nothing meets.  Stretches of
which nothing is left meet under a key of their whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.llm import kernels
from helixlake.llm.common import discard, release, sliced, stored, table
from helixlake.llm.nodes import document_nodes, fingerprints, text_sequences, with_sequences

#: Least words of a passage, hash functions, how many of them must agree (as every candidate is verified, one will do), and the least similarity.
WORDS, HASHES, AGREE, LEAST = 50, 4, 1, 0.8
#: Shingles that an insertion or deletion may move the second text against the first, and that an edit may leave unmatched: as many as one may between two parts that are passages only together.
DRIFT, GAP = 14, 18
#: Shingles around the meets of a pair that are aligned at first.
PAD = 64
#: What stands for the hash function in windows that meet under a key of their whole.
WHOLE = 15


def _sliding(x: np.ndarray, t: int, take: np.ufunc, fill: int) -> np.ndarray:
    """``take`` over x[i : i + t] for every i (short at the end), by blocks of t: prefixes and suffixes."""
    n = len(x)
    pad = np.full(-n % t + t, fill, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, t)
    forward = take.accumulate(blocks, axis=1).ravel()
    backward = take.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(backward[:n], forward[t - 1 : n + t - 1])


def compact_windows(v: np.ndarray, rows: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, left, right) of all compact windows of at least ``t`` values of one hash function.

    ``rows`` says which text a value belongs to; windows stay within one.  Bounds
    are indices into ``v``, right inclusive.  Among equal values the first is the
    parent of the others, so windows of equal values nest and don't repeat.
    """
    n = len(v)
    none = np.zeros(0, np.int64)
    if n < t:
        return none, none, none
    whole = np.zeros(n, bool)
    whole[: n - t + 1] = rows[: n - t + 1] == rows[t - 1 :]
    least = np.where(whole, _sliding(v, t, np.minimum, np.iinfo(np.uint64).max), np.uint64(0))
    # the largest minimum among the stretches that hold a place; equal to its value if it is the minimum of one
    most = _sliding(least[::-1], t, np.maximum, 0)[::-1]
    at = np.flatnonzero((v == most) & (most > 0))
    if not len(at):
        return none, none, none
    first = np.searchsorted(rows, rows[at], side="left")
    last = np.searchsorted(rows, rows[at], side="right") - 1
    value, place, begin, end = v[at].tolist(), at.tolist(), first.tolist(), last.tolist()
    left, right = [0] * len(at), [0] * len(at)
    stack: list[int] = []
    text = -1
    for i, x in enumerate(value):
        if begin[i] != text:
            for j in stack:
                right[j] = end[j]
            stack, text = [], begin[i]
        while stack and value[stack[-1]] > x:
            right[stack.pop()] = place[i] - 1
        left[i] = place[stack[-1]] + 1 if stack else begin[i]
        stack.append(i)
    for j in stack:
        right[j] = end[j]
    left, right = np.array(left), np.array(right)
    long = right - left + 1 >= t
    return at[long], left[long], right[long]


def _place(c: np.ndarray, left: np.ndarray, right: np.ndarray, i: int, t: int) -> np.ndarray:
    """A window in one number: centre, reach to either side (no passage of ``t`` around it goes further), hash function."""
    reach = min(t, 1 << 13) - 1
    return c.astype(np.int64) << 30 | np.minimum(c - left, reach).astype(np.int64) << 17 | np.minimum(right - c, reach).astype(np.int64) << 4 | i


def _localised(key: np.ndarray, node: np.ndarray, place: np.ndarray, mask: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(key, node, place, last) and ``mask``, if given, of a batch's windows: ``last`` is null but for the first window of a key, which names the key's last node."""
    if not len(key):
        return
    order = np.lexsort((place, node, key))
    key, node, place = key[order], node[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    last = np.zeros(len(key), np.int64)
    last[new] = node[np.append(np.flatnonzero(new)[1:], len(key)) - 1]
    columns = [pa.array(key), pa.array(node), pa.array(place), pa.array(last, mask=~new)]
    step = 200_000
    names = ["key", "node", "place", "last"]
    if mask is not None:
        columns.append(_binary(mask[order]))
        names.append("mask")
    made = pa.RecordBatch.from_arrays(columns, names=names)
    for a in range(0, made.num_rows, step):
        yield made.slice(a, step)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of equally long rows of bytes."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, width * (n + 1), width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


_WINDOWS = "key long, node long, place long, last long"


def _order(s: np.ndarray, i: int) -> np.ndarray:
    """The hash of function ``i`` of shingles by their upper 32 bits, which is what sequences keep."""
    return kernels.mix(s.astype(np.uint64) ^ np.uint64(kernels.mix_int(i + 501)))


def windows(docs: DataFrame, words: int = WORDS, hashes: int = HASHES, text: str = "text") -> DataFrame:
    """Compact windows of every distinct text of a batch: (key, node, place, last); see ``_localised``.

    The key is a hash of the shingle at the centre and of the hash function's number.
    """
    t = words - kernels.SHINGLE + 1
    rows = docs.select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 5000):
            seen: np.ndarray = np.zeros(0, np.int64)
            parts: list[list[np.ndarray]] = []
            for _, data, ends in kernels.chunks(batch.column(0)):
                n = len(ends) - 1
                h, _, _, r = kernels.tokenize(data, ends, words=True)
                node, count = fingerprints(h, r, n)
                fresh = np.zeros(n, bool)
                fresh[np.unique(node, return_index=True)[1]] = True
                fresh &= (count >= words) & ~np.isin(node, seen)
                seen = np.concatenate([seen, node[fresh]])
                s, sr, _ = kernels.shingle(h, r)
                s, sr = s[fresh[sr]], sr[fresh[sr]]
                begin = np.searchsorted(sr, np.arange(n))
                for i in range(hashes):
                    c, left, right = compact_windows(_order(s >> np.uint64(32), i), sr, t)
                    d = sr[c]
                    key = kernels.mix(s[c] ^ np.uint64(kernels.mix_int(i + 601)))
                    parts.append([key.view(np.int64), node[d], _place(c - begin[d], left - begin[d], right - begin[d], i, t)])
            if parts:
                yield from _localised(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return rows.mapInArrow(run, _WINDOWS)


def redrawn(held: DataFrame, words: int = WORDS) -> DataFrame:
    """The windows of ``held`` (node, windows, seq, told) under new centres: (key, node, place, last, mask).

    ``windows`` lists (place, mask): the mask has a bit for each place that can be
    in a passage with the centre, set where the shingle was found to be shared.
    Every passage's length in a window that isn't in the known passages, which
    ``told`` lists as (start, end), gets the least shingle of the others as its
    centre; those without any meet under a key of all their shingles.
    """
    t = words - kernels.SHINGLE + 1
    width = 2 * t - 1
    low = np.uint64((1 << 31) - 1)
    salts = np.array([kernels.mix_int(i + 501) for i in range(16)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 400):
            if not batch.num_rows:
                continue
            s, begin = _shorts(batch.column("seq"))
            lists = batch.column("windows")
            who = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            rows = lists.flatten()
            known = batch.column("told")
            depth = np.zeros(len(s) + 1, np.int64)
            base = begin[np.repeat(np.arange(batch.num_rows), np.diff(known.offsets.to_numpy()))] if len(known.flatten()) else np.zeros(0, np.int64)
            np.add.at(depth, base + known.flatten().field("start").to_numpy(), 1)
            np.add.at(depth, base + known.flatten().field("end").to_numpy(), -1)
            untold = np.concatenate([[0], np.cumsum(np.cumsum(depth)[:-1] == 0)])
            parts: list[list[np.ndarray]] = []
            step = 4000
            for at in range(0, len(who), step):
                w = who[at : at + step]
                place = rows.field("place").slice(at, step).to_numpy()
                bits = np.frombuffer(b"".join(rows.field("mask").slice(at, step).to_pylist()), np.uint8).reshape(len(w), -1)
                mask = np.unpackbits(bits, axis=1, count=width).astype(bool)
                c, i = place >> 30, place & 15
                x0, x1 = t - 1 - (place >> 17 & 0x1FFF), (place >> 4 & 0x1FFF)  # the first and last stretch, by its first place
                column = np.arange(width)
                shingles = s[np.clip(begin[w, None] + c[:, None] - (t - 1) + column, begin[w, None], begin[w + 1, None] - 1)]
                v = kernels.mix(shingles.astype(np.uint64) ^ salts[i][:, None]) & ~low
                v = np.where(mask, ~low, v) | column.astype(np.uint64)
                reach, least = 1, v
                while 2 * reach <= t:
                    least = np.minimum(least[:, :-reach], least[:, reach:])
                    reach *= 2
                least = np.minimum(least[:, : width - t + 1], least[:, t - reach : width - reach + 1])
                starts = np.arange(t)
                inside = (starts >= x0[:, None]) & (starts <= x1[:, None])
                begins = begin[w, None] + np.clip(c[:, None] - (t - 1) + starts, 0, None)
                inside &= untold[np.minimum(begins + t, len(s))] > untold[np.minimum(begins, len(s))]
                none = inside & (least >= ~low)
                inside &= ~none
                to = (least & low).astype(np.int64)
                fresh = inside.copy()
                fresh[:, 1:] &= ~inside[:, :-1] | (to[:, 1:] != to[:, :-1])
                final = inside.copy()
                final[:, :-1] &= ~inside[:, 1:] | (to[:, 1:] != to[:, :-1])
                r, x = np.nonzero(fresh)
                y = np.nonzero(final)[1] + t - 1
                to = to[r, x]
                key = kernels.mix(shingles[r, t - 1].astype(np.uint64) << np.uint64(32) | shingles[r, to].astype(np.uint64)) ^ (to << 8 | i[r]).astype(np.uint64)
                moved = column + (to - (t - 1))[:, None]
                left = (moved >= 0) & (moved < width) & mask[r[:, None], np.clip(moved, 0, width - 1)]
                first = c[r] - (t - 1)
                parts.append([kernels.mix(key).view(np.int64), w[r], _place(first + to, first + x, first + y, 0, t) | i[r], np.packbits(left, axis=1)])
                r, x = np.nonzero(none)
                if len(r):
                    key = np.full(len(r), kernels.mix_int(77), np.uint64)
                    for k in range(t):
                        key = kernels.mix(key ^ shingles[r, x + k].astype(np.uint64))
                    first = c[r] - (t - 1) + x
                    parts.append([key.view(np.int64), w[r], _place(first, first, first + t - 1, WHOLE, t), np.full((len(r), -(-width // 8)), 255, np.uint8)])
            if parts:
                key, w, place, mask = (np.concatenate(x) for x in zip(*parts, strict=True))
                _, only = np.unique(np.stack([key, w, place]), axis=1, return_index=True)
                yield from _localised(key[only], batch.column("node").to_numpy()[w[only]], place[only], mask[only])

    return held.select("node", "windows", "seq", "told").mapInArrow(run, _WINDOWS + ", mask binary")


def candidates(found: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b, seeds): the texts of each window, with that of the first window of its key; windows that are alone are left out.

    A seed is the place in either text, and the mask of the first one's.  The number of seeds of a pair is at most
    that of its first text's windows; a text is paired with itself where the
    first text of a key has it again, a passage away.  Only a batch's first
    window of a key takes part in finding the key's first, so a shingle that is
    in every text is a row a batch there; all others meet the first in a join.
    """
    group = Window.partitionBy("key")
    lead = found.where("last is not null").withColumns({"hub": F.min(F.struct("node", "place")).over(group), "hi": F.max("last").over(group)})
    mask = [x for x in found.columns if x == "mask"]
    lead = stored(lead.where("hub.node <> hi").select("key", "node", "place", "hub", *mask), "leads")
    release(found.sparkSession)
    hubs = lead.where("node = hub.node and place = hub.place").select("key", "hub")
    rest = found.where("last is null").select("key", "node", "place", *mask).join(hubs, "key")
    met = lead.where("node <> hub.node or place <> hub.place").unionByName(rest)
    met = met.where(f"node <> hub.node or shiftright(place, 30) - shiftright(hub.place, 30) >= {words}")
    seed = F.struct("place", F.col("hub.place").alias("other"), (F.col("mask") if mask else F.lit(None).cast("binary")).alias("mask"))
    pairs = stored(met.groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.collect_list(seed).alias("seeds")), "candidates")
    discard(lead)
    return pairs


def regions(place: np.ndarray, other: np.ndarray, drift: int = DRIFT) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shift, first, last, hash function) of the windows' meets, for groups of windows whose centres are shifted alike.

    A meet is the interval that a window and the one it meets have in common, in
    places of the first text.
    """
    c, h = place >> 30, other >> 30
    shift = c - h
    order = np.argsort(shift, kind="stable")
    out = []
    at = 0
    while at < len(order):
        low = shift[order[at]]
        to = int(np.searchsorted(shift[order], low + drift, side="right"))
        w = order[at:to]
        lo = np.minimum(place[w] >> 17 & 0x1FFF, other[w] >> 17 & 0x1FFF)
        hi = np.minimum(place[w] >> 4 & 0x1FFF, other[w] >> 4 & 0x1FFF)
        if shift[w[-1]] > low:
            most, times = np.unique(shift[w], return_counts=True)
            low = most[times.argmax()]
        out.append((int(low), c[w] - lo, c[w] + hi, place[w] & 15))
        at = to
    return out


def _matches(a: np.ndarray, b: np.ndarray, shift: int, lo: int, hi: int, drift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``a`` between ``lo`` and ``hi`` whose shingle stands in ``b`` within ``drift`` of the shift, and where: the nearest."""
    m = len(b)
    match = np.full(hi - lo, -1, np.int64)
    if not m:
        return match[:0], match[:0]
    x, y = max(lo, shift), min(hi, m + shift)
    if x < y:
        hit = np.flatnonzero(a[x:y] == b[x - shift : y - shift]) + x
        match[hit - lo] = hit - shift
    rest = lo + np.flatnonzero(match < 0)
    by = np.arange(1, drift + 1)
    by = shift + np.stack([-by, by], axis=1).ravel()
    for k in range(0, len(rest), 4096):
        part = rest[k : k + 4096]
        to = part[:, None] - by
        hit = (to >= 0) & (to < m)
        hit &= a[part][:, None] == b[np.clip(to, 0, m - 1)]
        nearest = hit.argmax(axis=1)
        row = np.flatnonzero(hit[np.arange(len(part)), nearest])
        match[part[row] - lo] = to[row, nearest[row]]
    at = np.flatnonzero(match >= 0)
    return at + lo, match[at]


def _alike(a: np.ndarray, b: np.ndarray, s: int, e: int, hs: int, he: int) -> float:
    """Similarity of the shingle sets of a[s:e] and b[hs:he]."""
    x, y = kernels.distinct(a[s:e]), kernels.distinct(b[hs:he])
    both = len(x) + len(y) - len(kernels.distinct(np.concatenate([x, y])))
    return both / (len(x) + len(y) - both)


def _before(x: np.ndarray) -> np.ndarray:
    """Where each value stood last; -1 for a value's first place."""
    order = np.argsort(x, kind="stable")
    again = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    before = np.full(len(x), -1)
    before[order[again + 1]] = order[again]
    return before


def _pairs_from(rows: tuple[int, int], columns: int, low: np.ndarray, to: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row k in ``rows`` and column x, how many items have low <= k < to and high <= x."""
    n = rows[1] - rows[0]
    low, to = np.clip(low - rows[0], 0, n), np.clip(to - rows[0], 0, n)
    some = (low < to) & (high < columns)
    low, to, high = low[some], to[some], high[some]
    size = (n + 1) * columns
    change = np.bincount(low * columns + high, minlength=size) - np.bincount(to * columns + high, minlength=size)
    return change.reshape(n + 1, columns)[:n].cumsum(axis=0).cumsum(axis=1)


def _may_be_passages(part: np.ndarray, hull: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, least_shingles: int, least: float, cells: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(k, all x) where part[begin[k] : end[x]] is long enough and may be as alike as ``least`` to what it meets in ``hull``.

    Runs meet low[k] : high[k].  What is compared holds at least the shingles between
    ``inner`` bounds and at most those between ``outer`` ones, which rise from run to run.
    Where the runs' meets rise too and no shingle stands twice in ``hull``, no other pairs are returned.
    """
    n = len(begin)
    before, again = _before(part), _before(hull)
    inner = np.maximum.accumulate(low), np.minimum.accumulate(high[::-1])[::-1]
    outer = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)
    place, there = np.arange(len(part)), np.arange(len(hull))
    values, ids = np.unique(hull, return_inverse=True)
    first, last = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    first[ids[::-1]], last[ids] = there[::-1], there
    at = np.minimum(np.searchsorted(values, part), len(values) - 1)
    common = values[at] == part
    own = np.searchsorted(begin, before, side="right"), np.searchsorted(begin, place, side="right"), np.searchsorted(end, place, side="right")
    met = np.searchsorted(inner[0], again, side="right"), np.searchsorted(inner[0], there, side="right"), np.searchsorted(inner[1], there, side="right")
    to = np.minimum(own[1], np.searchsorted(outer[0], last[at], side="right"))[common]
    since = np.maximum(own[2], np.searchsorted(outer[1], first[at], side="right"))[common]
    step = max(1, cells // n)
    for k in range(0, n, step):
        rows = k, min(n, k + step)
        size = _pairs_from(rows, n, *own) + _pairs_from(rows, n, *met)
        both = _pairs_from(rows, n, own[0][common], to, since)
        may = (end - begin[rows[0] : rows[1], None] >= least_shingles) & ((1 + least) * both >= least * size - 1e-6)
        for i in np.flatnonzero(may.any(axis=1)).tolist():
            yield k + i, np.flatnonzero(may[i])


def _inner(a: np.ndarray, b: np.ndarray, w: np.ndarray, other: np.ndarray, least_shingles: int, least: float) -> list[tuple[int, int, int, int, float]]:
    """The passages within a stretch that isn't one: all that are in no longer one, from the begin of a run of matches to the end of a run.

    A shorter end of a run would only lower the similarity.  Bounds of the similarity of
    all parts are found at once, so most are not compared.
    """
    cut = np.flatnonzero((np.diff(w) > 1) | (np.diff(other) != 1))
    s, e, base = int(w[0]), int(w[-1]) + 1, int(other.min())
    first, last = np.append(0, cut + 1), np.append(cut, len(w) - 1)
    begin, end = w[first] - s, w[last] + 1 - s
    part = a[s:e]
    out: list[tuple[int, int, int, int, float]] = []
    reach = -1
    for k, may in _may_be_passages(part, b[base : int(other.max()) + 1], begin, end, other[first] - base, other[last] + 1 - base, least_shingles, least):
        for x in may[::-1].tolist():
            if x <= reach:
                break  # within one that begins before
            hs, he = int(other[first[k : x + 1]].min()), int(other[last[k : x + 1]].max()) + 1
            similarity = _alike(part, b, int(begin[k]), int(end[x]), hs, he)
            if similarity >= least:
                out.append((s + int(begin[k]), s + int(end[x]), hs, he, similarity))
                reach = x
                break
    return out


def align(a: np.ndarray, b: np.ndarray, region: tuple[int, np.ndarray, np.ndarray, np.ndarray], least_shingles: int, least: float, agree: int = AGREE, cut_left: bool = False, cut_right: bool = False, drift: int = DRIFT, gap: int = GAP) -> tuple[list[tuple[int, int, int, int, float]], list[tuple[int, int]]] | None:
    """What two shingle sequences share in one of their ``regions``.

    Returns passages (start, end, other start, other end, similarity), in
    shingles, ends exclusive, and the runs (start, end) that are matched but not
    in passages.  A shingle of ``a`` is matched if it stands in ``b`` within
    ``drift`` of the shift.  Stretches go on over gaps of at most ``gap``; those
    on which meets of ``agree`` hash functions or more lie are passages if they are
    long enough and the similarity of their shingle sets is at least ``least``;
    else all their longest parts that are so are passages.  None where
    a stretch comes to an end of ``a`` at which it was cut from a longer text.
    """
    shift, first, last, which = region
    lo, hi, pad = int(first.min()), int(last.max()) + 1, 64
    while True:  # as far as the stretches go
        where, match = _matches(a, b, shift, max(0, lo - pad), min(len(a), hi + pad), drift)
        open_left = len(where) and lo - pad > 0 and where[0] <= lo - pad + gap
        open_right = len(where) and hi + pad < len(a) and where[-1] >= hi + pad - gap - 1
        if not open_left and not open_right:
            break
        pad *= 4
    if not len(where):
        return [], []
    cut = np.flatnonzero(np.diff(where) > gap + 1)
    out: list[tuple[int, int, int, int, float]] = []
    runs: list[tuple[int, int]] = []
    todo = [(where[x:y], match[x:y]) for x, y in zip([0, *(cut + 1).tolist()], [*(cut + 1).tolist(), len(where)], strict=True)]
    met = [len(set(which[(first <= w[-1]) & (last >= w[0])].tolist())) for w, _ in todo]
    todo = [(*w, k >= agree) for w, k in zip(todo, met, strict=True) if k]
    if any(cut_left and w[0] <= gap or cut_right and w[-1] >= len(a) - gap - 1 for w, _, _ in todo):
        return None
    for w, other, enough in todo:
        s, e = int(w[0]), int(w[-1]) + 1
        told: list[tuple[int, int, int, int, float]] = []
        if enough and e - s >= least_shingles:
            hs, he = int(other.min()), int(other.max()) + 1
            if len(w) == e - s == he - hs:
                out.append((s, e, hs, he, 1.0))
                continue
            similarity = _alike(a, b, s, e, hs, he)
            told = [(s, e, hs, he, similarity)] if similarity >= least else _inner(a, b, w, other, least_shingles, least)
        out += told
        at = np.flatnonzero(np.diff(w) > 1)
        own = [(int(w[x]), int(w[y]) + 1) for x, y in zip(np.append(0, at + 1), np.append(at, len(w) - 1), strict=True)]
        runs += [(x, y) for x, y in own if not any(s <= x and y <= e for s, e, *_ in told)]
    return out, runs


def merged(rows: list[tuple]) -> list[tuple]:
    """Rows (start, end, other, other_start, other_end, similarity) of one text with overlapping ones joined: each stretch keeps its longest piece's other."""
    out: list[tuple] = []
    rank = lambda r: (r[4] - r[3], r[5], -r[2])
    for r in sorted(rows):
        if out and r[0] < out[-1][1]:
            best = max(out[-1], r, key=rank)
            out[-1] = (out[-1][0], max(out[-1][1], r[1]), *best[2:])
        else:
            out.append(r)
    return out


#: What a row of ``aligned`` is: a passage of the first text, of the second, within one text, a window that isn't in a passage, a pair that needs whole texts.
FIRST, SECOND, WITHIN, OPEN, CUT = range(5)


def _with_pieces(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """``pairs`` with seq_a and seq_b, cut to ``PAD`` shingles around the meets, and where the pieces begin and which ends of seq_a are cut."""
    bytes_, margin = 4, PAD + DRIFT
    low = "array_min(transform(seeds, x -> shiftright(x.place, 30) - (shiftright(x.place, 17) & 8191)))"
    high = "array_max(transform(seeds, x -> shiftright(x.place, 30) + (shiftright(x.place, 4) & 8191)))"
    shifts = "transform(seeds, x -> shiftright(x.place, 30) - shiftright(x.other, 30))"
    rows = pairs.selectExpr("a", "b", "seeds", f"{low} as low", f"{high} as high", f"array_min({shifts}) as near", f"array_max({shifts}) as far")
    piece = lambda seq, start, n: F.substring(seq, F.col(start).cast("int") * bytes_ + 1, F.col(n).cast("int") * bytes_)
    first = sequences.select(F.col("node").alias("a"), F.col("seq").alias("whole"))
    rows = rows.join(first, "a").withColumns({"from_a": F.greatest(F.lit(0), F.col("low") - PAD), "n": F.col("high") - F.col("low") + 2 * PAD + 1})
    rows = rows.withColumns({"cut_left": F.col("from_a") > 0, "cut_right": F.col("from_a") + F.col("n") < F.length("whole") / bytes_, "seq_a": piece(F.col("whole"), "from_a", "n")}).drop("whole", "low", "high")
    second = sequences.select(F.col("node").alias("b"), F.col("seq").alias("whole"))
    begin = F.col("from_a") - F.col("far") - DRIFT
    end = F.col("from_a") + F.col("n") - F.col("near") + DRIFT
    rows = rows.join(second, "b").withColumns({"from_b": F.greatest(F.lit(0), begin), "end_b": end}).withColumn("n", F.col("end_b") - F.col("from_b"))
    return rows.withColumn("seq_b", piece(F.col("whole"), "from_b", "n")).select("a", "b", "seeds", "seq_a", "seq_b", "from_a", "from_b", "cut_left", "cut_right")


def _shorts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a binary column, and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.view(np.uint32) if values.ctypes.data % 4 == 0 else np.frombuffer(values.tobytes(), np.uint32), (ends - ends[0]) // 4


def _far_apart(shift: np.ndarray, at: np.ndarray, x: tuple, y: tuple, cuts: list[np.ndarray], least_common: float) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs of pieces can't hold a passage, places of the first pieces that equal the second's at the shift).

    These pairs meet at one shift, no shingle stands twice in the first piece, and
    fewer than ``least_common`` of its shingles are anywhere in the second, nor
    any of those from which a stretch may go on past a cut end (``cuts``).
    """
    (a, begin_a), (b, begin_b) = x, y
    n = len(begin_a) - 1
    one = np.minimum.reduceat(shift, at) == np.maximum.reduceat(shift, at)
    shift = shift[at]
    row = np.repeat(np.arange(n), np.diff(begin_a))
    tag_a = row.astype(np.uint64) << np.uint64(32) | a
    tag_b = kernels.distinct(np.repeat(np.arange(n), np.diff(begin_b)).astype(np.uint64) << np.uint64(32) | b)
    where = np.minimum(np.searchsorted(tag_b, tag_a), max(0, len(tag_b) - 1))
    anywhere = np.concatenate([[0], np.cumsum(tag_b[where] == tag_a if len(tag_b) else np.zeros(len(a), bool))])
    common = anywhere[begin_a[1:]] - anywhere[begin_a[:-1]]
    left = anywhere[np.minimum(begin_a[:-1] + GAP + 1, begin_a[1:])] - anywhere[begin_a[:-1]]
    right = anywhere[begin_a[1:]] - anywhere[np.maximum(begin_a[1:] - GAP - 1, begin_a[:-1])]
    ends = cuts[0] & (left > 0) | cuts[1] & (right > 0)
    single = np.bincount((kernels.distinct(tag_a) >> np.uint64(32)).astype(np.int64), minlength=n) == np.diff(begin_a)
    which = one & single & (common < least_common) & ~ends
    to = np.arange(len(a)) - begin_a[row] - shift[row]
    hit = which[row] & (to >= 0) & (to < np.diff(begin_b)[row])
    hit[hit] = a[hit] == b[(begin_b[row] + to)[hit]]
    return which, hit


def aligned(pairs: DataFrame, sequences: DataFrame, words: int, least: float, agree: int, whole: bool = False) -> DataFrame:
    """(kind, node, start, end, other, other_start, other_end, similarity, mask), in shingles, of ``candidates``.

    A second text's passages are merged within a batch, for it may be the first
    text of many keys.  Rows of kind OPEN have the place of a window of the first
    text as start, and its mask with all that the two share.  Unless ``whole``,
    pieces of the texts are aligned; pairs that share more than the pieces hold
    only get a row of kind CUT.
    """
    t = words - kernels.SHINGLE + 1
    width = 2 * t - 1
    names = ["kind", "node", "start", "end", "other", "other_start", "other_end", "similarity"]
    kinds = (pa.int8(), *[pa.int64()] * 6, pa.float64())

    def ends_there(x: np.ndarray, y: np.ndarray, shift: int, s: int, e: int) -> bool:
        """Does nothing go on at this shift past the bounds of a known passage?"""
        sides = ((max(0, s - GAP - 1), s), (e, min(len(x), e + GAP + 1)))
        return not any(u < v and len(_matches(x, y, shift, u, v, DRIFT)[0]) for u, v in sides)

    def shared(place: np.ndarray, other: np.ndarray, x: np.ndarray, y: np.ndarray, cut_left: bool, cut_right: bool) -> tuple[set[tuple], list[tuple]] | None:
        found: set[tuple] = set()
        runs: list[tuple] = []
        for region in regions(place, other):
            lo, hi = region[1].min(), region[2].max() + 1
            held = [(s, e) for s, e, hs, he, _ in found if s <= lo and hi <= e and hs <= lo - region[0] and hi - region[0] <= he]
            if any(ends_there(x, y, region[0], s, e) for s, e in held):
                continue  # nothing new, as in texts of one line again and again
            got = align(x, y, region, t, least, agree, cut_left, cut_right)
            if got is None:
                return None
            found.update(got[0])
            runs += got[1]
        return found, runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2000):
            if not batch.num_rows:
                continue
            rows: list[tuple] = []
            back: dict[int, list[tuple]] = {}
            lists = batch.column("seeds")
            ends = lists.offsets.to_numpy().astype(np.int64)
            seeds = lists.flatten()
            place, other = (seeds.field(x).to_numpy() for x in ("place", "other"))
            ends -= ends[0]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            node_a, node_b, from_a, from_b = (batch.column(x).to_numpy() for x in ("a", "b", "from_a", "from_b"))
            flat_a, flat_b = _shorts(batch.column("seq_a")), _shorts(batch.column("seq_b"))
            here, there = place - (from_a[owner] << 30), other - (from_b[owner] << 30)
            cuts = [np.array(batch.column(x).to_pylist(), bool) for x in ("cut_left", "cut_right")]
            far, hit = _far_apart((here >> 30) - (there >> 30), ends[:-1], flat_a, flat_b, cuts, least * t)
            far &= node_a != node_b
            stays = place & 15 != WHOLE  # windows that are to be redrawn
            for k in np.flatnonzero(~far).tolist():
                a, b, i, j = int(node_a[k]), int(node_b[k]), int(from_a[k]), int(from_b[k])
                at = slice(ends[k], ends[k + 1])
                begin = flat_a[1][k]
                x, y = flat_a[0][begin : flat_a[1][k + 1]], flat_b[0][flat_b[1][k] : flat_b[1][k + 1]]
                got = shared(here[at], there[at], x, y, bool(cuts[0][k]), bool(cuts[1][k]))
                if got is None:
                    rows.append((CUT, a, None, None, b, None, None, None))
                    stays[at] = False
                    continue
                found = {(s + i, e + i, hs + j, he + j, sim) for s, e, hs, he, sim in got[0]}
                if a == b:
                    rows += [(WITHIN, a, s, e, a, hs, he, sim) for s, e, hs, he, sim in found]
                else:
                    rows += [(FIRST, a, s, e, b, hs, he, sim) for s, e, hs, he, sim in found]
                    back.setdefault(b, []).extend((hs, he, a, s, e, sim) for s, e, hs, he, sim in found)
                for s, e in [*got[1], *((s, e) for s, e, *_ in got[0])]:
                    hit[begin + s : begin + e] = True
                c = here[at] >> 30
                lo, hi = c - (here[at] >> 17 & 0x1FFF), c + (here[at] >> 4 & 0x1FFF)
                for s, e, _, _, sim in got[0]:
                    if a != b or sim == 1:  # where a text has a stretch exactly again, others meet the first
                        stays[at] &= (lo < s) | (hi >= e)
            rows += [(SECOND, b, s, e, o, os, oe, sim) for b, spans in back.items() for s, e, o, os, oe, sim in merged(spans)]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*made, pa.nulls(len(rows), pa.binary())], names=[*names, "mask"])
            open_ = np.flatnonzero(stays)
            if not len(open_):
                continue
            held = seeds.field("mask").take(pa.array(open_))
            blank = bytes(-(-width // 8))
            before = np.frombuffer(b"".join(blank if m is None else m for m in held.to_pylist()), np.uint8).reshape(len(open_), -1)
            o = owner[open_]
            local = (here[open_] >> 30)[:, None] - (t - 1) + np.arange(width)
            size = np.diff(flat_a[1])[o][:, None]
            now = (local >= 0) & (local < size)
            now &= hit[np.clip(flat_a[1][o][:, None] + local, 0, max(0, len(hit) - 1))]
            n = len(open_)
            none = pa.nulls(n, pa.int64())
            columns = [pa.array(np.full(n, OPEN, np.int8)), pa.array(node_a[o]), pa.array(place[open_]), none, none, none, none, pa.nulls(n, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, _binary(before | np.packbits(now, axis=1))], names=[*names, "mask"])

    if whole:
        zero, no = F.lit(0).cast("long"), F.lit(False)
        joined = with_sequences(pairs, sequences).select("a", "b", "seeds", "seq_a", "seq_b", zero.alias("from_a"), zero.alias("from_b"), no.alias("cut_left"), no.alias("cut_right"))
    else:
        joined = _with_pieces(pairs, sequences)
    return joined.mapInArrow(run, "kind byte, node long, start long, end long, other long, other_start long, other_end long, similarity double, mask binary")


def _stretches(rows: DataFrame) -> DataFrame:
    """``merged`` over all rows of every node."""
    order = Window.partitionBy("node").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") < before, 0).otherwise(1)
    numbered = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("other", "other_start", "other_end", "similarity"), F.struct(F.col("other_end") - F.col("other_start"), "similarity", -F.col("other"), -F.col("other_start")))
    return numbered.groupBy("node", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("o")).select("node", "start", "end", "o.*")


def _named(pairs: DataFrame) -> DataFrame:
    """(node) of all texts in the pairs."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def passage_stretches(docs: DataFrame, words: int = WORDS, hashes: int = HASHES, agree: int = AGREE, least: float = LEAST, text: str = "text") -> DataFrame:
    """Stretches of distinct texts in verified passages: (node, start, end, other, other_start, other_end, similarity), in words.

    Each round holds every window against the first of its key, and then redraws
    those that aren't in a passage, until no two texts meet.
    """
    more = kernels.SHINGLE - 1
    found = stored(windows(docs, words, hashes, text), "windows")
    pairs = candidates(found, words)
    discard(found)
    sequences = stored(text_sequences(docs, words, text).join(_named(pairs), "node", "left_semi"), "sequences")
    release(docs.sparkSession)
    names = ("node", "start", "end", "other", "other_start", "other_end", "similarity")
    results = []
    while True:
        latest = [stored(aligned(pairs, sequences, words, least, agree), "aligned", 2000)]
        release(docs.sparkSession)
        cut = latest[0].where(F.col("kind") == CUT).select(F.col("node").alias("a"), F.col("other").alias("b"))
        if not cut.isEmpty():
            latest.append(stored(aligned(pairs.join(cut, ["a", "b"], "left_semi"), sequences, words, least, agree, whole=True), "aligned", 500))
        results += latest
        discard(pairs)
        windows_of = reduce(DataFrame.unionByName, latest).where(F.col("kind") == OPEN).select("node", F.struct(F.col("start").alias("place"), "mask").alias("w")).distinct()
        told = _stretches(reduce(DataFrame.unionByName, results).where(F.col("kind").isin(FIRST, SECOND)).select(*names))
        told = told.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("told"))
        held = windows_of.groupBy("node").agg(F.collect_list("w").alias("windows")).join(sequences, "node").join(told, "node", "left")
        found = stored(redrawn(held, words), "windows", 400)
        release(docs.sparkSession)
        pairs = candidates(found, words)
        discard(found)
        if pairs.isEmpty():
            break
        fewer = stored(sequences.join(_named(pairs), "node", "left_semi"), "sequences")
        discard(sequences)
        sequences = fewer
    rows = reduce(DataFrame.unionByName, results)
    stretches = _stretches(rows.where(F.col("kind").isin(FIRST, SECOND)).select(*names))
    # a passage that its text has again
    within = rows.where(F.col("kind") == WITHIN).select("node", F.col("start").alias("s"), F.col("other_start").alias("hs"), F.col("other_end").alias("he"), F.col("similarity").alias("alike"))
    lo, hi = F.greatest("start", "hs"), F.least("end", "he")
    again = within.join(stretches, "node").where(hi - lo >= words - more).withColumns({"lo": lo, "hi": hi})
    again = again.select("node", (F.col("s") + F.col("lo") - F.col("hs")).alias("start"), (F.col("s") + F.col("hi") - F.col("hs")).alias("end"), "other", F.least(F.col("other_start") + F.col("lo") - F.col("start"), F.col("other_end") - 1).alias("other_start"), F.least(F.col("other_start") + F.col("hi") - F.col("start"), F.col("other_end")).alias("other_end"), F.least("alike", "similarity").alias("similarity"))
    stretches = _stretches(stretches.unionByName(again))
    return stretches.select("node", "start", (F.col("end") + more).alias("end"), "other", "other_start", (F.col("other_end") + more).alias("other_end"), "similarity")


def repeated_passages(docs: DataFrame, words: int = WORDS, hashes: int = HASHES, agree: int = AGREE, least: float = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stretches of passages of at least ``words`` words that stand, nearly alike, in another text too.

    Columns: ``doc_id``, start_word, end_word (exclusive; words are runs of
    letters, digits and underscores), other_id (the smallest id of a text with
    the longest passage of the stretch), other_start, other_end and similarity of
    that passage.  Passages of a document that overlap are one stretch, so no
    word is in two rows.  Copies of a text of ``words`` words or more repeat as a
    whole: their other_id is the smallest id of the text, and for that itself the
    largest.  Null and short texts have no rows.
    """
    known = stored(document_nodes(docs, text, doc_id).where(F.col("words") >= words).withColumnRenamed(doc_id, "doc_id"), "document_nodes")
    nodes = stored(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("copies"), F.max("words").alias("words")), "nodes")
    found = passage_stretches(docs, words, hashes, agree, least, text)
    found = found.join(nodes.where("copies = 1").select("node"), "node", "left_semi")
    rows = found.join(nodes.select(F.col("node").alias("other"), F.col("rep").alias("other_id")), "other").select("node", "start", "end", "other_id", "other_start", "other_end", "similarity")
    near = known.select("doc_id", "node").join(rows, "node")
    whole = known.select("doc_id", "node").join(nodes.where("copies > 1"), "node")
    same = F.col("doc_id").eqNullSafe(F.col("rep"))
    zero = F.lit(0).cast("long")
    whole = whole.select("doc_id", "node", zero.alias("start"), F.col("words").alias("end"), F.when(same, F.col("last")).otherwise(F.col("rep")).alias("other_id"), zero.alias("other_start"), F.col("words").alias("other_end"), F.lit(1.0).alias("similarity"))
    return near.select(whole.columns).unionByName(whole).select(F.col("doc_id").alias(doc_id), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "other_id", "other_start", "other_end", "similarity")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that repeats across documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))
