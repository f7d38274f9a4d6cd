"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text within k edits, cut into the next larger even
number of pieces, has at least one piece that occurs there exactly.  An Aho-Corasick automaton over the
pieces of a block of items scans every document once; a hit is kept if its piece
and a neighbour together match with at most one edit, which holds for some pair
of every true match (k edits over more than k / 2 pairs of pieces); and what is left
is verified with Myers' bit-parallel distance over a window around the hit.

Items are sent to the executors in blocks of bounded bytes, one pass over the
documents for each block, so nothing that is broadcast grows with the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.common import sliced, table

#: Edits allowed for each character of an item.
RATE = 0.1
#: Normalised items shorter than this match only exactly and on word bounds, and no document is dropped for them.
LEAST_CHARS = 32
#: Characters of items sent to the executors at once.
BLOCK_CHARS = 4_000_000

_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, with single spaces for all that is neither letter nor digit."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float = RATE) -> int:
    """Edits allowed for an item: ``rate`` of its characters, and at least 1."""
    return max(1, int(rate * length))


def pieces(length: int, edits: int) -> list[tuple[int, int]]:
    """Bounds of pieces of nearly equal length: the least even number of them above ``edits``."""
    n = (edits | 1) + 1
    return [(length * j // n, length * (j + 1) // n) for j in range(n)]


def peq(pattern: str) -> dict[str, int]:
    """Bit masks of a pattern's characters, for ``myers``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, most: int, free: bool = True) -> tuple[int, int] | None:
    """(distance, end) of the best match of a pattern in ``text``, if its distance is at most ``most``.

    Myers' bit-vector algorithm on Python integers.  With ``free`` the match may
    begin anywhere, else only at the text's first character.  Of equal distances
    the earliest end wins.
    """
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (m, 0) if m <= most else None
    limit = most
    first = 0 if free else 1
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | first) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = (score, j)
    return best


def near(a: str, b: str) -> bool:
    """Does ``a`` match a prefix of ``b`` with at most one edit?  ``b`` should be one character longer, if it can."""
    n = len(a)
    if b.startswith(a):
        return True
    i = 0
    while i < n and i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 : n] or a[i:] == b[i + 1 : n + 1] or a[i + 1 :] == b[i : n - 1]


def _bound(text: str, at: int) -> bool:
    """May a word begin or end at ``at``?  Between characters of scripts without spaces (from U+2E80) any place will do."""
    return at in (0, len(text)) or any(c == " " or c >= "\u2e80" for c in text[at - 1 : at + 1])


class Matcher:
    """Finds a block of items, a list of (id, normalised text), in normalised texts."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE, least: int = 1) -> None:
        self.items = [(i, t, budget(len(t), rate) if len(t) >= LEAST_CHARS else 0) for i, t in items if len(t) >= least]
        self.rate = rate
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def _build(self) -> None:
        found: dict[str, list[tuple[int, int, int]]] = {}
        self._reverse = [t[::-1] for _, t, _ in self.items]
        self._masks: list = [None] * len(self.items)
        for n, (_, text, edits) in enumerate(self.items):
            if len(text) < LEAST_CHARS:
                found.setdefault(text, []).append((n, -1, 0))
                continue
            for j, (a, b) in enumerate(pieces(len(text), edits)):
                found.setdefault(text[a:b], []).append((n, j, a))
        self._automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self._automaton.add_word(piece, (len(piece), places))
        if found:
            self._automaton.make_automaton()
        self._cuts = [pieces(len(t), k) for _, t, k in self.items]

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(id, distance, start, end) of each item's best match; see ``matches``."""
        return [m[:4] for m in self.matches(text)]

    def matches(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(id, distance, start, end, item's length) of each item's best match in a normalised text.

        Of equal distances the one that ends first wins.  Bounds are in the
        normalised text.
        """
        if self._automaton is None:
            self._build()
        if not self.items or not text:
            return []
        windows: dict[int, dict[int, None]] = {}
        for last, (size, places) in self._automaton.iter(text):
            at = last + 1 - size
            for n, j, a in places:
                if self._pair(n, j, text, at, last + 1):
                    windows.setdefault(n, {})[at - a] = None
        out = []
        for n, starts in windows.items():
            name, item, edits = self.items[n]
            m, best, reach = len(item), None, None
            if self._masks[n] is None:
                self._masks[n] = peq(item), peq(self._reverse[n])
            for s in sorted(starts):
                if reach is not None and s <= reach[1]:
                    reach = (reach[0], s + edits)  # windows that overlap so much are one
                    continue
                if reach is not None:
                    best = self._better(best, n, text, reach[0], reach[1] + m + edits, edits)
                reach = (s - edits, s + edits)
            best = self._better(best, n, text, reach[0], reach[1] + m + edits, edits)
            if best:
                end = best[1]
                back = myers(self._masks[n][1], m, text[max(0, end - m - best[0]) : end][::-1], best[0], free=False)
                out.append((name, best[0], end - back[1] if back else max(0, end - m), end, m))
        return out

    def _better(self, best: tuple[int, int] | None, n: int, text: str, a: int, b: int, edits: int) -> tuple[int, int] | None:
        a = max(0, a)
        got = myers(self._masks[n][0], len(self.items[n][1]), text[a:b], edits)
        if got and (best is None or got[0] < best[0]):
            return got[0], a + got[1]
        return best

    def _pair(self, n: int, j: int, text: str, a: int, b: int) -> bool:
        """Does the other piece of piece j's pair match next to it with at most one edit?  A whole short item, j = -1, should stand on word bounds."""
        if j < 0:
            return _bound(text, a) and _bound(text, b)
        item, cuts = self.items[n][1], self._cuts[n]
        if j % 2 == 0:
            c, d = cuts[j + 1]
            return near(item[c:d], text[b : b + d - c + 1])
        c, d = cuts[j - 1]
        return near(item[c:d][::-1], text[max(0, a - (d - c) - 1) : a][::-1])


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS, least: int = 1) -> Iterator[Matcher]:
    """Matchers over the distinct items of ``least`` characters or more, in blocks of at most about ``block_chars`` characters."""
    block: list[tuple[object, str]] = []
    size = 0
    rows = items.where(F.col(text).isNotNull()).select(item_id, text).distinct().orderBy(item_id, text)
    for row in rows.toLocalIterator():
        block.append((row[0], normal(row[1])))
        size += len(block[-1][1])
        if size >= block_chars:
            yield Matcher(block, rate, least)
            block, size = [], 0
    if block:
        yield Matcher(block, rate, least)


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """Each (document, item) where the item occurs within its edit budget.

    Columns: ``doc_id``, ``item_id``, distance, start, end (code points of the
    normalised text), similarity (1 - distance / item's length).  One row, the
    best match, for each item text in each document row.  Null and empty texts
    match nothing; items of fewer than ``LEAST_CHARS`` characters match exactly,
    on word bounds, and end - start is their length.
    """
    rows = docs.select(doc_id, text)
    out = T.StructType(
        [
            rows.schema[doc_id],
            T.StructField(item_id, items.schema[item_id].dataType),
            *[T.StructField(c, T.LongType()) for c in ("distance", "start", "end")],
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    item_type = pa.string() if isinstance(items.schema[item_id].dataType, T.StringType) else pa.int64()
    if not isinstance(items.schema[item_id].dataType, T.StringType | T.LongType):
        items = items.withColumn(item_id, F.col(item_id).cast("long"))
        out = T.StructType([out[0], T.StructField(item_id, T.LongType()), *out.fields[2:]])

    def scan(matcher: Matcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                at, got = [], []
                for r, value in enumerate(batch.column(1)):
                    for hit in matcher.matches(normal(value.as_py())):
                        at.append(r)
                        got.append(hit)
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([g[0] for g in got], item_type)]
                columns += [pa.array([g[i] for g in got], pa.int64()) for i in (1, 2, 3)]
                columns.append(pa.array([1 - g[1] / g[4] for g in got], pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

        return run

    parts = [rows.mapInArrow(scan(m), out) for m in item_blocks(items, item_id, item_text, rate)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], out)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows in which no item of ``LEAST_CHARS`` characters or more occurs within its edit budget, with all their columns."""
    at = docs.columns.index(text)
    for matcher in item_blocks(items, rate=rate, least=LEAST_CHARS):

        def run(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                yield batch.filter(pa.array([not matcher.find(normal(v.as_py())) for v in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document, within a tenth of its characters in edits."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
