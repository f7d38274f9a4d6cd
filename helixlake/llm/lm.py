"""Language-model scores by Brown's class-based bigrams.

The probability of a word is that of its class after the class before, times
that of the word within its class.  Exchange clustering finds the classes:
words move, one after another, to the class that raises the likelihood of the
class bigrams most, until few move.

What is clustered first are units: the most frequent words, each its own unit,
and groups of all other words by their endings, so that every word, seen or not,
has a class.  Then the other words whose counts are held, seen ``LEAST_TOKENS``
times or more, leave their endings: each moves, as in a round of exchange, to the
class that suits the classes around it best.  All training text is counted.

* Word counts come from one pass and one shuffle of each task's distinct words.
* Bigrams of units come from a second pass; tasks send sorted arrays of pair
  codes, which are merged by ranges of units and stay on the cluster.  A round of
  exchange is one scan of them, and only sums by unit and class reach the driver.
* Contexts of the other words come from a third pass, as sorted arrays of word and
  class around it, merged by ranges of words; words move on the cluster, and a
  class a word reaches the driver.  A fourth pass counts the bigrams of classes.
* Scoring is the last pass.  Counts of frequent words are broadcast, as many as
  ``most_words``; occurrences of the others meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import kernels
from helixlake.llm.common import batches_of, crc_bucket, sliced, stored, table

#: Units (a power of two), those of them that stand for endings, and classes.
UNIT_BITS = 14
ENDINGS = 4096
CLASSES = 64
#: Units in a slice of the bigram table (a power of two), and tasks of the counting pass whose results of a slice are merged at once.
SLICE_BITS = 6
MERGED = 64
#: Words whose counts and classes are broadcast, 22 bytes each, and the occurrences that a word needs for a class of its own.
MOST_WORDS = 1_000_000
LEAST_TOKENS = 4
#: Rows of texts in a batch: Spark and the worker hold a batch of each task besides what is counted.
TEXTS = 1000
#: Rounds of exchange at most, and the share of units that must move for another.
ROUNDS, STILL = 8, 0.01
#: Share of the class model in the mixture with the unigram.
CLASS_SHARE = 0.9
#: The number of the token that ends every text, and its unit and class.
END = 0x7FFFFFFFFFFFFFFF
END_UNIT = END_CLASS = 0


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, word numbers, endings, row of each) for chunks of a column; end tokens are left out.

    A word is a run of anything but space and tab to carriage return, A-Z
    lowered.  Its ending is a hash of its last three bytes and whether it is longer.
    """
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    for first, data, ends in kernels.chunks(column):
        h, start, stop, rows = kernels.tokenize(data, ends)
        size = stop - start
        code = np.minimum(size, 4).astype(np.uint64)
        for k in (1, 2, 3):
            code = code << np.uint64(8) | np.where(size >= k, lower[data[np.maximum(stop - k, 0)]], np.uint64(0))
        word = h.view(np.int64)
        word = np.where(word == END, word - 1, word)
        yield first, len(ends) - 1, word, (kernels.mix(code) % np.uint64(ENDINGS)).astype(np.int16), rows


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of (codes, counts) in order, and the sums of their counts.  ``parts`` is emptied, so that little is held twice."""
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    if not len(code):
        return code, n
    order = np.argsort(code)
    code = code[order]
    n = n[order]
    del order
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.add.reduceat(n, first)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, ending, n) over all texts; the end token has ending -1 and a row if there is any text."""
    rows = docs.select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = texts = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word, ending, n = (np.concatenate(x) for x in zip(*held, strict=True))
            value, at, place = np.unique(word, return_index=True, return_inverse=True)
            return value, ending[at], np.bincount(place, n).astype(np.int64)

        def batch_of(word: np.ndarray, ending: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(ending), pa.array(n)], names=["word", "ending", "n"])

        for batch in sliced(batches):
            texts += batch.num_rows
            for _, _, word, ending, _ in tokens(batch.column(0)):
                value, at, n = np.unique(word, return_index=True, return_counts=True)
                held.append((value, ending[at], n))
                size += len(value)
                if size > 4_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*merged())
        if texts:
            yield batch_of(np.array([END]), np.array([-1], np.int16), np.array([texts]))

    return rows.mapInArrow(run, "word long, ending short, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Lookup:
    """Frequent words in order, with their counts, endings, and their units or -1."""

    words: np.ndarray
    counts: np.ndarray
    endings: np.ndarray
    units: np.ndarray

    def find(self, word: np.ndarray, ending: np.ndarray, classes: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of tokens, their counts and their places among the held words, -1 for words that aren't held.

        With ``classes`` of units, classes instead of units; ``own`` has those of held words that left their endings, or -1.
        """
        value, at, place = np.unique(word, return_index=True, return_inverse=True)
        unit = 1 + ending[at].astype(np.int64)
        count = np.full(len(value), -1, np.int64)
        index = np.full(len(value), -1, np.int64)
        if len(self.words):
            k = np.minimum(np.searchsorted(self.words, value), len(self.words) - 1)
            hit = self.words[k] == value
            count[hit] = self.counts[k[hit]]
            index[hit] = k[hit]
            known = hit & (self.units[k] >= 0)
            unit[known] = self.units[k[known]]
        if classes is not None:
            unit = classes[unit].astype(np.int64)
            if own is not None and len(own):
                left = np.where(index >= 0, own[index], -1)
                unit = np.where(left >= 0, left, unit)
        return unit[place], count[place], index[place]

    @property
    def arrays(self) -> tuple[np.ndarray, ...]:
        """What ``Lookup(*arrays)`` makes again in any worker."""
        return self.words, self.counts, self.endings, self.units


def lookup(counts: DataFrame, most_words: int) -> tuple[Lookup, int]:
    """The words of the highest counts, at most ``most_words`` of them and the end token, and the least count that they all reach.

    Units: 0 is the end token, then the endings, then the most frequent words.
    """
    by_count = sorted(((r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).toLocalIterator()), reverse=True)
    least, total = None, 0
    for n, k in by_count:
        if total + k > most_words:
            break
        least, total = n, total + k
    if least is None:
        least = by_count[0][0] + 1 if by_count else 1
    rows = counts.where((F.col("n") >= least) | (F.col("word") == END)).select("word", "ending", "n").toArrow()
    order = np.argsort(rows["word"].to_numpy())
    word, ending, n = (rows[x].to_numpy()[order] for x in ("word", "ending", "n"))
    units = np.full(len(word), -1, np.int32)
    room = (1 << UNIT_BITS) - 1 - ENDINGS
    top = np.lexsort((word, -n))
    top = top[word[top] != END][:room]
    units[top] = 1 + ENDINGS + np.arange(len(top))
    units[word == END] = END_UNIT
    return Lookup(word, n, ending, units), int(least)


def unit_bigrams(docs: DataFrame, held: Lookup, text: str = "text") -> DataFrame:
    """Bigram counts of units by slices: (slice, side, codes, counts).

    A code is a unit, shifted, and its neighbour: the next unit (side 0) or the
    one before (side 1); texts begin after an end token.  The arrays are sorted
    uint32 codes and uint64 counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(held.arrays)  # arrays, which any worker can unpickle
    rows = docs.select(text)
    salts = -(-rows.rdd.getNumPartitions() // MERGED)
    shape = "slice int, side byte, codes binary, counts binary, salt int"
    names = ["slice", "side", "codes", "counts", "salt"]

    def cut(side: int, code: np.ndarray, n: np.ndarray) -> list[tuple]:
        part = code >> (UNIT_BITS + SLICE_BITS)
        at = np.flatnonzero(np.diff(part, prepend=-1))
        return [(int(part[a]), side, code[a:b].astype(np.uint32).tobytes(), n[a:b].astype(np.uint64).tobytes()) for a, b in zip(at, np.append(at[1:], len(code)), strict=True)]

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        salt = TaskContext.get().partitionId() % salts
        kinds = (pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([(*m, salt)[i] for m in made], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(*shared.value)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            code, n = summed(pairs)
            yield batch_of(cut(0, code, n))
            other = (code & ((1 << UNIT_BITS) - 1)) << UNIT_BITS | code >> UNIT_BITS
            order = np.argsort(other)
            yield batch_of(cut(1, other[order], n[order]))

        for batch in sliced(batches):
            for _, n, word, ending, row in tokens(batch.column(0)):
                unit, _, _ = known.find(word, ending)
                before, after = neighbours(unit, row, n)
                pairs.append(np.unique(before << UNIT_BITS | after, return_counts=True))
                size += len(pairs[-1][0])
                if size > 6_000_000:
                    pairs = [summed(pairs)]
                    size = len(pairs[0][0])
                    if size > 4_000_000:
                        yield from sent()
                        pairs, size = [], 0
        if pairs:
            yield from sent()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0

        for batch in sliced(batches):
            for part, side, codes, counts, salt in zip(*(batch.column(i) for i in range(5)), strict=True):
                key = part.as_py(), side.as_py(), salt.as_py()
                if key != now:
                    if parts:
                        code, n = summed(parts)
                        yield batch_of([(*now[:2], code.tobytes(), n.tobytes())])
                    now, parts, size = key, [], 0
                parts.append((np.frombuffer(codes.as_py(), np.uint32), np.frombuffer(counts.as_py(), np.uint64)))
                size += len(parts[-1][0])
                if size > 8_000_000:
                    parts = [summed(parts)]
                    size = len(parts[0][0])
        if parts:
            code, n = summed(parts)
            yield batch_of([(*now[:2], code.tobytes(), n.tobytes())])

    slices = min(1 << (UNIT_BITS - SLICE_BITS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = rows.mapInArrow(run, shape)
    if salts > 1:  # a slice's distinct pairs are bounded, so what is left after merging by salts is small
        sent = sent.repartition(slices * salts, "slice", "salt").sortWithinPartitions("slice", "side", "salt").mapInArrow(join, shape)
    sent = sent.withColumn("salt", F.lit(0)).repartition(slices, "slice").sortWithinPartitions("slice", "side")
    return sent.mapInArrow(join, shape).drop("salt")


def neighbours(unit: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (before, after) of units of ``n`` texts, each with an end unit before its first word and after its last.

    The last pair of each text comes after all others, in order of rows.
    """
    before = np.empty(len(unit), np.int64)
    before[1:] = unit[:-1]
    first = np.ones(len(unit), bool)
    first[1:] = row[1:] != row[:-1]
    before[first] = END_UNIT
    last = np.full(n, END_UNIT, np.int64)
    final = np.ones(len(unit), bool)
    final[:-1] = row[1:] != row[:-1]
    last[row[final]] = unit[final]
    return np.concatenate([before, last]), np.concatenate([unit, np.full(n, END_UNIT, np.int64)])


def class_sums(bigrams: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(after, before): for each unit, counts of the classes next to it, units by classes."""
    per = 1 << SLICE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = []
            for part, side, codes, counts in zip(*(batch.column(i) for i in range(4)), strict=True):
                code, n = np.frombuffer(codes.as_py(), np.uint32).astype(np.int64), np.frombuffer(counts.as_py(), np.uint64)
                place = (code >> UNIT_BITS & (per - 1)) * n_classes + classes[code & ((1 << UNIT_BITS) - 1)]
                got.append((part.as_py(), side.as_py(), np.bincount(place, n.astype(np.float64), minlength=per * n_classes).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate((pa.int32(), pa.int8(), pa.binary()))], names=["slice", "side", "sums"])

    sums = np.zeros((2, 1 << UNIT_BITS, n_classes))
    for r in bigrams.mapInArrow(run, "slice int, side byte, sums binary").toLocalIterator():
        sums[r["side"], r["slice"] * per : (r["slice"] + 1) * per] += np.frombuffer(r["sums"]).reshape(per, n_classes)
    return sums[0], sums[1]


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(matrix: np.ndarray) -> float:
    """Log likelihood of the class bigrams, up to what no assignment changes."""
    return float(_f(matrix).sum() - _f(matrix.sum(axis=0)).sum() - _f(matrix.sum(axis=1)).sum())


def exchange(after: np.ndarray, before: np.ndarray, classes: np.ndarray) -> int:
    """One round: each unit in turn, the most frequent first, moves to the class of the highest likelihood.

    ``classes`` is changed; the number of moves is returned.  The end token keeps
    its class to itself.  Sums by unit are those from the round's beginning,
    while the class matrix follows every move.
    """
    n_classes = after.shape[1]
    matrix = np.zeros((n_classes, n_classes))
    np.add.at(matrix, classes, after)
    total = after.sum(axis=1)
    moved = 0
    for u in np.argsort(-total, kind="stable").tolist():
        if u == END_UNIT or not total[u]:
            continue
        k, a, b = classes[u], after[u], before[u]
        matrix[k] -= a
        matrix[:, k] -= b
        np.maximum(matrix, 0, out=matrix)
        ta, tb = a.sum(), b.sum()
        rows, columns = np.flatnonzero(a), np.flatnonzero(b)
        x, y = matrix[:, rows], matrix[columns]
        gain = (_f(x + a[rows]) - _f(x)).sum(axis=1) + (_f(y + b[columns, None]) - _f(y)).sum(axis=0)
        out, into = matrix.sum(axis=1), matrix.sum(axis=0)
        gain -= _f(out + ta) - _f(out) + _f(into + tb) - _f(into)
        gain[END_CLASS] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= gain[k] + 1e-9:
            j = k
        matrix[j] += a
        matrix[:, j] += b
        moved += j != k
        classes[u] = j
    return moved


def cluster(bigrams: DataFrame, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units, and the matrix of class bigram counts."""
    n = 1 << UNIT_BITS
    classes = 1 + np.arange(n) % (n_classes - 1)
    classes[END_UNIT] = END_CLASS
    after, before = class_sums(bigrams, classes, n_classes)
    order = np.argsort(-after.sum(axis=1), kind="stable")
    order = order[order != END_UNIT]
    classes[order] = 1 + np.arange(len(order)) % (n_classes - 1)
    for _ in range(rounds):
        after, before = class_sums(bigrams, classes, n_classes)
        moved = exchange(after, before, classes)
        if moved <= STILL * max(1, (after.sum(axis=1) > 0).sum()):
            break
    after, _ = class_sums(bigrams, classes, n_classes)
    matrix = np.zeros((n_classes, n_classes))
    np.add.at(matrix, classes, after)
    return classes, matrix


def best_classes(matrix: np.ndarray, word: np.ndarray, side: np.ndarray, near: np.ndarray, n: np.ndarray, now: np.ndarray) -> np.ndarray:
    """The likeliest class for each of the words 0, 1, ... whose present classes are ``now``.

    ``word`` is sorted; it was seen ``n`` times after (side 0) or before (side 1) a
    token of class ``near``.  Words move at once, so each one's gain is that of the
    likelihood to first order, at the matrix without its own counts, smoothed by a
    half: a small class, which any one word could have for itself, draws no crowd.
    """
    n_classes = len(matrix)
    gain = np.zeros((len(now), n_classes))
    n = n.astype(float)
    step = 50_000
    for k, cells in enumerate((matrix, matrix.T)):  # by the class near it, then by the word's
        which = np.flatnonzero(side == k)
        sums, logs = cells.sum(axis=0), np.log(cells + 0.5)
        for at in range(0, len(which), step):
            e = which[at : at + step]
            added = logs[near[e]]
            row, here = np.arange(len(e)), now[word[e]]
            added[row, here] = np.log(np.maximum(cells[near[e], here] - n[e], 0) + 0.5)
            first = np.flatnonzero(np.diff(word[e], prepend=-1))
            gain[word[e][first]] += np.add.reduceat(added * n[e, None], first, axis=0)
        total = np.bincount(word[which], n[which], minlength=len(now))
        lost = total[:, None] * np.log(sums + 0.5 * n_classes)
        row = np.arange(len(now))
        lost[row, now] = total * np.log(np.maximum(sums[now] - total, 0) + 0.5 * n_classes)
        gain -= lost
    gain[:, END_CLASS] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain[row, best] > gain[row, now] + 1e-9, best, now)


def word_classes(docs: DataFrame, held: Lookup, classes: np.ndarray, matrix: np.ndarray, text: str = "text") -> np.ndarray:
    """For each held word the class that it moves to from its ending's, -1 for units and for words seen fewer than ``LEAST_TOKENS`` times.

    Tasks send sorted arrays of (word, side, class near it) and counts by ranges of
    words; a range's distinct ones are bounded by its words and the classes.
    """
    n_classes = len(matrix)
    spark = docs.sparkSession
    free = (held.units < 0) & (held.counts >= LEAST_TOKENS)
    own = np.full(len(held.words), -1, np.int16)
    if not free.any():
        return own
    shared = spark.sparkContext.broadcast((held.arrays, classes, free, matrix))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = -(-len(held.words) // slices)
    shape, names = "slice int, codes binary, counts binary", ["slice", "codes", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, unit_class, may, _ = shared.value
        known = Lookup(*arrays)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            code, n = summed(parts)
            part = code // (per * 2 * n_classes)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(at[1:], len(code))
            columns = [pa.array(part[at].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()) for x in (code, n.astype(np.uint32)))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in sliced(batches):
            for _, n, word, ending, row in tokens(batch.column(0)):
                kind, _, index = known.find(word, ending, unit_class)
                before, after = neighbours(kind, row, n)
                place = np.concatenate([index, np.full(n, -1)])  # of the pair's second
                previous = np.full(len(place), -1)  # of its first
                previous[1 : len(index)] = index[:-1]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                previous[first] = -1
                last = np.flatnonzero(np.diff(row, append=n))
                previous[len(index) + row[last]] = index[last]
                for side, who, near in ((0, place, before), (1, previous, after)):
                    at = np.flatnonzero(who >= 0)
                    at = at[may[who[at]]]
                    parts.append(np.unique((who[at] * 2 + side) * n_classes + near[at], return_counts=True))
                    size += len(parts[-1][0])
                if size > 4_000_000:
                    parts = [summed(parts)]
                    size = len(parts[0][0])
                    if size > 2_000_000:
                        yield sent()
                        parts, size = [], 0
        if size:
            yield sent()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, unit_class, _, cells = shared.value
        now, parts, size = None, [], 0

        def moved() -> pa.RecordBatch:
            code, n = summed(parts)
            index, word = np.unique(code // (2 * n_classes), return_inverse=True)
            at = unit_class[1 + arrays[2][index].astype(np.int64)].astype(np.int64)
            got = best_classes(cells, word, code // n_classes % 2, code % n_classes, n, at)
            return pa.RecordBatch.from_arrays([pa.array(index.astype(np.int64)), pa.array(got.astype(np.int16))], names=["index", "class"])

        for batch in sliced(batches, 64):
            for part, code, n in zip(*(batch.column(i) for i in range(3)), strict=True):
                if part.as_py() != now:
                    if parts:
                        yield moved()
                    now, parts, size = part.as_py(), [], 0
                parts.append((np.frombuffer(code.as_py(), np.int64), np.frombuffer(n.as_py(), np.uint32).astype(np.int64)))
                size += len(parts[-1][0])
                if size > 4_000_000:
                    parts = [summed(parts)]
                    size = len(parts[0][0])
        if parts:
            yield moved()

    with batches_of(spark, TEXTS):
        found = docs.select(text).mapInArrow(run, shape).repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(move, "index long, class short").toArrow()
    shared.unpersist()
    own[found["index"].to_numpy()] = found["class"].to_numpy()
    return own


def class_bigrams(docs: DataFrame, held: Lookup, classes: np.ndarray, own: np.ndarray, n_classes: int, text: str = "text") -> np.ndarray:
    """The matrix of class bigram counts of all texts."""
    shared = docs.sparkSession.sparkContext.broadcast((held.arrays, classes, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, unit_class, word_class = shared.value
        known = Lookup(*arrays)
        sums = np.zeros(n_classes * n_classes, np.int64)
        for batch in sliced(batches):
            for _, n, word, ending, row in tokens(batch.column(0)):
                before, after = neighbours(known.find(word, ending, unit_class, word_class)[0], row, n)
                sums += np.bincount(before * n_classes + after, minlength=len(sums))
        pair = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(sums[pair])], names=["pair", "n"])

    with batches_of(docs.sparkSession, TEXTS):
        found = docs.select(text).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    matrix = np.zeros(n_classes * n_classes)
    matrix[found["pair"].to_numpy()] = found["n"].to_numpy()
    return matrix.reshape(n_classes, n_classes)


@dataclass
class Model:
    """What scoring needs: ``own`` has the classes of held words that left their endings; ``joint`` is log10 of all of a token's probability but its count and a half."""

    held: Lookup
    least: int
    classes: np.ndarray
    own: np.ndarray
    joint: np.ndarray
    train_tokens: int
    distinct: int


def learn(docs: DataFrame, train: Column, text: str = "text", most_words: int = MOST_WORDS) -> tuple[Model, DataFrame]:
    """The model of the texts where ``train`` holds, and the table of all word counts.

    A word w after class a: (1 - s) (n_w + 1/2) / (N + (V + 1) / 2) + s P(c|a) (n_w + 1/2) / (N_c + (V_c + 1) / 2),
    c its class, P(c|a) smoothed by a half; s is ``CLASS_SHARE``.
    """
    chosen = docs.where(train)
    counts = stored(word_counts(chosen, text), "word_counts", TEXTS)
    held, least = lookup(counts, most_words)
    classes, matrix = cluster(stored(unit_bigrams(chosen, held, text), "bigrams", TEXTS))
    n_classes = len(matrix)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    own = word_classes(chosen, held, classes, matrix, text)
    if (own >= 0).any():
        moved = class_bigrams(chosen, held, classes, own, n_classes, text)
        if likelihood(moved) > likelihood(matrix):
            matrix = moved
        else:  # words moved at once, each as if alone
            own[:] = -1
    # words of a class: those that have one to themselves from the lookup, all others by their ending
    single = (held.units >= 0) | (own >= 0)
    kind = np.where(own >= 0, own, classes[held.units])[single]
    words = np.bincount(kind, minlength=n_classes).astype(float)
    mass = np.bincount(kind, held.counts[single], minlength=n_classes)
    endings = np.zeros((2, ENDINGS))
    for r in counts.where("ending >= 0").groupBy("ending").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).toLocalIterator():
        endings[:, r["ending"]] = r["v"], r["n"]
    gone = single & (held.endings >= 0)
    np.subtract.at(endings[0], held.endings[gone], 1)
    np.subtract.at(endings[1], held.endings[gone], held.counts[gone])
    np.add.at(words, classes[1 : 1 + ENDINGS], endings[0])
    np.add.at(mass, classes[1 : 1 + ENDINGS], endings[1])
    follow = (matrix + 0.5) / (matrix.sum(axis=1, keepdims=True) + 0.5 * n_classes)
    joint = np.log10((1 - CLASS_SHARE) / (total[0] + 0.5 * (total[1] + 1)) + CLASS_SHARE * follow / (mass + 0.5 * (words + 1)))
    return Model(held, least, classes, own, joint, int(total[0]), int(total[1])), counts


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), one row for each row; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.held.arrays, model.classes, model.own, model.joint))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text)
    whole = model.least <= 1  # every word of the training texts is held
    base = float(np.log10(model.train_tokens + 0.5 * (model.distinct + 1)))
    names = ["doc_id", "rid", "n_tokens", "known", "counted", "chained", "rest", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, classes, own, joint = shared.value
        held = Lookup(*arrays)
        end = np.flatnonzero(held.words == END)
        end_count = int(held.counts[end[0]]) if len(end) else 0
        rid = TaskContext.get().partitionId() << 33
        for batch in sliced(batches):
            for first, n, word, ending, row in tokens(batch.column(1)):
                kind, count, _ = held.find(word, ending, classes, own)
                before, after = neighbours(kind, row, n)
                pair = joint[before, after]
                chained = np.bincount(np.concatenate([row, np.arange(n)]), pair, minlength=n)
                if whole:
                    count = np.maximum(count, 0)
                seen = count >= 0
                counted = np.bincount(row[seen], np.log10(count[seen] + 0.5), minlength=n) + np.log10(end_count + 0.5)
                known = np.bincount(row[seen], count[seen] > 0, minlength=n).astype(np.int64) + (end_count > 0)
                w, r = word[~seen], row[~seen]
                order = np.lexsort((w, r))
                w, r = w[order], r[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(w)))
                offsets = pa.array(np.searchsorted(r[at], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (w[at], times.astype(np.int64))]
                columns = [batch.column(0).slice(first, n), pa.array(rid + np.arange(n)), pa.array(np.bincount(row, minlength=n) + 1), pa.array(known), pa.array(counted), pa.array(chained), *lists]
                rid += n
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, rid long, n_tokens long, known long, counted double, chained double, rest array<long>, times array<long>")
    if whole:
        done = out.select("doc_id", "n_tokens", F.col("known").alias("n_known"), "counted", "chained")
    else:
        out = stored(out, "scores", TEXTS)  # rid is what was written, whatever task wrote it
        rest = out.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("t")).select("rid", F.col("t.rest").alias("word"), F.col("t.times").alias("times"))
        rare = counts.where(F.col("n") < model.least).select("word", "n")
        n = F.coalesce("n", F.lit(0))
        sums = rest.join(rare, "word", "left").groupBy("rid").agg(F.sum(F.col("times") * F.log10(n + 0.5)).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("found"))
        joined = out.drop("rest", "times").join(sums, "rid", "left")
        done = joined.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), (F.col("counted") + F.coalesce("more", F.lit(0.0))).alias("counted"), "chained")
    return done.select(F.col("doc_id").alias(doc_id), "n_tokens", "n_known", (F.col("counted") - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("counted") + F.col("chained")).alias("score"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole document under the unigram base and the class model."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 5) == 1
    model, counts = learn(docs, ~held_out)
    scored = score_texts(docs, model, counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
