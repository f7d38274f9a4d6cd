"""Distinct texts as graph nodes: fingerprints, shingle sequences, components.

A node stands for all documents whose word sequence is the same; its number is
a 64-bit hash of that sequence.  Work on pairs is done between nodes, so copies
cost one row each and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import kernels
from helixlake.llm.common import sliced, stored


def fingerprints(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` rows, the hash of its token sequence (signed) and its number of tokens."""
    count = np.bincount(rows, minlength=n)
    out = np.zeros(n, np.uint64)
    if len(h):
        begin = np.concatenate([[0], np.cumsum(count)])
        place = np.arange(len(h)) - begin[rows]
        value = h * (kernels.mix(place.astype(np.uint64)) | np.uint64(1))
        has = np.flatnonzero(count)
        out[has] = kernels.mix(np.add.reduceat(value, begin[has]) ^ (count[has].astype(np.uint64) << np.uint64(32)))
    return out.view(np.int64), count


def document_nodes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(``doc_id``, node, words), one row for each row; node is null for a text without words."""
    rows = docs.select(doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            node, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, data, ends in kernels.chunks(batch.column(1)):
                h, _, _, r = kernels.tokenize(data, ends, words=True)
                f, c = fingerprints(h, r, len(ends) - 1)
                node.append(f)
                words.append(c)
            count = np.concatenate(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(node), mask=count == 0), pa.array(count)], names=[doc_id, "node", "words"])

    return rows.mapInArrow(run, T.StructType([rows.schema[doc_id], T.StructField("node", T.LongType()), T.StructField("words", T.LongType())]))


def node_sequences(docs: DataFrame, wanted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(node, seq) for the documents named in ``wanted`` (rep): 32-bit hashes of the shingles in text order, as bytes."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(wanted.select("rep"), F.col("_id").eqNullSafe(F.col("rep")), "left_semi").select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            node, seq = [], []
            for _, data, ends in kernels.chunks(batch.column(0)):
                h, _, _, r = kernels.tokenize(data, ends, words=True)
                f, count = fingerprints(h, r, len(ends) - 1)
                s, sr, _ = kernels.shingle(h, r)
                cut = np.searchsorted(sr, np.arange(len(ends)))
                s = (s >> np.uint64(32)).astype(np.uint32)
                for i in np.flatnonzero(count).tolist():
                    node.append(int(f[i]))
                    seq.append(s[cut[i] : cut[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(seq, pa.binary())], names=["node", "seq"])

    return rows.mapInArrow(run, "node long, seq binary").dropDuplicates(["node"])


def text_sequences(docs: DataFrame, least_words: int = 1, text: str = "text") -> DataFrame:
    """(node, seq) of all distinct texts of ``least_words`` words or more; see ``node_sequences``.  Copies in a batch are sent once."""
    rows = docs.select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for part in sliced([batch]):
                node, seq = [], []
                for _, data, ends in kernels.chunks(part.column(0)):
                    h, _, _, r = kernels.tokenize(data, ends, words=True)
                    f, count = fingerprints(h, r, len(ends) - 1)
                    s, sr, _ = kernels.shingle(h, r)
                    cut = np.searchsorted(sr, np.arange(len(ends)))
                    s = (s >> np.uint64(32)).astype(np.uint32)
                    for i in np.flatnonzero(count >= least_words).tolist():
                        if f[i] not in seen:
                            seen.add(int(f[i]))
                            node.append(int(f[i]))
                            seq.append(s[cut[i] : cut[i + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(seq, pa.binary())], names=["node", "seq"])

    return rows.mapInArrow(run, "node long, seq binary").groupBy("node").agg(F.first("seq").alias("seq"))


def with_sequences(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with seq_a and seq_b.  Many pairs may share a ``b``: a skewed join, which adaptive execution splits."""
    first = sequences.select(F.col("node").alias("a"), F.col("seq").alias("seq_a"))
    second = sequences.select(F.col("node").alias("b"), F.col("seq").alias("seq_b"))
    return pairs.join(first, "a").join(second, "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the undirected links (a, b): the component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014); every
    step is a few aggregations by key and its result is written to the shared
    folder.  Nodes without links are not in the result.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    told = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.where("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))")).first())
        if now == told:
            break
        told = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
