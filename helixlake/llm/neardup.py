"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its five-word shingles, weighted by how often they
occur.  Darts are thrown by hash into the region below each element's weight
(Christiani, 2020): a cell of weight and rank gets a Poisson number of darts that
depends on element and cell alone, so equal elements get equal darts in every
document.  Each of the signature's coordinates keeps its earliest dart.  The
number of darts depends on the signature, not on the document.

Signatures are joined by bands.  First each member is held against its bucket's most central one.  Buckets that
verified links then leave in several components are contested: their members
are dealt into finer buckets by pairs of bands, and held against a few seeded
members of other components in each.  Candidates whose signatures can't reach
the threshold are dropped, and the others are verified on their whole shingle
multisets.  In buckets that are contested even then, every pair of members of two
components is held against each other, block by block, so that texts which share
a bucket and are alike are always of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import kernels
from helixlake.llm.common import discard, release, settled, sliced, stored, table
from helixlake.llm.nodes import components, fingerprints, node_sequences, with_sequences

#: Bands, rows in a band, and the least similarity of a link.  At 0.8 a pair shares a band with probability 0.9999.
BANDS, ROWS, LEAST = 30, 6, 0.8
#: Contested buckets: band i goes with each of the next ``SPAN`` bands, and each such bucket has up to ``SEEDS`` members to be held against.
SPAN, SEEDS = 7, 4
#: How far below the threshold the signature's estimate of a pair may be: over three standard deviations.
SLACK = 0.1
#: Bytes of a bucket's members in a block.
BLOCK_BYTES = 500_000
#: Texts signed at once: each throws about 1300 darts.
SIGNED = 150
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, i + 1, dtype=float)) for i in range(12)])


def _cells(h: np.ndarray, w: np.ndarray, rows: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of weight below ``w`` and rank below their row's ``bound``: (row, hash, rank)."""
    out_row, out_hash, out_rank = [], [], []
    nu = 0
    while len(w) and (1 << nu) - 1 < w.max():
        W = float((1 << nu) - 1)
        at = np.flatnonzero(w > W)
        rho = 0
        while len(at) and (1 << rho) - 1 < bound[rows[at]].max():
            R = float((1 << rho) - 1)
            el = at[bound[rows[at]] > R]
            dw, dr = 2.0 ** (nu - rho), 2.0 ** (rho - nu)
            na = np.minimum(1 << rho, np.ceil((w[el] - W) / dw)).astype(np.int64)
            nb = np.minimum(1 << nu, np.ceil((bound[rows[el]] - R) / dr)).astype(np.int64)
            total = na * nb
            who = np.repeat(np.arange(len(el)), total)
            place = np.arange(len(who)) - np.repeat(np.cumsum(total) - total, total)
            a, b = place // nb[who], place % nb[who]
            salt = np.uint64(kernels.mix_int(1000 * nu + rho + 1))
            cell = kernels.mix(h[el][who] ^ salt ^ (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
            count = np.searchsorted(_POISSON, kernels.unit(cell), side="right")
            dart = np.repeat(np.arange(len(cell)), count)
            nth = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
            key = kernels.mix(cell[dart] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
            weight = W + (a[dart] + kernels.unit(kernels.mix(key ^ np.uint64(0x5851F42D4C957F2D)))) * dw
            rank = R + (b[dart] + kernels.unit(kernels.mix(key ^ np.uint64(0x14057B7EF767814F)))) * dr
            row = rows[el][who[dart]]
            keep = (weight < w[el][who[dart]]) & (rank < bound[row])
            out_row.append(row[keep])
            out_hash.append(key[keep])
            out_rank.append(rank[keep])
            rho += 1
        nu += 1
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(out_row, np.int64), join(out_hash, np.uint64), join(out_rank, np.float64)


def dart_minhash(h: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k) of n weighted sets given as (element hash, row, weight); a row without elements is all zeros.

    Two sets agree in a coordinate with probability sum(min) / sum(max) of their weights.
    """
    sig = np.zeros((n, k), np.uint64)
    total = np.bincount(rows, weights, minlength=n)
    todo = total > 0
    darts = k * np.log(k) + 2 * k
    scale = 1.0
    while todo.any():
        part = todo[rows]
        bound = np.where(todo, scale * darts / np.maximum(total, 1e-300), 0)
        row, key, rank = _cells(h[part], weights[part].astype(np.float64), rows[part], bound)
        slot = row * k + (kernels.mix(key ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        flat = sig.reshape(-1)
        filled = np.zeros(n * k, bool)
        flat[slot[order]] = key[order]  # of equal places the last, least rank stays
        filled[slot] = True
        todo = todo & ~filled.reshape(n, k).all(axis=1)
        scale *= 2
    return sig


def bands_of(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key (signed) for each band."""
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), kernels.mix_int(b + 1), np.uint64)
        for r in range(rows):
            key = kernels.mix(key ^ sig[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, node, bands, sketch), one row for each row; all but the id are null for a text without words.

    The sketch has a byte of each coordinate of the signature.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for first, data, ends in kernels.chunks(batch.column(1), most=SIGNED):
                n = len(ends) - 1
                h, _, _, r = kernels.tokenize(data, ends, words=True)
                node, count = fingerprints(h, r, n)
                _, only, back = np.unique(node, return_index=True, return_inverse=True)  # copies in a chunk are signed once
                keep = np.zeros(n, bool)
                keep[only] = True
                s, sr, _ = kernels.shingle(h, r)
                s, sr = s[keep[sr]], sr[keep[sr]]
                number = np.cumsum(keep) - 1
                place = np.zeros(len(only), np.int64)
                place[back[np.flatnonzero(keep)]] = np.arange(int(keep.sum()))
                e, er, w = kernels.counted(s, number[sr])
                sig = dart_minhash(e, er, w, int(keep.sum()), BANDS * ROWS)
                keys, low = bands_of(sig)[place[back]], (sig & np.uint64(255)).astype(np.uint8)[place[back]]
                sketch = pa.array([low[i].tobytes() if count[i] else None for i in range(n)], pa.binary())
                offsets = pa.array(np.arange(0, BANDS * n + 1, BANDS, dtype=np.int32))
                columns = [batch.column(0).slice(first, n), pa.array(node, mask=count == 0), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()), mask=pa.array(count == 0)), sketch]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "bands", "sketch"])

    fields = [T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields]))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) without regard to order."""
    return rows.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.first("a").alias("a"), F.first("b").alias("b")).select("a", "b")


def _crowded(keys: DataFrame) -> DataFrame:
    """(key, node, i, n) of the buckets of two nodes or more."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(keys.join(sizes, "key"), "members")


def _central_pairs(members: DataFrame) -> DataFrame:
    """Pairs of each bucket's members with its most central one: the node with the largest sum of sizes of its buckets."""
    central = members.groupBy("node").agg(F.sum("n").alias("c"))
    members = members.select("key", "node").join(central, "node")
    centres = members.groupBy("key").agg(F.max(F.struct("c", "node"))["node"].alias("b"))
    return _pairs(members.select("key", F.col("node").alias("a")).join(centres, "key").where("a <> b"))


def _contested_pairs(members: DataFrame, nodes: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs across components, from finer buckets of the nodes that share a bucket with another component."""
    placed = members.select("key", "node").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    contested = placed.join(split, "key", "left_semi").select("node", "component").distinct()
    both = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(SPAN)), lambda j: F.xxhash64(i, j, F.col("bands")[i], F.col("bands")[(i + j) % BANDS]))))
    fine = stored(contested.join(nodes.select("node", "bands"), "node").select("node", "component", F.explode(both).alias("key")), "fine")
    order = F.xxhash64("key", "node")
    seeds = fine.groupBy("key", F.pmod(order, F.lit(SEEDS)).alias("salt")).agg(F.min(F.struct(order, "node", "component")).alias("s"))
    seeds = seeds.select("key", F.col("s.node").alias("b"), F.col("s.component").alias("other"))
    return _pairs(fine.alias("f").join(seeds.alias("g"), (F.col("f.key") == F.col("g.key")) & (F.col("f.component") != F.col("g.other"))).select(F.col("f.node").alias("a"), "b"))


def _blocks(contested: DataFrame, size: Column) -> DataFrame:
    """(i, x, y, xs, ys): blocks of contested buckets' members that together hold every pair across components.

    Members of a bucket's largest component are never paired with each other, so
    their blocks meet only those of all other members.
    """
    held = contested.groupBy("key", "component").agg(F.sum(size).alias("size"))
    most = held.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("large"), F.sum("size").alias("all"))
    blocks = lambda bytes_: F.greatest(F.lit(1), F.ceil(bytes_ / BLOCK_BYTES)).cast("int")
    most = most.select("key", "main", blocks(F.col("large")).alias("many"), blocks(F.col("all") - F.col("large")).alias("few"))
    rows = contested.join(most, "key")
    main = F.col("component") == F.col("main")
    order = F.xxhash64("key", "node")
    own = F.when(main, F.col("few") + F.pmod(order, F.col("many"))).otherwise(F.pmod(order, F.col("few"))).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    rows = rows.select("key", "i", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", F.struct("node", "component", "bands", "sketch", "seq").alias("m"))
    return rows.groupBy("key", "i", "x", "y").agg(F.collect_list(F.when(F.col("own") == F.col("x"), F.col("m"))).alias("xs"), F.collect_list(F.when(F.col("own") != F.col("x"), F.col("m"))).alias("ys")).select("i", "x", "y", "xs", "ys")


def _across(contested: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs across components in ``contested`` (key, i, node, component, bands, sketch, seq).

    Where the members have no ``seq``, the similarity is null, and the pairs are
    each block's first likely ones of every node: they name what is to be verified.
    """
    need = BANDS * ROWS * (least - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            i, x, y, xs, ys = (column[0].as_py() for column in batch.columns)
            if x == y:
                ys = xs
            if not xs or not ys:
                continue
            found: list[tuple] = []
            sketch = np.frombuffer(b"".join(m["sketch"] for m in ys), np.uint8).reshape(len(ys), -1)
            component = np.array([m["component"] for m in ys], np.int64)
            bands = np.array([m["bands"] for m in ys], np.int64)
            root: dict[int, int] = {}
            named: set[int] = set()

            def find(c: int) -> int:
                while c in root:
                    c = root[c]
                return c

            for u, m in enumerate(xs):
                at = np.flatnonzero(component != m["component"])
                if x == y:
                    at = at[at > u]
                at = at[(sketch[at] == np.frombuffer(m["sketch"], np.uint8)).sum(axis=1) >= need]
                if len(at) and i:  # a pair is held against each other in the first of the buckets it shares
                    at = at[~(bands[at, :i] == np.array(m["bands"][:i], np.int64)).any(axis=1)]
                for v in at.tolist():
                    o = ys[v]
                    if m["seq"] is None or o["seq"] is None:
                        if not {m["node"], o["node"]} <= named:
                            named |= {m["node"], o["node"]}
                            found.append((m["node"], o["node"], None))
                        continue
                    c, d = find(m["component"]), find(o["component"])
                    if c != d:
                        alike = similarity(np.frombuffer(m["seq"], np.uint32), np.frombuffer(o["seq"], np.uint32))
                        if alike >= least:
                            root[c] = d
                            found.append((m["node"], o["node"], alike))
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=["a", "b", "similarity"])

    size = F.length("sketch") + 8 * BANDS + F.coalesce(F.length("seq"), F.lit(0))
    return _blocks(contested, size).mapInArrow(run, "a long, b long, similarity double")


def _remaining_links(docs: DataFrame, members: DataFrame, nodes: DataFrame, component: DataFrame, least: float, text: str, doc_id: str) -> DataFrame | None:
    """Links (a, b, similarity) across components that share a bucket, or None if there are no likely ones."""
    placed = members.select("key", "i", "node").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    contested = placed.join(split, "key", "left_semi").join(nodes.select("node", "bands", "sketch"), "node")
    pairs = stored(_across(contested.withColumn("seq", F.lit(None).cast("binary")), least), "likely")
    if pairs.isEmpty():
        return None
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    release(docs.sparkSession)
    sequences = stored(node_sequences(docs, named.join(nodes, "node").select("rep").distinct(), text, doc_id), "sequences")
    release(docs.sparkSession)
    return stored(_across(contested.join(sequences, "node"), least), "links")


def likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose sketches don't rule out a similarity of ``least``."""
    first = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    second = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    need = BANDS * ROWS * (least - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= need))

    return pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the counts of two arrays of shingle hashes."""
    both = np.concatenate([a, b])
    if not len(both):
        return 0.0
    value, place = np.unique(both, return_inverse=True)
    ca, cb = np.bincount(place[: len(a)], minlength=len(value)), np.bincount(place[len(a) :], minlength=len(value))
    return float(np.minimum(ca, cb).sum() / np.maximum(ca, cb).sum())


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pairs (a, b, similarity) of at least ``least``, by their whole texts."""
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    release(docs.sparkSession)  # here and below: what made the pairs goes before the texts are shuffled, and those before their sequences are
    sequences = stored(node_sequences(docs, named.join(nodes, "node").select("rep").distinct(), text, doc_id), "sequences")
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [similarity(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            s = pa.array(got, pa.float64())
            keep = pa.array([x >= least for x in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), s], names=["a", "b", "similarity"]).filter(keep)

    return with_sequences(pairs, sequences).select("a", "b", "seq_a", "seq_b").mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """Classes of near-duplicates: one row for each row of ``docs``.

    Columns: ``doc_id``, node, class_id (the smallest id of the class),
    class_size (its rows), links (verified links of this text to different
    texts) and keep (the row of class_id).  Texts with the same words are one node.  A text without words, or a null one, is a
    class of its own.  Rows with the same id and text are in the same class; a
    null id can be a class's id only if all its ids are null.
    """
    spark = docs.sparkSession
    signed = stored(signatures(docs, text, doc_id), "signed")
    told = signed.where("node is not null").groupBy("node")
    nodes = settled(spark, lambda: told.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    members = _crowded(nodes.select("node", F.posexplode("bands").alias("i", "band")).select("node", "i", F.xxhash64("i", "band").alias("key")))
    release(spark)

    def grouped() -> DataFrame:
        return stored(components(links), "components")

    def verified_of(pairs: DataFrame) -> DataFrame:
        return verified(docs, nodes, stored(likely(pairs, nodes, least), "pairs"), least, text, doc_id)

    links = settled(spark, lambda: verified_of(_central_pairs(members)), "links")
    component = grouped()
    links = links.unionByName(settled(spark, lambda: verified_of(_contested_pairs(members, nodes, component)), "links"))
    component = grouped()
    rest = _remaining_links(docs, members, nodes, component, least, text, doc_id)
    discard(members)
    if rest is not None:
        links = links.unionByName(rest.groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
        component = grouped()
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    joined = nodes.select("node", "rep", "copies").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = joined.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.min_by("node", F.struct(F.col("rep").isNull(), "rep", "node")).alias("kept"))
    facts = joined.join(classes, "component").join(degree, "node", "left").select("node", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"), (F.col("node") == F.col("kept")).alias("keep"))
    out = signed.select("doc_id", "node").join(facts, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        F.col("doc_id").alias(doc_id),
        "node",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        (alone | (F.col("keep") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("keep"),
    )


def _with_node(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the column __node."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            node, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, data, ends in kernels.chunks(batch.column(at)):
                h, _, _, r = kernels.tokenize(data, ends, words=True)
                f, c = fingerprints(h, r, len(ends) - 1)
                node.append(f)
                words.append(c)
            found = pa.array(np.concatenate(node), mask=np.concatenate(words) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "__node"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__node", T.LongType())]))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row of each class, that of the smallest id, with all its columns; repeated rows of an id and text count as one, and every row without words stays."""
    # a struct, whose nulls are equal: texts are dealt out by it once, for the join and for what repeats
    key = F.struct(F.col(doc_id).alias("id"), F.col("node").alias("node"))
    stay = settled(docs.sparkSession, lambda: near_duplicates(docs, text, doc_id, least).where("keep").select(key.alias("__key")), "stay")
    rows = _with_node(docs, text).withColumn("__key", F.struct(F.col(doc_id).alias("id"), F.col("__node").alias("node")))
    rows = rows.join(stay, "__key", "left_semi")
    rows = rows.withColumn("__alone", F.when(F.col("__node").isNull(), F.monotonically_increasing_id()))
    return rows.dropDuplicates(["__key", "__alone"]).select(docs.columns)


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: doc_id, class_id, class_size, links, keep."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("node")
