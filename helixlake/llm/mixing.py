"""Mixing sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong
to.  Token capacity flows from patterns to source quotas; each further
repetition of a pattern's documents costs more than the one before, so the cost
is convex and the flow repeats as little as it can.  The flow network has one
node for each pattern and source and is solved on the driver; the documents
themselves never leave the cluster.  Each pattern's documents are then taken in
a seeded order up to what the flow routed through it.  The document at the end
of a routed range is taken in part, so quotas are met to the word.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.llm.common import WORD, stored, table

#: The query's weights by rank of the source, its budget and its repetition limit.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = "mix:"
#: Hex digits of the order hash that form the buckets of the prefix sums.
BUCKET_DIGITS = 3


def targets(sizes: list[int], weights: list[int], budget: float, limit: float) -> list[float]:
    """Shares of ``budget`` by weight, none above ``limit`` times its size; excess goes to the others by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (limit * sizes[i] / weights[i], i))
    out = [0.0] * len(sizes)
    used, weight = 0.0, sum(weights)
    for at, i in enumerate(order):
        if limit * sizes[i] <= weights[i] * ((budget - used) / weight):
            out[i] = float(limit * sizes[i])
            used += limit * sizes[i]
            weight -= weights[i]
        else:
            for j in order[at:]:
                out[j] = weights[j] * ((budget - used) / weight)
            break
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(capacity: dict[str, int], members: dict[str, list[str]], quota: dict[str, int], repeats: int) -> dict[tuple[str, int, str], int]:
    """Tokens by (pattern, repetition from 0, source) of least cost among the flows of most tokens.

    Repetition r of a pattern has the pattern's capacity and costs r a token.
    Successive cheapest paths with potentials; arcs number a pattern's
    repetitions and memberships, not documents.
    """
    patterns, sources = sorted(capacity), sorted(quota)
    node = {("p", p): 1 + i for i, p in enumerate(patterns)} | {("s", s): 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(node)
    graph: list[list[_Arc]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        graph[a].append(_Arc(b, room, cost, len(graph[b])))
        graph[b].append(_Arc(a, 0, -cost, len(graph[a]) - 1))
        return a, len(graph[a]) - 1

    inner = {}
    for p in patterns:
        for r in range(repeats):
            arc(0, node["p", p], capacity[p], r)
        for s in members[p]:
            if s in quota:
                inner[p, s] = arc(node["p", p], node["s", s], capacity[p] * repeats, 0)
    for s in sources:
        arc(node["s", s], sink, quota[s], 0)
    potential = [0] * (sink + 1)
    while True:
        far, via = [None] * (sink + 1), [None] * (sink + 1)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, e in enumerate(graph[a]):
                new = d + e.cost + potential[a] - potential[e.to]
                if e.room > 0 and (far[e.to] is None or new < far[e.to]):
                    far[e.to], via[e.to] = new, (a, k)
                    heapq.heappush(heap, (new, e.to))
        if far[sink] is None:
            break
        potential = [p + (f or 0) if f is not None else p for p, f in zip(potential, far, strict=True)]
        path, at = [], sink
        while at:
            a, k = via[at]
            path.append((a, k))
            at = a
        move = min(graph[a][k].room for a, k in path)
        for a, k in path:
            e = graph[a][k]
            e.room -= move
            graph[e.to][e.back].room += move
    out: dict[tuple[str, int, str], int] = {}
    for p in patterns:  # a pattern's flow fills its repetitions from the first
        left = [capacity[p]] * repeats
        r = 0
        for s in members[p]:
            if (p, s) not in inner:
                continue
            a, k = inner[p, s]
            flow = capacity[p] * repeats - graph[a][k].room
            while flow > 0 and r < repeats:
                part = min(flow, left[r])
                if part:
                    out[p, r, s] = out.get((p, r, s), 0) + part
                left[r] -= part
                flow -= part
                r += left[r] == 0
    return out


def select_documents(docs: DataFrame, routed: dict[tuple[str, int, str], int], seed: str = SEED) -> DataFrame:
    """``docs`` (_id, _pattern, _size) with _taken: the words each gives, repetitions summed.

    Order within a pattern is by md5 of seed and id, then size.  Prefix sums go
    in two levels: over hash buckets of a pattern, a bounded number of rows, and
    within a bucket, so that a pattern with most of the rows is not one task.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_order", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    sums = rows.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_pattern", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_pattern", "_bucket").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(offsets, ["_pattern", "_bucket"]).withColumn("_at", F.col("_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    ends: dict[tuple[str, int], int] = {}
    for (p, r, _), n in routed.items():
        ends[p, r] = ends.get((p, r), 0) + n
    limits: dict[str, dict[int, int]] = {}
    for (p, r), n in ends.items():
        limits.setdefault(p, {})[r] = n
    table_rows = [(p, [per.get(r, 0) for r in range(max(per) + 1)]) for p, per in sorted(limits.items())]
    limit = spark.createDataFrame(table_rows, "_pattern string, _limits array<bigint>")
    taken: Column = F.aggregate(
        F.coalesce("_limits", F.array().cast("array<bigint>")),
        F.lit(0).cast("bigint"),
        lambda acc, end: acc + F.least(F.greatest(end - F.col("_at"), F.lit(0)), F.col("_size")),
    )
    return rows.join(F.broadcast(limit), "_pattern", "left").withColumn("_taken", taken).select("_id", "_pattern", "_size", "_taken")


def mix(docs: DataFrame, members: Column, size: Column, quotas: dict[str, int] | None, doc_id: str = "doc_id", repeats: int = REPEATS, seed: str = SEED, plan=None, max_patterns: int = 100_000) -> tuple[DataFrame, dict]:
    """Take documents so that each source's words meet its quota.

    ``members`` is the array of sources of a row, ``size`` its words.  ``plan``,
    if given, makes the quotas from the sizes of the sources.  Returns the rows
    (_id, _pattern, _size, _taken) and the tokens routed.  An empty table gives no
    rows; a row without words is taken for 0; null sizes count as 0.
    """
    narrow = docs.select(F.col(doc_id).alias("_id"), F.to_json(F.array_sort(F.array_distinct(members))).alias("_pattern"), F.array_sort(F.array_distinct(members)).alias("_members"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    narrow = stored(narrow, "mix")
    groups = narrow.groupBy("_pattern").agg(F.first("_members").alias("_members"), F.sum("_size").alias("_sum")).limit(max_patterns + 1).collect()
    if len(groups) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {g["_pattern"]: g["_sum"] for g in groups}
    belongs = {g["_pattern"]: list(g["_members"]) for g in groups}
    quotas = plan(capacity, belongs) if plan else quotas or {}
    routed = min_cost_flow(capacity, belongs, quotas, repeats)
    return select_documents(narrow.drop("_members"), routed, seed), {"capacity": capacity, "members": belongs, "routed": routed, "quotas": quotas}


def op5_mixing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """All documents mixed to the sources' targets: doc_id, size, source_size, target, taken."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))  # the null source sorts after all others
    kept: dict[str, tuple[int, float]] = {}

    def plan(capacity: dict[str, int], belongs: dict[str, list[str]]) -> dict[str, int]:
        by_source = {belongs[p][0]: n for p, n in capacity.items()}
        order = sorted(by_source, key=lambda s: (s == "null", s))
        sizes = [by_source[s] for s in order]
        goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(order))], SHARE * sum(sizes), REPEATS)
        kept.update({s: (n, t) for s, n, t in zip(order, sizes, goal, strict=True)})
        return {s: int(t + 0.5) for s, t in zip(order, goal, strict=True)}

    rows, told = mix(docs, F.array(name), size, None, plan=plan)
    facts = [(p, n, kept[told["members"][p][0]][1]) for p, n in told["capacity"].items()]
    by_pattern = spark.createDataFrame(facts, "_pattern string, source_size bigint, target double")
    out = rows.join(F.broadcast(by_pattern), "_pattern", "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS pos
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS total FROM s
), o AS (
  SELECT *, row_number() OVER r AS place, coalesce(sum(2.0::DOUBLE * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM w WINDOW r AS (ORDER BY 2.0::DOUBLE * source_size / weight, k)
), l AS (
  SELECT *, (1.5::DOUBLE * total - used) / room AS level FROM o
), c AS (
  SELECT *, bool_and(2.0::DOUBLE * source_size <= weight * level) OVER (ORDER BY place) AS capped FROM l
), t AS (
  SELECT source, source_size,
    CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE weight * (first_value(level) OVER (PARTITION BY capped ORDER BY place)) END AS target
  FROM c
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY pos, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (least(greatest(least(quota, source_size) - before, 0), size) + least(greatest(quota - source_size - before, 0), size))::BIGINT AS taken
FROM q
"""
