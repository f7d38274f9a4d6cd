import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.llm import mixing as mx


def reshared(sizes, weights, budget, limit):
    """Shares step by step: cap what is above, deal the excess out again."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = budget
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w >= limit * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = limit * sizes[i]
        left -= sum(limit * sizes[i] for i in over)
        free -= over
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    weights = [mx.WEIGHTS[i % 3] for i in range(len(sizes))]
    got, want = mx.targets(sizes, weights, 1.5 * sum(sizes), 2), reshared(sizes, weights, 1.5 * sum(sizes), 2)
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, want, strict=True))


def test_flow_is_largest_and_cheapest_by_brute_force():
    rng = random.Random(2)
    for _ in range(25):
        sources = ["a", "b"]
        members = {"p": ["a"], "q": ["a", "b"], "r": ["b"]}
        capacity = {p: rng.randrange(0, 4) for p in members}
        quota = {s: rng.randrange(0, 8) for s in sources}
        got = mx.min_cost_flow(capacity, members, quota, 2)
        best = None
        arcs = [("p", "a"), ("q", "a"), ("q", "b"), ("r", "b")]
        for flow in itertools.product(*[range(2 * capacity[p] + 1) for p, _ in arcs]):
            into = {s: sum(f for f, (_, t) in zip(flow, arcs, strict=True) if t == s) for s in sources}
            out = {p: sum(f for f, (t, _) in zip(flow, arcs, strict=True) if t == p) for p in members}
            if all(into[s] <= quota[s] for s in sources) and all(out[p] <= 2 * capacity[p] for p in members):
                cost = sum(max(0, out[p] - capacity[p]) for p in members)
                best = min(best or (0, 10**9), (-sum(flow), cost))
        assert (-sum(got.values()), sum(n * r for (_, r, _), n in got.items())) == best
        for p in members:
            assert all(sum(n for (x, y, _), n in got.items() if x == p and y == r) <= capacity[p] for r in range(2))


def test_overlapping_sources(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([["a"], ["b"], ["a", "b"], ["c", "a"]]), rng.randrange(0, 30), "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, words int, _size string")
    quota = {"a": 900, "b": 1200, "c": 300}
    got, told = mx.mix(docs, mx.F.col("sources"), mx.F.col("words"), quota)
    taken = {r["_id"]: r["_taken"] for r in got.collect()}
    assert sum(taken.values()) == sum(told["routed"].values()) == sum(quota.values())
    assert all(0 <= taken[i] <= 2 * n for i, _, n, _ in rows)
    # a repetition is used only where all first ones of the pattern are
    by = {}
    for i, s, n, _ in rows:
        by.setdefault(tuple(sorted(s)), []).append((n, taken[i]))
    for some in by.values():
        assert not (any(t > n for n, t in some) and any(t < n for n, t in some))


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(400)]
    rows += [(900, None, "b", 1), (901, "", "empty", 1), (5, rows[5][1], rows[5][2], 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, target int").write.parquet(str(tmp_path / "documents.parquet"))
    one, two = (sorted(map(tuple, mx.op5_mixing(spark, str(tmp_path)).collect())) for _ in range(2))
    assert one == two and len(one) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, reshared([sizes[s] for s in order], [mx.WEIGHTS[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2), strict=True))
    source = {i: s for i, _, s, _ in rows}
    taken = {}
    for i, size, total, target, n in one:
        s = source[i]
        assert total == sizes[s] and abs(target - goal[s]) < 1e-6 and 0 <= n <= 2 * size
        taken[s] = taken.get(s, 0) + n
    assert all(abs(taken[s] - goal[s]) <= 1 for s in order)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert mx.op5_mixing(spark, str(tmp_path)).count() == 0
