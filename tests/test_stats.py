import itertools
import random
from fractions import Fraction
from math import comb

import pytest

from helixlake.functions import stats


def tail(N, K, n, k):
    return float(sum(Fraction(comb(K, x) * comb(N - K, n - x), comb(N, n)) for x in range(max(k, 0), min(n, K) + 1) if 0 <= n - x <= N - K))


def test_hypergeometric_tail_exactly():
    for N in range(1, 12):
        for K, n, k in itertools.product(range(N + 1), range(N + 1), range(N + 2)):
            assert abs(stats.hypergeom_tail(N, K, n, k) - tail(N, K, n, k)) < 1e-9


def test_fisher_exactly():
    for a, b, c, d in itertools.product(range(5), repeat=4):
        N, K, n = a + b + c + d, a + b, a + c
        if not N:
            continue
        p = {x: Fraction(comb(K, x) * comb(N - K, n - x), comb(N, n)) for x in range(max(0, n + K - N), min(n, K) + 1)}
        assert abs(stats.fisher_p(a, b, c, d, "two-sided") - float(sum(v for v in p.values() if v <= p[a]))) < 1e-9
        assert abs(stats.fisher_p(a, b, c, d, "greater") - float(sum(v for x, v in p.items() if x >= a))) < 1e-9
        assert abs(stats.fisher_p(a, b, c, d, "less") - float(sum(v for x, v in p.items() if x <= a))) < 1e-9


def test_false_discovery_rate(spark):
    p = [0.01, 0.04, 0.03, 0.02, None, 0.5, 0.04]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = {r["i"]: r["fdr"] for r in stats.benjamini_hochberg(df, "p").collect()}
    some = sorted(x for x in p if x is not None)
    for i, x in enumerate(p):
        want = None if x is None else min(1.0, min(some[j] * len(some) / (j + 1) for j in range(len(some)) if some[j] >= x))
        assert got[i] == want or abs(got[i] - want) < 1e-12


@pytest.mark.parametrize("alternative", ["two-sided", "greater", "less"])
def test_mann_whitney(spark, alternative):
    a, b = [1, 2, 2, 5, 7, 9], [2, 3, 4, 4, 5]
    df = spark.createDataFrame([("x", "a", v) for v in a] + [("x", "b", v) for v in b], "k string, g string, v int")
    r = stats.mann_whitney(df, "v", "g", "a", "b", ["k"], alternative=alternative).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["u"] == u
    n = len(a) + len(b)
    ties = sum(c**3 - c for c in ((a + b).count(v) for v in set(a + b)))
    sd = (len(a) * len(b) / 12 * ((n + 1) - ties / (n * (n - 1)))) ** 0.5
    away = u - len(a) * len(b) / 2
    z = {"two-sided": abs(away), "greater": away, "less": -away}[alternative] - 0.5
    want = min(1.0, stats.normal_tail(z / sd) * (2 if alternative == "two-sided" else 1))
    assert abs(r["p"] - want) < 1e-12
    assert stats.mann_whitney(df, "v", "g", "a", "b", ["k"], least=6).first()["p"] is None


def test_kendall(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(12), rng.randrange(12)) for _ in range(80)]
    s = lambda x: (x > 0) - (x < 0)
    pairs = [(s(a[0] - b[0]), s(a[1] - b[1])) for a, b in itertools.combinations(rows, 2)]
    want = sum(x * y for x, y in pairs) / (sum(x * x for x, _ in pairs) * sum(y * y for _, y in pairs)) ** 0.5
    df = spark.createDataFrame(rows, "x int, y int")
    assert abs(stats.correlations(df, [("x", "y")], "kendall").first()["r"] - want) < 1e-9


def test_kendall_of_many_distinct_values(spark):
    rows = spark.range(1_200_000).selectExpr("id as x", "id as y", "-id as z")
    assert abs(stats.kendall_tau(rows, "x", "y").first()["r"] - 1) < 1e-12
    assert abs(stats.kendall_tau(rows, "x", "z").first()["r"] + 1) < 1e-12
