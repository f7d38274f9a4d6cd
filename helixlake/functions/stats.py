"""Exact and rank statistics over rows.

Multiple testing, ranks and correlations are windows and aggregates.  Tails of
the hypergeometric distribution need the logarithm of the gamma function, which
Spark's functions lack; they are Arrow-batched functions of counts, evaluated on
a few rows for each term or variant, never on the data itself.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _term(N: int, K: int, n: int, k: int) -> float:
    """Log probability of k marked among n drawn of N, K of them marked."""
    return _log_choose(K, k) + _log_choose(N - K, n - k) - _log_choose(N, n)


def hypergeom_tail(N: int, K: int, n: int, k: int) -> float:
    """P(X >= k): the sum of the tail's own terms, so small values keep their digits."""
    low, high = max(k, n + K - N, 0), min(n, K)
    if low > high:
        return 0.0
    if low <= max(0, n + K - N):
        return 1.0
    return min(1.0, math.fsum(math.exp(_term(N, K, n, x)) for x in range(low, high + 1)))


def fisher_p(a: int, b: int, c: int, d: int, alternative: str) -> float:
    """Fisher's exact test of the table [[a, b], [c, d]]: greater, less or two-sided."""
    N, K, n = a + b + c + d, a + b, a + c
    if alternative == "greater":
        return hypergeom_tail(N, K, n, a)
    if alternative == "less":
        return hypergeom_tail(N, K, N - n, b)
    low, high = max(0, n + K - N), min(n, K)
    here = _term(N, K, n, a) if low <= a <= high else 0.0
    return min(1.0, math.fsum(math.exp(t) for t in (_term(N, K, n, x) for x in range(low, high + 1)) if t <= here + 1e-7))


def normal_tail(z: float) -> float:
    """P(Z >= z) of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def hypergeom_sf(N: pd.Series, K: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
    """P(X >= k); null counts give null."""
    return pd.Series([hypergeom_tail(int(a), int(b), int(c), int(d)) if not any(pd.isna(x) for x in (a, b, c, d)) else None for a, b, c, d in zip(N, K, n, k, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, alternative: pd.Series) -> pd.Series:
    """Fisher's exact p of each row's table."""
    rows = zip(a, b, c, d, alternative, strict=True)
    return pd.Series([fisher_p(int(w), int(x), int(y), int(z), s) if not any(pd.isna(v) for v in (w, x, y, z)) else None for w, x, y, z, s in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def upper_normal(z: pd.Series) -> pd.Series:
    """P(Z >= z)."""
    return z.map(lambda v: None if pd.isna(v) else normal_tail(float(v))).astype("float64")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str] | None = None, name: str = "fdr") -> DataFrame:
    """``df`` with the step-up false discovery rate over the non-null ``p`` of each group in ``by``.

    Works on distinct p-values, of which each needs only how many are as small
    (their cumulative count); the window over them holds test results, a row a
    test, not data.
    """
    by = by or []
    some = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*by).orderBy(p)
    ranked = some.withColumn("_rank", F.sum("_n").over(up)).withColumn("_m", F.sum("_n").over(Window.partitionBy(*by)))
    down = Window.partitionBy(*by).orderBy(F.desc(p))
    rate = ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).select(*by, p, name)
    keys = [*by, p]
    return df.join(rate, keys, "left").select(*df.columns, name)


def average_rank(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with ranks from 1, ties sharing their mean: from counts of distinct values, joined back."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = counts.withColumn(name, F.sum("_n").over(Window.partitionBy(*by).orderBy(value)) - (F.col("_n") - 1) / 2).select(*by, value, name)
    return df.join(ranks, [*by, value], "left").select(*df.columns, name)


def mann_whitney(df: DataFrame, value: str, group: str, first: str, second: str, by: list[str], least: int = 1, alternative: str = "two-sided", continuity: bool = True) -> DataFrame:
    """Mann-Whitney U of two groups for each key: n, means, u, p.

    Normal approximation with tie correction.  Keys where a group has fewer than
    ``least`` values have a null p, and so have those whose values are all equal.
    """
    both = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    one, two = F.col(group) == first, F.col(group) == second
    counts = both.groupBy(*by, value).agg(F.count_if(one).alias("_a"), F.count_if(two).alias("_b"))
    t = F.col("_a") + F.col("_b")
    rank = F.sum(t).over(Window.partitionBy(*by).orderBy(value)) - (t - 1) / 2
    counts = counts.withColumn("_rank", rank)
    stats = counts.groupBy(*by).agg(
        F.sum("_a").alias("n1"),
        F.sum("_b").alias("n2"),
        (F.sum(F.col("_a") * F.col(value)) / F.sum("_a")).alias("mean1"),
        (F.sum(F.col("_b") * F.col(value)) / F.sum("_b")).alias("mean2"),
        F.sum(F.col("_a") * F.col("_rank")).alias("_r1"),
        F.sum(t * t * t - t).cast("double").alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    stats = stats.withColumn("u", F.col("_r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    away = F.col("u") - n1 * n2 / 2
    shift = F.lit(0.5 if continuity else 0.0)
    top = {"two-sided": F.abs(away), "greater": away, "less": -away}[alternative] - shift
    able = (F.col("n1") >= least) & (F.col("n2") >= least) & (sd > 0)
    z = F.when(able, F.try_divide(top, sd))
    p = F.least(F.lit(1.0), upper_normal(z) * (2 if alternative == "two-sided" else 1))
    return stats.withColumn("p", F.when(able, p)).select(*by, "n1", "n2", "mean1", "mean2", "u", "p")


def correlations(df: DataFrame, pairs: list[tuple[str, str]], method: str = "pearson") -> DataFrame:
    """(a, b, r) for pairs of columns over rows where both are known."""
    out = None
    for a, b in pairs:
        rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_x"), F.col(b).alias("_y"))
        if method == "spearman":
            rows = average_rank(average_rank(rows, "_x", name="_rx"), "_y", name="_ry").select(F.col("_rx").alias("_x"), F.col("_ry").alias("_y"))
        if method == "kendall":
            one = kendall_tau(rows, "_x", "_y")
        else:
            one = rows.agg(F.corr("_x", "_y").alias("r"))
        one = one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "r")
        out = one if out is None else out.unionByName(one)
    return out


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b, without comparing all pairs of rows.

    Discordant pairs are inversions of y's ranks in order of x.  They are counted
    bit by bit: two ranks that first differ at a bit meet in one group, that of
    their common higher bits, and there an inversion is a one before a zero, which
    a running count in order of x finds.  Every row takes part in as many groups as
    the highest rank has bits.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"))
    ys = rows.select("y").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("y")) - 1)
    cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).join(ys, "y")
    top = ys.agg(F.length(F.bin(F.coalesce(F.max("k"), F.lit(0)))).alias("digits"))  # one row
    bits = cells.crossJoin(F.broadcast(top)).select("x", "n", "k", F.explode(F.expr("sequence(0, digits - 1)")).alias("bit"))
    prefix = F.expr("shiftright(k, bit + 1)")
    one = F.expr("shiftright(k, bit) & 1") == 1
    steps = bits.groupBy("bit", prefix.alias("prefix"), "x").agg(F.sum(F.when(one, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(one, 0).otherwise(F.col("n"))).alias("zeros"))
    before = Window.partitionBy("bit", "prefix").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    discordant = steps.select((F.coalesce(F.sum("ones").over(before), F.lit(0)) * F.col("zeros")).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"))
    tie = lambda *c: rows.groupBy(*c).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) / 2")), F.lit(0)).alias("t"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).select(F.expr("n * (n - 1) / 2").alias("all"))
    one_row = total.crossJoin(tie("x").withColumnRenamed("t", "tx")).crossJoin(tie("y").withColumnRenamed("t", "ty")).crossJoin(tie("x", "y").withColumnRenamed("t", "txy")).crossJoin(discordant)  # one row each
    con = F.col("all") - F.col("tx") - F.col("ty") + F.col("txy") - F.col("d")
    return one_row.select(F.try_divide(con - F.col("d"), F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty")))).alias("r"))


def strand_bias(forward: Column, total: Column) -> Column:
    """The larger of the shares of the two strands."""
    return F.greatest(F.try_divide(forward, total), 1 - F.try_divide(forward, total))
