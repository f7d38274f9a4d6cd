"""Chromatin contacts: restriction sites, ligations, contact matrices.

Matrices are long: (i, j, value) with i <= j; the mirror half is derived where a
step needs rows.  Bins are 0-based and half-open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.operators import ordered
from helixlake.operators.intervals import bin_of_points

# ---------------------------------------------------------------- fragment ends


def next_site(ends: DataFrame, sites: DataFrame, site_length: int, chunk: int = ordered.CHUNK) -> DataFrame:
    """Reads (contig, start, end, strand) with the restriction site they run into: centre and distance.

    ``sites`` has (contig, strand, pos): for + the site's end, for - its start,
    both 0-based bounds.  A + read takes the first site that ends at or after its
    own end, a - read the last that starts at or before its start.  The centre is
    the base beside the site's middle on the read's side; the distance counts the
    bases from the read's outer one to it.  Null if there is none.
    """
    plus, minus = ends.where("strand = '+'"), ends.where("strand = '-'")
    half = site_length // 2

    def asked(df: DataFrame, column: str, strand: str, sign: int) -> DataFrame:
        known = sites.where(F.col("strand") == strand).select("contig", (F.col("pos") * sign).alias("_pos"), F.lit(0).alias("_q"), (F.col("pos") * sign).alias("_site"))
        spots = df.select("contig", (F.col(column) * sign).alias("_pos")).distinct().select("contig", "_pos", F.lit(1).alias("_q"), F.lit(None).cast("long").alias("_site"))
        found = ordered.running_max(known.unionByName(spots), ["contig"], "_pos", "_site", "_best", ["_pos", "_q"], chunk=chunk).where("_q = 1")
        return found.select("contig", (F.col("_pos") * sign).alias(column), (F.col("_best") * sign).alias("site"))

    # mirrored, the first site at or after a position is the last at or before it
    p = plus.join(asked(plus, "end", "+", -1), ["contig", "end"], "left")
    p = p.withColumns({"centre": F.col("site") - half - 1, "distance": F.col("site") - half - F.col("start")})
    m = minus.join(asked(minus, "start", "-", 1), ["contig", "start"], "left")
    m = m.withColumns({"centre": F.col("site") + half, "distance": F.col("end") - F.col("site") - half})
    columns = [*ends.columns, "centre", "distance"]
    return p.select(columns).unionByName(m.select(columns))


def ligations(assigned: DataFrame, most: int) -> DataFrame:
    """Pairs with both sites (contig1, centre1, distance1, ..., 2): with ``outcome``.

    none: a read has no site; distant: a site lies more than ``most`` away;
    inter: sites on different contigs; intra otherwise.
    """
    outcome = (
        F.when(F.col("centre1").isNull() | F.col("centre2").isNull(), "none")
        .when((F.col("distance1") > most) | (F.col("distance2") > most), "distant")
        .when(F.col("contig1") != F.col("contig2"), "inter")
        .otherwise("intra")
    )
    gap = F.when(F.col("contig1") == F.col("contig2"), F.abs(F.col("centre1") - F.col("centre2")))
    return assigned.withColumns({"outcome": outcome, "ligation_distance": gap})


def distance_summary(distances: DataFrame, value: str, edges: list[int]) -> DataFrame:
    """Cumulative frequency of ``value`` at each edge, with mean and quartiles over all: edge, fraction, mean, q25, q50, q75."""
    at = distances.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        *[F.count_if(F.col(value) <= e).alias(f"e{k}") for k, e in enumerate(edges)],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(e).cast("long").alias("edge"), F.col(f"e{k}").alias("k")) for k, e in enumerate(edges)])).alias("r")
    return at.select("n", "mean", "q", rows).select("r.edge", F.try_divide(F.col("r.k"), F.col("n")).alias("fraction"), "mean", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


# ---------------------------------------------------------------- matrix


def contact_matrix(pairs: DataFrame, bins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matrix, outcomes) of pairs of positions (contig1, pos1, contig2, pos2).

    ``bins`` has (contig, start, end, bin), bins numbered over all contigs.  Each
    pair counts at (i, j) and (j, i), so twice where i = j; stored with i <= j.
    Outcomes: total, nochr, nobin, accepted; the first end that fails decides.
    """
    tagged = pairs.select("contig1", "pos1", "contig2", "pos2")
    one = bin_of_points(tagged.select(F.col("contig1").alias("contig"), F.col("pos1").alias("pos"), "contig2", "pos2"), bins)
    one = one.select(F.col("bin").alias("_b1"), F.col("outcome").alias("_o1"), F.col("contig2").alias("contig"), F.col("pos2").alias("pos"))
    both = bin_of_points(one, bins).select("_b1", "_o1", F.col("bin").alias("_b2"), F.col("outcome").alias("_o2"))
    outcome = F.when(F.col("_o1") != "found", F.col("_o1")).when(F.col("_o2") != "found", F.col("_o2")).otherwise("accepted")
    counts = both.groupBy(F.least("_b1", "_b2").alias("i"), F.greatest("_b1", "_b2").alias("j"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    matrix = counts.where("outcome = 'accepted'").select("i", "j", (F.col("n") * F.when(F.col("i") == F.col("j"), 2).otherwise(1)).alias("value"))
    told = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)).alias(o) for o in ("nochr", "nobin", "accepted")])
    return matrix, told


def mirrored(matrix: DataFrame) -> DataFrame:
    """Both halves of a matrix stored with i <= j."""
    other = matrix.where("i <> j").withColumns({"i": F.col("j"), "j": F.col("i")})
    return matrix.unionByName(other.select(matrix.columns))


def asymmetric_cells(matrix: DataFrame, tolerance: float = 1.01e-6, most: int = 10) -> DataFrame:
    """Of a matrix with both halves, at most ``most`` cells that differ from their mirror."""
    a, b = matrix.select("i", "j", F.col("value").alias("a")), matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("b"))
    both = a.join(b, ["i", "j"], "full_outer").withColumns({"a": F.coalesce("a", F.lit(0)), "b": F.coalesce("b", F.lit(0))})
    return both.where((F.abs(F.col("a") - F.col("b")) > tolerance) & (F.col("i") < F.col("j"))).orderBy("i", "j").limit(most)


def bin_sums(matrix: DataFrame, by: list[str] | None = None, remove_diagonal: bool = False) -> DataFrame:
    """Column sums (by, i, total) of a matrix stored with i <= j."""
    rows = mirrored(matrix)
    rows = rows.where("i <> j") if remove_diagonal else rows
    return rows.groupBy(*(by or []), "i").agg(F.sum("value").alias("total"))


def low_bins(matrix: DataFrame, bins: DataFrame, least: float, by: list[str] | None = None, remove_diagonal: bool = False) -> DataFrame:
    """Bins (bin) whose column sum is below ``least`` in any group of ``by``; a bin without contacts has the sum 0."""
    by = by or []
    sums = bin_sums(matrix, by, remove_diagonal)
    groups = matrix.select(*by).distinct() if by else matrix.sparkSession.range(1).select()
    frame = bins.select(F.col("bin").alias("i")).crossJoin(F.broadcast(groups))  # bins by samples: the result's own size
    filled = frame.join(sums, [*by, "i"], "left").groupBy("i").agg(F.min(F.coalesce("total", F.lit(0))).alias("least"))
    return filled.where(F.col("least") < least).select(F.col("i").alias("bin"))


def region_bins(bins: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, bin) of the bins that lie wholly within a region (contig, start, end, region)."""
    from helixlake.operators.intervals import overlap_join

    pairs = overlap_join(bins.select("contig", "start", "end", "bin"), regions.select("contig", "start", "end", "region"))
    return pairs.where("start >= start_r and end <= end_r").select("region", "bin")


def submatrix(matrix: DataFrame, members: DataFrame, low: DataFrame | None = None, remove_diagonal: bool = False) -> DataFrame:
    """Cells (region, i, j, value) with both bins in a region, without the diagonal or low bins if asked."""
    a, b = members.select("region", F.col("bin").alias("i")), members.select("region", F.col("bin").alias("j"))
    rows = matrix.join(a, "i").join(b, ["region", "j"])
    rows = rows.where("i <> j") if remove_diagonal else rows
    if low is not None:
        rows = rows.join(low.select(F.col("bin").alias("i")), "i", "left_anti").join(low.select(F.col("bin").alias("j")), "j", "left_anti")
    return rows.select("region", "i", "j", "value")


def balance(matrix: DataFrame, by: list[str], rounds: int = 10_000, deviation: float = 1e-12, digits: int = 9) -> DataFrame:
    """ICE: (by, i, j, value, bias_i, bias_j), each group's matrix scaled until all its columns sum to 1.

    The bias of a bin starts at 1 and is multiplied by the square root of its
    column's sum until no sum is off by more than ``deviation``; without that
    after ``rounds`` rounds the group fails.  A group is balanced in one task on
    its cells; see ``balance_filled`` for full matrices and ``balance_large`` for
    more cells.  Values are rounded to ``digits``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in matrix.schema}
    shape = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", i long, j long, value double, bias_i double, bias_j double"

    def run(df: pd.DataFrame) -> pd.DataFrame:
        names, place = np.unique(np.concatenate([df["i"], df["j"]]), return_inverse=True)
        a, b = place[: len(df)], place[len(df) :]
        v, off = df["value"].to_numpy(float), a != b
        bias = np.ones(len(names))
        for _ in range(rounds):
            scaled = v / (bias[a] * bias[b])
            sums = np.bincount(a, scaled, len(names)) + np.bincount(b[off], scaled[off], len(names))
            some = sums != 0
            if not some.any() or np.abs(sums[some] - 1).max() <= deviation:
                break
            bias *= np.where(some, np.sqrt(np.where(some, sums, 1)), 1)
        else:
            raise ValueError("the matrix did not converge")
        return df[by].assign(i=df["i"], j=df["j"], value=np.round(v / (bias[a] * bias[b]), digits), bias_i=bias[a], bias_j=bias[b])

    return matrix.groupBy(*by).applyInPandas(run, shape)


def balance_filled(matrix: DataFrame, members: DataFrame, by: list[str], fill: float = 1.0, rounds: int = 10_000, deviation: float = 1e-12, digits: int = 9, block: int = 512) -> DataFrame:
    """``balance`` of full matrices: ``fill`` more in every cell of each group's bins, those without contacts too.

    ``matrix`` has (by, i, j, value) with i <= j, ``members`` (by, bin).  A bin's
    column sum is ``fill`` times the sum of all inverse biases and its own few
    cells, so a task finds the biases from a group's contacts and bins, not from
    its bins squared.  The full matrix is made last, in tiles of ``block`` bins;
    bins with their biases are broadcast, and no full matrix is shuffled.
    """
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    groups = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    number = lambda name: F.col(name).cast("long")
    cells = matrix.select(*by, number("i").alias("i"), number("j").alias("j"), F.col("value").cast("double").alias("value"))
    cells = cells.unionByName(members.select(*by, number("bin").alias("i"), number("bin").alias("j"), F.lit(0.0).alias("value")))

    def biases(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["i", "j", "value"])  # sums in one order, so that both readers get the same
        names, place = np.unique(np.concatenate([df["i"], df["j"]]), return_inverse=True)
        a, b = place[: len(df)], place[len(df) :]
        v, off, bias = df["value"].to_numpy(float), a != b, np.ones(len(names))
        for _ in range(rounds):
            scaled = v / (bias[a] * bias[b])
            sums = fill / bias * (1 / bias).sum() + np.bincount(a, scaled, len(names)) + np.bincount(b[off], scaled[off], len(names))
            some = sums != 0
            if not some.any() or np.abs(sums[some] - 1).max() <= deviation:
                break
            bias *= np.where(some, np.sqrt(np.where(some, sums, 1)), 1)
        else:
            raise ValueError("the matrix did not converge")
        rows = []
        for k in range(0, len(names), block):
            own = slice(*np.searchsorted(a, [k, k + block]))
            rows.append((*(df[x].iloc[0] for x in by), k, names[k : k + block], bias[k : k + block], a[own], b[own], v[own]))
        return pd.DataFrame(rows, columns=[*by, "place", "bins", "bias", "a", "b", "v"])

    told = cells.groupBy(*by).applyInPandas(biases, f"{groups}, place long, bins array<long>, bias array<double>, a array<long>, b array<long>, v array<double>").persist()  # read twice below
    parts = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    other = told.select(*[F.col(x).alias(f"_{x}") for x in (*by, "place", "bins", "bias")])
    same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in by]
    tiles = told.repartition(parts, *by, "place").join(F.broadcast(other), [*same, F.col("place") <= F.col("_place")]).drop(*[f"_{x}" for x in by])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tile = batch.slice(k, 1)
                i, bias_i, a, b, v, j, bias_j = (tile.column(x).flatten().to_numpy() for x in ("bins", "bias", "a", "b", "v", "_bins", "_bias"))
                a, b = a - tile.column("place")[0].as_py(), b - tile.column("_place")[0].as_py()
                here = (b >= 0) & (b < len(j))
                value = np.full((len(i), len(j)), float(fill))
                np.add.at(value, (a[here], b[here]), v[here])
                x, y = np.nonzero(i[:, None] <= j)
                value = np.round(value[x, y] / (bias_i[x] * bias_j[y]), digits)
                first = pa.array(np.zeros(len(x), np.int32))
                yield pa.RecordBatch.from_arrays([*(tile.column(c).take(first) for c in by), *(pa.array(c) for c in (i[x], j[y], value, bias_i[x], bias_j[y]))], names=[*by, "i", "j", "value", "bias_i", "bias_j"])

    return tiles.mapInArrow(full, f"{groups}, i long, j long, value double, bias_i double, bias_j double")


def balance_large(matrix: DataFrame, store, rounds: int = 1000, deviation: float = 1e-6) -> DataFrame:
    """ICE of one matrix that no task could hold, by joins: (i, j, value, bias_i, bias_j).

    ``store`` writes a DataFrame to shared storage and reads it back; it cuts the
    lineage of each round.
    """
    cells = matrix.select("i", "j", F.col("value").cast("double").alias("value"))
    bias = store(cells.select("i").union(cells.select(F.col("j"))).distinct().select("i", F.lit(1.0).alias("bias")))
    other = lambda b: b.select(F.col("i").alias("j"), F.col("bias").alias("bias_j"))
    for _ in range(rounds):
        scaled = cells.join(bias.withColumnRenamed("bias", "bias_i"), "i").join(other(bias), "j").withColumn("value", F.col("value") / (F.col("bias_i") * F.col("bias_j")))
        sums = mirrored(scaled.select("i", "j", "value")).groupBy("i").agg(F.sum("value").alias("s"))
        new = store(bias.join(sums, "i").withColumn("new", F.col("bias") * F.when(F.col("s") > 0, F.sqrt("s")).otherwise(1.0)))
        worst = new.where("s > 0").agg(F.max(F.abs(F.col("s") - 1))).first()[0]
        if worst is None or worst <= deviation:
            return scaled.select("i", "j", "value", "bias_i", "bias_j")
        bias = new.select("i", F.col("new").alias("bias"))
    raise ValueError("the matrix did not converge")


# ---------------------------------------------------------------- distances


def with_distances(matrix: DataFrame, bins: DataFrame, same_contig: bool = True) -> DataFrame:
    """Cells with ``dist``, from bin centre to bin centre, signed (j after i is positive)."""
    a = bins.select(F.col("bin").alias("i"), F.col("contig").alias("_ci"), ((F.col("start") + F.col("end")) / 2).alias("_mi"))
    b = bins.select(F.col("bin").alias("j"), F.col("contig").alias("_cj"), ((F.col("start") + F.col("end")) / 2).alias("_mj"))
    rows = matrix.join(a, "i").join(b, "j")
    rows = rows.where("_ci = _cj") if same_contig else rows
    return rows.withColumn("dist", F.col("_mj") - F.col("_mi")).drop("_ci", "_cj", "_mi", "_mj")


def mean_by_distance(cells: DataFrame, by: list[str], remove_zero: bool = True) -> DataFrame:
    """(by, dist, n, mean) of values over cells of one distance."""
    rows = cells.where("value <> 0") if remove_zero else cells
    return rows.groupBy(*by, F.abs("dist").alias("dist")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def mean_by_distance_with_zeros(cells: DataFrame, bins: DataFrame, by: list[str]) -> DataFrame:
    """(by, dist, n, mean) over all pairs of bins of a contig at one distance, those without contacts too.

    ``cells`` has both halves; ``bins`` are of one width and numbered without
    gaps within a contig.  The pairs are counted by arithmetic, not made: a contig
    of m bins has m - k pairs at a distance of k bins, twice that in both halves.
    """
    per = bins.groupBy("contig").agg(F.count(F.lit(1)).alias("m"), F.min(F.col("end") - F.col("start")).alias("w"))
    steps = per.select(F.col("w"), F.col("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k"))
    pairs = steps.groupBy((F.col("k") * F.col("w")).cast("double").alias("dist")).agg(F.sum((F.col("m") - F.col("k")) * F.when(F.col("k") == 0, 1).otherwise(2)).alias("n"))
    sums = cells.groupBy(*by, F.abs("dist").cast("double").alias("dist")).agg(F.sum("value").alias("_s"))
    groups = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    grid = pairs.crossJoin(F.broadcast(groups))  # distances by samples: the result's own size
    return grid.join(sums, [*by, "dist"], "left").select(*by, "dist", "n", (F.coalesce("_s", F.lit(0)) / F.col("n")).alias("mean"))


def self_ligation_rate(matrix: DataFrame, by: list[str]) -> DataFrame:
    """(by, rate): share of a matrix's contacts that lie on its diagonal; both halves count."""
    own = F.sum(F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(0))
    return matrix.groupBy(*by).agg(F.try_divide(own, F.sum(F.col("value") * F.when(F.col("i") == F.col("j"), 1).otherwise(2))).alias("rate"))


def distance_quantile(cells: DataFrame, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, i, quantile, dist): the distance at which a bin's values, in order of distance, have summed to the quantile.

    ``cells`` has both halves.  Null where the bin's values sum to less.  Of
    cells at one distance, the one after the bin counts last.
    """
    by = by or []
    order = Window.partitionBy(*by, "i").orderBy(F.abs("dist"), "dist", "j").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("_sum", F.sum("value").over(order))
    asked = run.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    hit = F.when(F.col("_sum") >= F.col("quantile"), F.struct("_sum", F.abs("dist").alias("a"), "dist"))
    return asked.groupBy(*by, "i", "quantile").agg(F.min(hit)["dist"].alias("dist"))


def directionality(cells: DataFrame, bins: DataFrame, window: int = 10, least: float = 0.5) -> DataFrame:
    """(bin, self, inter, up, down, log2) of each bin of a normalised matrix with both halves.

    Bins whose column sums to less than ``least`` are masked: they have nulls
    throughout, and others don't see them; nor are other contigs seen.  ``inter``
    is what is left of 1.  log2 compares the sums of the first ``window`` mirrored
    neighbours, of which both are seen; it is null if there are none or both sums
    are 0, and infinite if one is.
    """
    sums = cells.groupBy(F.col("i").alias("bin")).agg(F.sum("value").alias("_s"))
    good = bins.join(sums, "bin", "left").where(F.coalesce("_s", F.lit(0.0)) >= least).select("bin", "contig")
    a, b = good.select(F.col("bin").alias("i"), F.col("contig").alias("_ci")), good.select(F.col("bin").alias("j"), F.col("contig").alias("_cj"))
    seen = cells.join(a, "i").join(b, "j").where("_ci = _cj").select("i", "j", "value")
    part = seen.groupBy(F.col("i").alias("bin")).agg(*[F.coalesce(F.sum(F.when(F.expr(t), F.col("value"))), F.lit(0.0)).alias(n) for n, t in (("self", "i = j"), ("up", "j < i"), ("down", "j > i"))])
    offsets = F.explode(F.sequence(F.lit(1), F.lit(window))).alias("k")
    near = good.select("bin", "contig", offsets)
    up = good.select(F.col("bin").alias("_u"), F.col("contig").alias("_cu"))
    down = good.select(F.col("bin").alias("_d"), F.col("contig").alias("_cd"))
    near = near.join(up, (F.col("_u") == F.col("bin") - F.col("k")) & (F.col("_cu") == F.col("contig"))).join(down, (F.col("_d") == F.col("bin") + F.col("k")) & (F.col("_cd") == F.col("contig")))
    value = lambda to, name: seen.select(F.col("i").alias("bin"), F.col("j").alias(to), F.col("value").alias(name))
    near = near.join(value("_u", "_vu"), ["bin", "_u"], "left").join(value("_d", "_vd"), ["bin", "_d"], "left")
    pair = near.groupBy("bin").agg(F.sum(F.coalesce("_vu", F.lit(0.0))).alias("_su"), F.sum(F.coalesce("_vd", F.lit(0.0))).alias("_sd"))
    inf = F.lit(float("inf"))
    log2 = F.when((F.col("_su") == 0) & (F.col("_sd") == 0), F.lit(None).cast("double")).when(F.col("_su") == 0, -inf).when(F.col("_sd") == 0, inf).otherwise(F.log2(F.col("_su") / F.col("_sd")))
    zero = lambda c: F.when(F.col("contig_ok"), F.coalesce(c, F.lit(0.0)))
    out = bins.select("bin").join(good.select("bin", F.lit(True).alias("contig_ok")), "bin", "left").join(part, "bin", "left").join(pair, "bin", "left")
    inter = F.when(F.col("contig_ok"), 1 - F.coalesce("self", F.lit(0.0)) - F.coalesce("up", F.lit(0.0)) - F.coalesce("down", F.lit(0.0)))
    return out.select("bin", zero("self").alias("self"), inter.alias("inter"), zero("up").alias("up"), zero("down").alias("down"), log2.alias("log2"))


def mean_log2_ratio(cells: DataFrame, by: list[str], window: int = 100, least: int = 1) -> DataFrame:
    """(by, i, n, mean_log2): mean of log2(up / down) over mirrored neighbours within ``window``, both not 0, if there are ``least`` of them."""
    up = cells.where("j < i and value <> 0").select(*by, "i", (F.col("i") - F.col("j")).alias("k"), F.col("value").alias("u"))
    down = cells.where("j > i and value <> 0").select(*by, "i", (F.col("j") - F.col("i")).alias("k"), F.col("value").alias("d"))
    near = up.where(F.col("k") <= window).join(down, [*by, "i", "k"])
    return near.groupBy(*by, "i").agg(F.count(F.lit(1)).alias("n"), F.avg(F.log2(F.col("u") / F.col("d"))).alias("mean_log2")).where(F.col("n") >= least)


def mean_distance(cells: DataFrame) -> DataFrame:
    """(i, dist): mean distance of a bin's contacts, weighted by value, as a whole number; cells of both halves with ``dist``."""
    return cells.groupBy("i").agg(F.try_divide(F.sum(F.abs("dist") * F.col("value")), F.sum("value")).cast("long").alias("dist"))


def bin_summary(sums: DataFrame, least: float) -> DataFrame:
    """One row: mean and median of column sums, and how many are below ``least``."""
    return sums.agg(F.avg("total").alias("mean"), F.median("total").alias("median"), F.count_if(F.col("total") < least).alias("below"))


def number_bins(bins: DataFrame, contigs: DataFrame) -> DataFrame:
    """Bins renumbered over all contigs, in the contigs' order: offsets come from the number of bins of each contig."""
    counts = bins.groupBy("contig").agg(F.count(F.lit(1)).alias("_n")).join(contigs.select("contig", "ordinal"), "contig")
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)  # a row a contig
    offsets = counts.select("contig", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return bins.join(F.broadcast(offsets), "contig").withColumn("bin", F.col("bin") + F.col("_offset")).drop("_offset")


def region_of_name(name: Column) -> Column:
    """(contig, start, end), 0-based, of a bin's name ``contig:start-end`` counted from 1."""
    part = F.split(name, "[:-]")
    return F.struct(part[0].alias("contig"), (part[1].cast("long") - 1).alias("start"), part[2].cast("long").alias("end"))
