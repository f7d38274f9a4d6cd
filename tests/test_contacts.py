import numpy as np
import pytest

from helixlake.operators import contacts as ct
from helixlake.operators import intervals as iv


@pytest.fixture(scope="module")
def small(spark):
    contigs = spark.createDataFrame([("chr1", 46, 0), ("chr2", 33, 1)], "contig string, length long, ordinal int")
    return ct.number_bins(iv.bins(contigs, 10, True), contigs)


def test_contact_matrix(spark, small):
    pairs = [("chr1", 4, "chr1", 13), ("chr2", 2, "chr1", 33), ("chr1", 24, "chr2", 11), ("chr1", 4, "chr2", 32), ("chr1", 44, "chr1", 16), ("chr3", 10, "chr2", 12), ("chr1", 20, "chr3", 20), ("chr1", 12, "chr2", 26), ("chr1", 14, "chr1", 37), ("chr1", 1, "chr2", 10)]
    df = spark.createDataFrame([(a, p - 1, b, q - 1) for a, p, b, q in pairs], "contig1 string, pos1 long, contig2 string, pos2 long")
    matrix, outcomes = ct.contact_matrix(df, small)
    assert sorted(map(tuple, matrix.collect())) == [(0, 0, 2), (0, 6, 1), (1, 3, 1), (2, 4, 2)]
    assert outcomes.first().asDict() == {"total": 10, "nochr": 2, "nobin": 3, "accepted": 5}
    assert sorted(r["bin"] for r in ct.low_bins(matrix, small, 2).collect()) == [1, 3, 5, 6]


def test_sites_and_pairs(spark):
    one_based = {"chr1": ([12, 26], [9, 23]), "chr2": ([17, 21], [14, 18]), "chr3": ([4, 34], [1, 31])}
    rows = [(c, "+", p) for c, (plus, _) in one_based.items() for p in plus] + [(c, "-", p - 1) for c, (_, minus) in one_based.items() for p in minus]
    sites = spark.createDataFrame(rows, "contig string, strand string, pos long")
    reads = [("chr1", 3, 12, "+"), ("chr1", 4, 13, "+"), ("chr3", 25, 34, "+"), ("chr1", 18, 27, "+"), ("chr4", 10, 19, "+"), ("chr2", 18, 27, "-"), ("chr2", 17, 26, "-"), ("chr3", 1, 10, "-"), ("chr2", 13, 22, "-"), ("chr4", 10, 19, "-")]
    want = [(10, 8), (24, 21), (32, 8), None, None, (20, 8), (16, 11), (3, 8), None, None]
    df = spark.createDataFrame([(i, c, s - 1, e, d) for i, (c, s, e, d) in enumerate(reads)], "i int, contig string, start long, end long, strand string")
    got = {r["i"]: (r["centre"], r["distance"]) for r in ct.next_site(df, sites, 4, chunk=8).collect()}
    for i, w in enumerate(want):
        assert got[i] == ((None, None) if w is None else (w[0] - 1, w[1]))
    pairs = spark.createDataFrame([("chr1", 9, 8, "chr1", 23, 21), ("chr1", 9, 8, "chr2", 19, 8), ("chr1", 9, 8, "chr3", None, None), ("chr3", 31, 8, "chr3", 2, 8)], "contig1 string, centre1 long, distance1 long, contig2 string, centre2 long, distance2 long")
    assert [(r["outcome"], r["ligation_distance"]) for r in ct.ligations(pairs, 20).collect()] == [("distant", 14), ("inter", None), ("none", None), ("intra", 29)]


MATRIX_1 = np.full((9, 9), 0.125)
MATRIX_1[4, :] = MATRIX_1[:, 4] = 0


def cells_of(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m)) if m[i, j]], "i long, j long, value double")


def test_directionality(spark):
    contigs = ["chr1"] * 3 + ["chr2"] * 5 + ["chr3"]
    bins = spark.createDataFrame([(i, c, 0, 1) for i, c in enumerate(contigs)], "bin long, contig string, start long, end long")
    rows = ct.directionality(cells_of(spark, MATRIX_1), bins).orderBy("bin").collect()
    assert [r["up"] for r in rows] == [0, 0.125, 0.25, 0, None, 0.125, 0.25, 0.375, 0]
    assert [r["down"] for r in rows] == [0.25, 0.125, 0, 0.375, None, 0.25, 0.125, 0, 0]
    assert [r["inter"] for r in rows] == [0.625] * 3 + [0.5, None] + [0.5] * 3 + [0.875]
    assert [r["log2"] for r in rows] == [None, 0, None, None, None, 0, 0, None, None]
    two = np.array([[0.2, 0.2, 0.1, 0.2, 0.3], [0.4, 0.1, 0.2, 0.2, 0.1], [0.1, 0.1, 0.4, 0.1, 0.3], [0.2] * 5, [0.1, 0.4, 0.1, 0.2, 0.2]])
    bins = spark.createDataFrame([(i, "c", 0, 1) for i in range(5)], "bin long, contig string, start long, end long")
    get = lambda w: [None if r["log2"] is None else round(r["log2"], 6) for r in ct.directionality(cells_of(spark, two), bins, w).orderBy("bin").collect()][:4]
    assert get(10) == [None, 1, -1, 0] and get(1) == [None, 1, 0, 0]


def test_balance(spark, tmp_path):
    rng = np.random.default_rng(0)
    m = rng.integers(1, 50, (8, 8))
    m = m + m.T
    rows = [("a", i, j, int(m[i, j])) for i in range(8) for j in range(i, 8)]
    df = spark.createDataFrame(rows, "region string, i long, j long, value long")
    got = np.zeros((8, 8))
    for r in ct.balance(df, ["region"], digits=15).collect():
        got[r["i"], r["j"]] = got[r["j"], r["i"]] = r["value"]
    assert np.allclose(got.sum(axis=0), 1, atol=1e-9)
    n = iter(range(10_000))

    def store(x):
        path = str(tmp_path / str(next(n)))
        x.write.parquet(path)
        return spark.read.parquet(path)

    large = np.zeros((8, 8))
    for r in ct.balance_large(df.drop("region"), store, deviation=1e-3).collect():
        large[r["i"], r["j"]] = large[r["j"], r["i"]] = r["value"]
    assert np.allclose(large, got, atol=1e-3)


def test_balance_of_filled_matrices(spark):
    rng = np.random.default_rng(1)
    bins, cells = {"a": range(40), "b": range(30, 55), None: range(60, 63)}, []
    for region, own in bins.items():
        for _ in range(30 if region else 0):
            i, j = sorted(rng.choice(own, 2).tolist())
            cells.append((region, i, j, int(rng.integers(1, 20))))
    cells = list({c[:3]: c for c in cells}.values())
    matrix = spark.createDataFrame(cells, "region string, i long, j long, value long")
    members = spark.createDataFrame([(r, k) for r, own in bins.items() for k in own], "region string, bin long")
    value = {c[:3]: c[3] for c in cells}
    dense = [(r, i, j, value.get((r, i, j), 0) + 1) for r, own in bins.items() for i in own for j in own if i <= j]
    want = ct.balance(spark.createDataFrame(dense, "region string, i long, j long, value long"), ["region"], digits=6)
    key = lambda r: (str(r["region"]), r["i"], r["j"])
    want = sorted(want.collect(), key=key)
    filled = ct.balance_filled(matrix, members, ["region"], digits=6, block=16)
    got = sorted(filled.collect(), key=key)
    assert filled.columns == ["region", "i", "j", "value", "bias_i", "bias_j"]
    assert [key(r) for r in got] == [key(r) for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-9)
    # the full matrix is made in the last step: no exchange has it
    assert "MapInArrow" in filled._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]


def test_quantiles_and_ratios(spark):
    rows = [(0, 0, 0.1, 0.0), (0, 1, 0.3, 10.0), (0, 2, 0.3, 20.0), (1, 0, 0.2, -10.0), (1, 1, 0.2, 0.0), (1, 2, 0.4, 10.0)]
    cells = spark.createDataFrame(rows, "i long, j long, value double, dist double")
    got = {(r["i"], r["quantile"]): r["dist"] for r in ct.distance_quantile(cells, [0.5, 0.75]).collect()}
    assert got == {(0, 0.5): 20.0, (0, 0.75): None, (1, 0.5): 10.0, (1, 0.75): 10.0}
    assert [tuple(r) for r in ct.mean_log2_ratio(cells.withColumn("s", ct.F.lit("x")), ["s"]).collect()] == [("x", 1, 1, -1.0)]
    assert ct.asymmetric_cells(cells).count() == 3
    region = spark.createDataFrame([("chr1", 0, 30, "r")], "contig string, start long, end long, region string")
    bins = spark.createDataFrame([("chr1", 0, 10, 0), ("chr1", 10, 20, 1), ("chr1", 25, 35, 2)], "contig string, start long, end long, bin long")
    members = ct.region_bins(bins, region)
    assert sorted(r["bin"] for r in members.collect()) == [0, 1]
    assert sorted((r["i"], r["j"]) for r in ct.submatrix(cells.where("i <= j"), members).collect()) == [(0, 0), (0, 1), (1, 1)]


def test_means_with_zeros_and_self_ligation(spark):
    bins = spark.createDataFrame([("c", 0, 10, 0), ("c", 10, 20, 1), ("c", 20, 30, 2), ("d", 0, 10, 3)], "contig string, start long, end long, bin long")
    half = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (1, 2, 1.0), (3, 3, 4.0)], "i long, j long, value double")
    cells = ct.with_distances(ct.mirrored(half), bins)
    got = {r["dist"]: (r["n"], r["mean"]) for r in ct.mean_by_distance_with_zeros(cells, bins, []).collect()}
    assert got == {0.0: (4, 1.5), 10.0: (4, 2.0), 20.0: (2, 0.0)}
    assert ct.self_ligation_rate(half, []).first()["rate"] == 6 / 14
