import random

import pytest

from helixlake.operators import intervals as iv

SET_A = [(30, 50, "A"), (35, 55, "B"), (40, 60, "C"), (45, 65, "D"), (50, 70, "E"), (55, 75, "F"), (60, 80, "G"), (65, 85, "H"), (70, 90, "I"), (30, 30, "J"), (60, 60, "K"), (90, 90, "L")]


@pytest.fixture(scope="module")
def set_a(spark):
    return spark.createDataFrame([("chr1", *r) for r in SET_A], "contig string, start long, end long, name string")


@pytest.mark.parametrize("bucket,levels", [(4096, 1), (8, 1), (2, 3), (1, 2)])
def test_overlaps_of_set_a(spark, set_a, bucket, levels):
    want = {(50, 70): "BCDEFKGH", (49, 71): "ABCDEFKGHI", (30, 90): "ABCDEFKGHI", (29, 91): "ABCDEFGHIJKL", (60, 60): "DEF", (60, 61): "DEFG", (59, 60): "CDEF", (59, 61): "CDEFKG"}
    q = spark.createDataFrame([("chr1", a, b) for a, b in want], "contig string, start long, end long")
    got = {}
    for r in iv.overlap_join(q, set_a, bucket=bucket, levels=levels).collect():
        got.setdefault((r["start"], r["end"]), []).append(r["name"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_nearest_of_set_a(spark, set_a):
    for fn, cases in ((iv.nearest_left, {(100, 10): "IL", (100, 9): "", (60, 10): "CK", (61, 0): "", (59, 10): "B"}), (iv.nearest_right, {(20, 10): "JA", (20, 9): "", (60, 10): "KG", (59, 0): "", (61, 10): "H"})):
        for (pos, most), want in cases.items():
            q = spark.createDataFrame([("chr1", pos)], "contig string, pos long")
            assert sorted(r["name"] for r in fn(q, set_a, most=most, chunk=16).collect()) == sorted(want), (fn, pos, most)


SET_B = [(30, 49, ".", 1), (30, 50, "+", 2), (35, 55, "-", 3), (40, 60, ".", 4), (45, 65, "+", 5), (50, 70, "-", 6), (55, 75, ".", 7), (60, 80, "+", 8), (65, 85, "-", 9), (70, 90, ".", 10), (71, 90, "+", 11)]


def test_stranded_set_b(spark):
    b = spark.createDataFrame([("chr1", *r) for r in SET_B], "contig string, start long, end long, strand string, row int")
    on = ["contig", "strand"]

    def overlap(s, e, strand):
        q = iv.stranded(spark.createDataFrame([("chr1", s, e, strand)], "contig string, start long, end long, strand string"))
        return sorted(r["row"] for r in iv.overlap_join(q, b, on).collect())

    def near(fn, pos, strand, most):
        q = iv.stranded(spark.createDataFrame([(1, "chr1", pos, strand)], "id int, contig string, pos long, strand string"))
        rows = fn(q, b, on, ["id"], most=most).collect()
        return sorted(r["row"] for r in rows), {r["distance"] for r in rows}

    assert overlap(50, 70, "*") == [3, 4, 5, 6, 7, 8, 9] and overlap(49, 72, "+") == [2, 5, 8, 11]
    assert near(iv.nearest_right, 15, "+.", 15) == ([1, 2], {15}) and near(iv.nearest_right, 15, "+-", 14) == ([], set())
    assert near(iv.nearest_right, 36, "-", 14) == ([6], {14})
    assert near(iv.nearest_left, 100, "-", 15) == ([9], {15}) and near(iv.nearest_left, 100, "-", 14) == ([], set())
    assert near(iv.nearest_left, 64, "+", 14) == ([2], {14}) and near(iv.nearest_left, 64, "+", 13) == ([], set())
    p = iv.stranded(spark.createDataFrame([("chr1", 30, "*")], "contig string, pos long, strand string"))
    assert sorted(r["row"] for r in iv.starts_at(p, b, on).collect()) == [1, 2]
    p = iv.stranded(spark.createDataFrame([("chr1", 90, "*")], "contig string, pos long, strand string"))
    assert sorted(r["row"] for r in iv.ends_at(p, b, on).collect()) == [10, 11]


def random_intervals(rng, n, span=400, longest=60):
    out = []
    for i in range(n):
        s = rng.randrange(span)
        out.append((rng.choice(["c1", "c2"]), s, s + rng.choice([0, 1, 3, rng.randrange(longest), rng.randrange(longest * 5)]), i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_join_kinds_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    a, b = random_intervals(rng, 60), random_intervals(rng, 60)
    left, right = (spark.createDataFrame(x, f"contig string, start long, end long, {n} int") for x, n in ((a, "i"), (b, "j")))
    pairs = [(x, y) for x in a for y in b if x[0] == y[0] and x[2] > y[1] and x[1] < y[2]]
    how = {"bucket": 4, "levels": 3}
    assert sorted((r["i"], r["j"]) for r in iv.overlap_join(left, right, **how).collect()) == sorted((x[3], y[3]) for x, y in pairs)
    hit = {x[3] for x, _ in pairs}
    assert sorted(r["i"] for r in iv.overlap_join(left, right, how="left_semi", **how).collect()) == sorted(hit)
    assert sorted(r["i"] for r in iv.overlap_join(left, right, how="left_anti", **how).collect()) == sorted(set(range(60)) - hit)
    assert sorted((r["i"], -1 if r["j"] is None else r["j"]) for r in iv.overlap_join(left, right, how="left", **how).collect()) == sorted([(x[3], y[3]) for x, y in pairs] + [(i, -1) for i in set(range(60)) - hit])
    first = {x[3]: min((y[1], y[2], y[3]) for z, y in pairs if z == x)[2] for x, _ in pairs}
    assert {r["i"]: r["j"] for r in iv.overlap_join(left, right, how="first", **how).collect()} == first


@pytest.mark.parametrize("gap", [1, 0, -5, 4])
def test_merge_coverage_and_neighbours(spark, gap):
    rng = random.Random(gap)
    rows = random_intervals(rng, 80)
    df = spark.createDataFrame(rows, "contig string, start long, end long, i int")
    want = []
    for c in ("c1", "c2"):
        reach = None
        for s, e in sorted((s, e) for k, s, e, _ in rows if k == c):
            if reach is None or reach - s < gap:
                want.append([c, s, e, 1])
                reach = e
            else:
                reach = max(reach, e)
                want[-1][2:] = reach, want[-1][3] + 1
    got = sorted([r["contig"], r["start"], r["end"], r["n_merged"]] for r in iv.merge_intervals(df, min_overlap=gap, chunk=16).collect())
    assert got == sorted(want)
    depth = {(c, p): sum(k == c and s <= p < e for k, s, e, _ in rows) for c in ("c1", "c2") for p in range(1000)}
    runs = iv.coverage(df, zero=True, lengths=spark.createDataFrame([("c1", 1000), ("c2", 1000)], "contig string, length long"), chunk=16).collect()
    assert {(r["contig"], p): r["cov"] for r in runs for p in range(r["start"], r["end"])} == depth
    pos = spark.createDataFrame([(c, s) for c, s, _, _ in rows], "contig string, pos long")
    near = sorted((r["contig"], r["pos"], r["neighbours"]) for r in iv.ordered.neighbour_count(pos, ["contig"], "pos", 7, "neighbours", 16).collect())
    assert near == sorted((c, s, sum(k == c and abs(s - t) <= 7 for k, t, _, _ in rows) - 1) for c, s, _, _ in rows)


def test_bins(spark):
    def starts(length, size, equal):
        c = spark.createDataFrame([("ref", length)], "contig string, length long")
        rows = sorted((r["start"], r["end"]) for r in iv.bins(c, size, equal).collect())
        return [s for s, _ in rows], rows

    assert starts(70, 9, True)[0] == [3, 12, 21, 30, 39, 48, 57] and starts(70, 71, True)[0] == []
    assert starts(70, 9, False)[0] == [0, 9, 18, 27, 36, 45, 54, 62] and starts(70, 20, False)[0] == [0, 18, 36, 53]
    assert starts(70, 71, False)[1] == [(0, 70)]
    assert starts(46, 10, False)[0] == [0, 10, 19, 28, 37] and starts(33, 10, False)[0] == [0, 9, 17, 25]
    assert starts(46, 10, True)[0] == [3, 13, 23, 33] and starts(33, 10, True)[0] == [1, 11, 21] and starts(46, 41, True)[0] == [2]


def test_points_in_bins(spark):
    b = spark.createDataFrame([("chr1", 9, 20, 0), ("chr1", 29, 40, 1), ("chr2", 4, 15, 2)], "contig string, start long, end long, bin long")
    p = spark.createDataFrame([("chr1", x - 1) for x in (10, 9, 20, 21, 40)] + [("chr3", 5)], "contig string, pos long")
    got = {(r["contig"], r["pos"] + 1): (r["bin"], r["outcome"]) for r in iv.bin_of_points(p, b).collect()}
    assert got == {("chr1", 10): (0, "found"), ("chr1", 9): (None, "nobin"), ("chr1", 20): (0, "found"), ("chr1", 21): (None, "nobin"), ("chr1", 40): (1, "found"), ("chr3", 6): (None, "nochr")}


def test_histogram_shape(spark):
    counts = spark.createDataFrame([(0, 12), (1, 20), (2, 10), (3, 17), (4, 11)], "cov long, bases long")
    got = [round(r["fraction"], 4) for r in iv.coverage_histogram(counts, 5).orderBy("cov").collect()]
    assert got == [1.0, 0.8286, 0.5429, 0.4, 0.1571, 0.0]


def test_validity_tiles_and_arms(spark):
    contigs = spark.createDataFrame([("a", 100)], "contig string, length long")
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 5), ("a", 90, 101), ("b", 0, 1), ("a", None, 3)], "contig string, start long, end long")
    got = [r["problem"] for r in iv.check_intervals(df, contigs).collect()]
    assert sorted(map(str, got)) == sorted(["None", "empty", "outside contig", "unknown contig", "missing bound"])
    with pytest.raises(Exception, match="invalid interval"):
        iv.require_valid(df, contigs).collect()
    region = spark.createDataFrame([("a", 10, 40)], "contig string, start long, end long")
    assert [(r["start"], r["end"]) for r in iv.tile(region, 10).collect()] == [(10, 20), (20, 30), (30, 40)]
    assert [(r["start"], r["end"]) for r in iv.tile(region, 12, 3).collect()] == [(10, 22), (19, 31), (28, 40)]
    with pytest.raises(Exception, match="span"):
        iv.tile(region, 11).collect()
    arms = iv.chromosome_arms(contigs, spark.createDataFrame([("a", 30, 40)], "contig string, start long, end long"), named=True)
    assert sorted(map(tuple, arms.collect())) == [("a", 0, 30, "a_ArmL"), ("a", 40, 100, "a_ArmR")]
    assert [r["independent"] for r in iv.independent(region).collect()] == [True]


def test_order_sets_and_samples(spark):
    df = spark.createDataFrame([("b", 5, 6), ("a", 9, 10), ("a", 1, 3), ("a", 1, 2)], "contig string, start long, end long")
    assert [tuple(r) for r in iv.sorted_by_place(df, 2).collect()] == [("a", 1, 2), ("a", 1, 3), ("a", 9, 10), ("b", 5, 6)]
    assert sorted((r["contig"], r["index"], r["end"]) for r in iv.numbered(df, chunk=4).collect()) == [("a", 0, 2), ("a", 1, 3), ("a", 2, 10), ("b", 0, 6)]
    wide = spark.createDataFrame([(1, 5.0, 7.0), (2, 1.0, 9.0), (3, None, 9.0)], "id int, s double, t double")
    assert [r["id"] for r in iv.covered_in_all(wide, ["s", "t"], 2).collect()] == [1]
    assert iv.union_distinct(df, df).count() == 4
    assert iv.require_subset(df, df, ["contig"]).count() == 4
    with pytest.raises(Exception, match="not in the whole"):
        iv.require_subset(df, df.where("contig = 'a'"), ["contig"]).collect()
    with pytest.raises(Exception, match="in both"):
        iv.require_disjoint(df, df, ["contig"]).collect()
