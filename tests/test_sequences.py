import re

import pytest

from helixlake.operators import sequences as sq


def test_sites(spark):
    # 34 bases each, sites as counted from 1: chr1 + 12, 26 and - 9, 23; chr2 + 17, 21 and - 14, 18; chr3 + 4, 34 and - 1, 31; chr4 none
    def contig(starts):
        s = ["T"] * 34
        for a in starts:
            s[a - 1 : a + 3] = "GaTC"
        return "".join(s)

    rows = spark.createDataFrame([("chr1", contig([9, 23])), ("chr2", contig([14, 18])), ("chr3", contig([1, 31])), ("chr4", contig([]))], "contig string, seq string")
    got = sorted(map(tuple, sq.restriction_sites(rows, "gatc").collect()))
    want = [(c, "+", p) for c, ps in (("chr1", [12, 26]), ("chr2", [17, 21]), ("chr3", [4, 34])) for p in ps] + [(c, "-", p - 1) for c, ps in (("chr1", [9, 23]), ("chr2", [14, 18]), ("chr3", [1, 31])) for p in ps]
    assert got == sorted(want)


@pytest.mark.parametrize("motif", ["AA", "ANA", "GATC", "RY"])
def test_motifs_by_regex(spark, motif):
    texts = ["AAAA", "", "GATCGATC", "aacgtNNagatc", "AGATCAAATTTAGA", "A"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, seq string")
    got = sorted((r["i"], r["at"]) for r in sq.find_motif(rows, motif).collect())
    assert got == [(i, m.start()) for i, t in enumerate(texts) for m in re.finditer(f"(?={sq.motif_pattern(motif)})", t.upper())]


def test_small_functions(spark):
    row = spark.createDataFrame([("ACGTNacgt", "TT")], "seq string, ins string").select(sq.reverse_complement("seq").alias("rc"), sq.wrap("seq", 4).alias("w"), sq.splice("seq", "ins", 2, 5).alias("s")).first()
    assert row["rc"] == "acgtNACGT" and row["w"] == "ACGT\nNacg\nt" and tuple(row["s"]) == ("ACTTacgt", "GTN")
    t = spark.createDataFrame([("r1 2:N:0", ), ("r2",), ("r3 x",)], "title string").select(sq.title().alias("t")).collect()
    assert [tuple(r["t"]) for r in t] == [("r1", "2:N:0", 2), ("r2", None, None), ("r3", "x", None)]


def test_subsequences_over_chunks(spark):
    seq = "ACGTTGCAACGGATCCATTG"
    chunks = sq.chunked(spark.createDataFrame([("c", seq), ("d", "aa")], "contig string, seq string"), 6)
    regions = spark.createDataFrame([("c", a, b) for a in range(20) for b in range(a + 1, 21)], "contig string, start long, end long")
    assert all(r["seq"] == seq[r["start"] : r["end"]] for r in sq.subsequences(regions, chunks, 6).collect())


def test_pairs(spark):
    first = spark.createDataFrame([(0, "a", "ACGTACGTAA", "I" * 10), (1, "b", "GGGGGATCCC", "J" * 10), (2, "c", "GATCAA", "K" * 6)], "k int, name string, seq string, qual string")
    second = spark.createDataFrame([(0, "a", "TTTTTTTTTT", "I" * 10), (1, "b", "CCCCCCCCCC", "J" * 10), (2, "c", "AAAAAAAAAA", "K" * 10)], "k int, name string, seq string, qual string")
    both = sq.mates(first, second, ["k"])
    assert sq.name_check(both).first().asDict() == {"pairs": 3, "mismatches": 0, "unpaired": 0}
    assert sq.trim_counts(both, "GATC", 5).first().asDict() == {"total": 3, "trim1": 2, "trim2": 0, "short": 1}
    got = sorted((r["k"], r["read_no"], r["name"], r["seq"], r["qual"]) for r in sq.interleave(both, ["k"], "GATC", 5).collect())
    assert got == [(0, 1, "a:1", "ACGTACGTAA", "I" * 10), (0, 2, "a:2", "T" * 10, "I" * 10), (1, 1, "b:1", "GGGGGATC", "J" * 8), (1, 2, "b:2", "C" * 10, "J" * 10)]
    with pytest.raises(Exception, match="names differ"):
        sq.require_paired(sq.mates(first, second.where("k < 2"), ["k"])).collect()
    some = sq.sample(first, 2, ["k"]).collect()
    assert len(some) == 2 and some == sq.sample(first.repartition(3), 2, ["k"]).collect()
    top = {r["start"]: (r["n"], round(r["ratio"], 4)) for r in sq.common_starts(first, 1, 1).collect()}
    assert top == {"G": (2, 0.6667), "other": (1, 0.3333)}
    refs = spark.createDataFrame([("x", "ACGTACGTCC"), ("y", "TTTT")], "name string, seq string")
    best = sq.best_matches(first.where("k = 0").select(sq.F.col("seq").alias("query")), refs).collect()
    assert [tuple(r) for r in best] == [("ACGTACGTAA", "x", 80.0)]
    q = {r["cycle"]: (r["n"], r["mean_quality"]) for r in sq.cycle_quality(first).collect()}
    assert q[1] == (3, 41.0) and q[10] == (2, 40.5)
