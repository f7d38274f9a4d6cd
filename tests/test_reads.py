import random

import pytest

from helixlake import schema as S
from helixlake.operators import reads as rd


def call_bases(start, cigar, seq, qual, group_del=False, ignore_indel=False):
    """Calls of one read, step by step."""
    ops = [c for c in cigar if c[0] != 5]
    at, pos = 0, start
    if ops and ops[0][0] == 4:
        at = ops.pop(0)[1]
    if ops and ops[-1][0] == 4:
        ops.pop()
    while ops and ops[0][0] in (1, 2):
        op, n = ops.pop(0)
        at, pos = at + n * (op == 1), pos + n * (op == 2)
    while ops and ops[-1][0] in (1, 2):
        ops.pop()
    out = []
    for op, n in ops:
        if op == 0:
            out += [(pos + i, seq[at + i], qual[at + i]) for i in range(n)]
            at, pos = at + n, pos + n
        elif op == 1:
            if not ignore_indel:
                held = qual[at - 1 : at + n]
                out[-1] = (out[-1][0], out[-1][1] + seq[at : at + n], sum(held) // len(held))
            at += n
        elif op == 2:
            if not ignore_indel:
                q = (qual[at - 1] + qual[at]) // 2
                out += [(pos, "-" * n, q)] if group_del else [(pos + i, "-", q) for i in range(n)]
            pos += n
        else:
            pos += n
    return out


def frame(spark, rows):
    return spark.createDataFrame([(n, 0, "c", s, [{"op": o, "len": k} for o, k in c], q, v, 30) for n, s, c, q, v in rows], "qname string, flag int, contig string, start long, cigar array<struct<op:int,len:int>>, seq string, qual array<int>, mapq int")


def calls(df, **how):
    return sorted((r["qname"], r["pos"], r["base"], r["baseq"]) for r in rd.base_calls(df, **how).collect())


SEQ = "AGCTAGTATGTA"


def test_literal_calls(spark):
    ins = [20, 21, 22, 23, 24, 27, 26, 27, 28, 29, 30, 31]
    dele = [20, 21, 22, 28, 24, 25, 26, 27, 32, 29, 30, 31]
    df = frame(spark, [("m", 10, [(0, 12)], SEQ, ins), ("i", 10, [(0, 3), (1, 2), (0, 2), (1, 2), (0, 3)], SEQ, ins), ("d", 10, [(0, 3), (2, 2), (0, 5), (2, 2), (0, 4)], SEQ, dele)])
    got = {(q, p): (b, k) for q, p, b, k in calls(df)}
    assert [got["m", 10 + i] for i in range(12)] == list(zip(SEQ, ins, strict=True))
    assert (got["i", 12], got["i", 13], got["i", 14]) == (("CTA", 23), ("G", 27), ("TAT", 27))
    assert got["d", 13] == got["d", 14] == ("-", 25) and got["d", 20] == got["d", 21] == ("-", 29)
    grouped = {(q, p): (b, k) for q, p, b, k in calls(df, group_del=True)}
    assert grouped["d", 13] == ("--", 25) and ("d", 14) not in grouped and grouped["d", 20] == ("--", 29)


@pytest.mark.parametrize("how", [{}, {"group_del": True}, {"ignore_indel": True}])
def test_calls_step_by_step(spark, how):
    rng, rows = random.Random(4), []
    for k in range(150):
        cigar = [(rng.choice([4, 5, 1, 2]), rng.randrange(1, 4))] if rng.random() < 0.4 else []
        for _ in range(rng.randrange(1, 4)):
            cigar += [(0, rng.randrange(1, 7)), (rng.choice([1, 2, 3]), rng.randrange(1, 4))]
        cigar += [(0, 3)] if rng.random() < 0.6 else []
        cigar += [(rng.choice([4, 5]), 2)] if rng.random() < 0.3 else []
        n = sum(x for o, x in cigar if o in (0, 1, 4))
        rows.append((f"r{k}", rng.randrange(50), cigar, "".join(rng.choice("ACGT") for _ in range(n)), [rng.randrange(41) for _ in range(n)]))
    want = sorted((n, *c) for n, s, cig, q, v in rows for c in call_bases(s, cig, q, v, **how))
    assert calls(frame(spark, rows), **how) == want


def test_missing_parts_have_no_calls(spark):
    df = frame(spark, [("a", 1, [], "", []), ("b", None, [(0, 1)], "A", [1]), ("c", 1, [(0, 1)], None, [3])])
    assert calls(df) == []


PAIRS = {
    1: ("chr1", 1, 40, "+", "chr1", 1960, 2000, "-"), 2: ("chr1", 1, 40, "+", "chr1", 1959, 2001, "-"), 3: ("chr1", 1, 40, "+", "chr2", 1959, 1999, "-"),
    4: ("chr1", 1, 40, "+", "chr1", 1959, 1999, "+"), 5: ("chr1", 100, 140, "-", "chr1", 100, 140, "+"), 6: ("chr1", 100, 140, "-", "chr1", 90, 130, "+"),
    7: ("chr1", 100, 140, "-", "chr1", 90, 141, "+"), 8: ("chr1", 99, 140, "-", "chr1", 100, 130, "+"),
}


def pair_frame(spark, ids):
    rows = [(i, *(x - 1 if k in (1, 5) else x for k, x in enumerate(PAIRS[i]))) for i in ids]
    return spark.createDataFrame(rows, "i int, contig1 string, start1 long, end1 long, strand1 string, contig2 string, start2 long, end2 long, strand2 string")


def test_concordance_and_metrics(spark):
    got = {r["i"]: r["ok"] for r in pair_frame(spark, PAIRS).withColumn("ok", rd.concordant(2000)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False, 8: False}
    stream = pair_frame(spark, [2, 3, 3, 4, 4, 4, 5, 6, 6])
    assert rd.pair_metrics(stream, 2000).first().asDict() == {"total": 9, "unique": 5, "duplicate": 4, "concord": 3, "concorduni": 2, "discord": 6, "discorduni": 3}
    assert rd.filter_pairs(stream, 2000, True, True).count() == 3
    assert rd.pair_metrics(stream.limit(0), 2000).first()["total"] == 0


def test_start_windows(spark):
    rows = [(100, 12, 131, 32, "test1", 200, 10), (100, 12, 83, 20, "test2", 200, 10), (10, 10, 3, 28, "test3", 20, 30)]
    want = [(95, 105, "test1/2", 32, "+"), (107, 117, "test2/1", 20, "-"), (0, 20, "test3", 28, "+")]
    for (s, n, flag, q, name, length, size), w in zip(rows, want, strict=True):
        df = spark.createDataFrame([(name, flag, "chr1", s, s + n, q)], "qname string, flag int, contig string, start long, end long, mapq int")
        r = rd.start_windows(df, size, spark.createDataFrame([("chr1", length)], "contig string, length long")).first()
        assert (r["start"], r["end"], r["name"], r["score"], r["strand"]) == w


def test_blocks_clipping_and_flags(spark):
    df = frame(spark, [("a", 10, [(4, 2), (0, 5), (2, 3), (0, 4), (1, 2), (0, 1)], "A" * 14, [1] * 14), ("b", 0, [(0, 5), (4, 1)], "A" * 6, [1] * 6)])
    assert sorted((r["qname"], r["start"], r["end"]) for r in rd.blocks(df).collect()) == [("a", 10, 15), ("a", 18, 22), ("a", 22, 23), ("b", 0, 5)]
    assert {r["qname"]: r["c"] for r in df.select("qname", rd.start_clipped().alias("c")).collect()} == {"a": True, "b": False}
    flags = spark.createDataFrame([(f,) for f in (3, 7, 259, 515, 1027, 2051, 1)], "flag int")
    assert [r["flag"] for r in flags.where(rd.flag_filter()).collect()] == [3]
    assert [r["flag"] for r in flags.where(rd.flag_filter(duplicate=True, properpair=False)).collect()] == [3, 1027, 1]
    assert S.CIGAR_OPS[4] == "S"


def test_calls_at_positions_leave_far_reads_out_before_calls_are_made(spark):
    w = rd.STRETCH
    spans = [("c", 0, 5), ("c", w - 3, w + 3), ("c", w - 2, 3 * w + 2), ("c", 9 * w, 9 * w + 4), ("d", 2, 4), ("c", 5 * w, 5 * w + 1)]
    reads = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "qname long, contig string, start long, end long")
    positions = spark.createDataFrame([("c", w + 1), ("c", 2 * w), ("c", w + 1), ("c", 5 * w), ("e", 1), ("c", None), (None, 2)], "contig string, pos long")
    near = rd.reads_at(reads, positions)
    assert near.columns == reads.columns
    assert sorted(r["qname"] for r in near.collect()) == [1, 2, 5]
    calls = spark.createDataFrame([("c", 5, "A", 30, 10, 0)] * 3 + [("c", 5, "A", 20, 10, 16), ("c", 5, "T", 7, 8, 0), ("c", 6, "A", 9, 9, 0)], "contig string, pos long, base string, baseq int, mapq int, flag int")
    want = {("c", 5, "A"): [(20, 10, "-"), (30, 10, "+"), (30, 10, "+"), (30, 10, "+")], ("c", 5, "T"): [(7, 8, "+")], ("c", 6, "A"): [(9, 9, "+")]}
    told = lambda df: {(r["contig"], r["pos"], r["base"]): [tuple(o) for o in r["observations"]] for r in df.collect()}
    assert told(rd.position_calls(calls)) == want
    at = spark.createDataFrame([("c", 5), ("c", 5), ("x", 6)], "contig string, pos long")
    assert told(rd.position_calls(calls, at)) == {k: v for k, v in want.items() if k[1] == 5}
