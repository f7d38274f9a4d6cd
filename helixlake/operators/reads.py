"""Alignments: flag filters, pairs, base calls and pileups.

Columns as in ``schema.READS``; filters are expressions, so they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake import schema as S
from helixlake.operators.intervals import overlap_join

# ---------------------------------------------------------------- filters


def flag_filter(flag: str = "flag", unmapped: bool = False, qcfail: bool = False, duplicate: bool = False, secondary: bool = False, supplementary: bool = False, properpair: bool = True) -> Column:
    """Reads to keep: each kind that isn't opted into is left out, and only proper pairs stay unless told otherwise."""
    out = (S.UNMAPPED * (not unmapped)) | (S.QC_FAIL * (not qcfail)) | (S.DUPLICATE * (not duplicate)) | (S.SECONDARY * (not secondary)) | (S.SUPPLEMENTARY * (not supplementary))
    return S.has_none(flag, out) & (S.has(flag, S.PROPER) if properpair else F.lit(True))


def coverage_filter(min_mapq: int = 0, remove_dup: bool = False, remove_secondary: bool = False, remove_supplementary: bool = False) -> Column:
    """Mapped reads that pass quality control, of ``min_mapq`` or better."""
    out = S.UNMAPPED | S.QC_FAIL | (S.DUPLICATE * remove_dup) | (S.SECONDARY * remove_secondary) | (S.SUPPLEMENTARY * remove_supplementary)
    return S.has_none("flag", out) & (F.col("mapq") >= min_mapq)


def start_clipped(cigar: str = "cigar") -> Column:
    """Is the read clipped, softly or hard, at its own first base?  A read without CIGAR is not."""
    end = F.when(S.has("flag", S.REVERSE), F.element_at(cigar, -1)).otherwise(F.element_at(cigar, 1))
    return F.coalesce((F.size(cigar) > 0) & end["op"].isin(4, 5), F.lit(False))


#: Order in which the two ATAC cascades test a read.
ATAC_ORDERS = {
    "paired": ("unmapped", "poormap", "nomate", "improper", "duplicate", "secondary", "supplement", "clipped"),
    "plain": ("duplicate", "secondary", "unmapped", "nomate", "poormap", "clipped"),
}


def atac_reason(min_mapq: int, order: str = "paired", remove_dup: bool = True, require_proper: bool = False, clipped: Column | None = None) -> Column:
    """Why a read is left out, or ``accepted``: the first test it fails.

    Improper pairs are counted apart but stay, unless ``require_proper``.
    """
    tests = {
        "unmapped": S.has("flag", S.UNMAPPED),
        "poormap": F.col("mapq") < min_mapq,
        "nomate": S.has("flag", S.MATE_UNMAPPED),
        "improper": F.lit(require_proper) & ~S.has("flag", S.PROPER),
        "duplicate": F.lit(remove_dup) & S.has("flag", S.DUPLICATE),
        "secondary": S.has("flag", S.SECONDARY),
        "supplement": S.has("flag", S.SUPPLEMENTARY),
        "clipped": clipped if clipped is not None else start_clipped(),
    }
    out = F
    for name in ATAC_ORDERS[order]:
        out = out.when(tests[name], name)
    return out.otherwise("accepted")


def atac_counts(reads: DataFrame, min_mapq: int, **how) -> DataFrame:
    """(reason, n), with the improper pairs among those that came so far."""
    told = reads.withColumn("reason", atac_reason(min_mapq, **how))
    counts = told.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    passed = ~F.col("reason").isin("unmapped", "poormap", "nomate") & ~S.has("flag", S.PROPER)
    return counts.unionByName(told.agg(F.count_if(passed).alias("n")).select(F.lit("improper_seen").alias("reason"), "n"))


def reads_in_regions_with_mates(reads: DataFrame, regions: DataFrame, **how) -> DataFrame:
    """All reads of the names of which any read overlaps a region."""
    names = overlap_join(reads.select("qname", "contig", "start", "end"), regions.select("contig", "start", "end"), **how).select("qname").distinct()
    return reads.join(names, "qname", "left_semi")


# ---------------------------------------------------------------- projections


def read_name(qname: str = "qname") -> Column:
    """The name with /1 or /2 for a read of a pair."""
    return F.concat(F.col(qname).cast("string"), F.when(S.has("flag", S.READ1), "/1").when(S.has("flag", S.READ2), "/2").otherwise(""))


def start_windows(reads: DataFrame, size: int, contigs: DataFrame) -> DataFrame:
    """A window of ``size`` around each read's own first base: contig, start, end, name, score, strand; cut at the contig's ends.  Reads that begin past the contig have none."""
    site = F.when(S.has("flag", S.REVERSE), F.col("end")).otherwise(F.col("start"))
    rows = reads.join(F.broadcast(contigs.select("contig", "length")), "contig").where(site - size // 2 < F.col("length"))  # contigs are bounded by the genome
    half = size // 2
    return rows.select(
        "contig",
        F.greatest(F.lit(0), site - half).alias("start"),
        F.least(F.col("length"), site + half).alias("end"),
        read_name().alias("name"),
        F.col("mapq").alias("score"),
        F.when(S.has("flag", S.REVERSE), "-").otherwise("+").alias("strand"),
    )


def to_bed(reads: DataFrame) -> DataFrame:
    """Mapped reads as BED6; a read that isn't the first of its pair is /2."""
    name = F.concat(F.col("qname").cast("string"), F.when(S.has("flag", S.READ1), "/1").otherwise("/2"))
    return reads.where(S.has_none("flag", S.UNMAPPED)).select("contig", "start", "end", name.alias("name"), F.col("mapq").alias("score"), F.when(S.has("flag", S.REVERSE), "-").otherwise("+").alias("strand"))


def anchor(kind: str) -> Column:
    """A read's position: refstart, refend (its last base), readstart or readend (of the read as sequenced)."""
    first, last = F.col("start"), F.col("end") - 1
    reverse = S.has("flag", S.REVERSE)
    return {"refstart": first, "refend": last, "readstart": F.when(reverse, last).otherwise(first), "readend": F.when(reverse, first).otherwise(last)}[kind]


def blocks(reads: DataFrame) -> DataFrame:
    """A row for each gap-free aligned block: the read's columns, with the block's start and end.

    M, = and X align, D and N step over the reference; others don't move on it.
    """
    moved = F.aggregate(
        "cigar",
        F.struct(F.col("start").cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("out")),
        lambda acc, c: F.struct(
            F.when(c["op"].isin(0, 2, 3, 7, 8), acc["at"] + c["len"]).otherwise(acc["at"]).alias("at"),
            F.when(c["op"].isin(0, 7, 8), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + c["len"]).alias("end"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return reads.withColumn("_b", F.explode(moved)).withColumns({"start": F.col("_b.start"), "end": F.col("_b.end")}).drop("_b")


# ---------------------------------------------------------------- pairs


def pairs_by_name(reads: DataFrame, min_mapq: int | None = None, name: Column | None = None, columns: tuple[str, ...] = ("contig", "start", "end", "strand")) -> DataFrame:
    """(name, <column>1, <column>2): the two reads of a name that has exactly two left after filters.

    The first is the one of the smaller read number (``read_no``), then flag, then place.
    """
    rows = reads.where(F.col("mapq") >= min_mapq) if min_mapq is not None else reads
    key = name if name is not None else F.col("qname")
    rows = rows.select(key.alias("name"), F.struct("read_no", "flag", *columns).alias("_r"))
    two = rows.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_a"), F.max("_r").alias("_b")).where("_n = 2")
    return two.select("name", *[F.col(f"_{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "a"), (2, "b")) for c in columns])


def pairing_counts(reads: DataFrame, min_mapq: int) -> DataFrame:
    """One row: total, secondary, unmapped, poormap, singletons, multiple and pairs, by names."""
    sec, un, poor = S.has("flag", S.SECONDARY), S.has("flag", S.UNMAPPED), F.col("mapq") < min_mapq
    alone = reads.agg(F.count(F.lit(1)).alias("total"), F.count_if(sec).alias("secondary"), F.count_if(~sec & un).alias("unmapped"), F.count_if(~sec & ~un & poor).alias("poormap"))
    families = reads.where(~sec & ~un & ~poor).groupBy("qname").agg(F.count(F.lit(1)).alias("n"))
    by_size = families.agg(F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 2).alias("multiple"), F.count_if(F.col("n") == 2).alias("pairs"))
    return alone.crossJoin(by_size)  # one row by one row


def concordant(most: int, p: str = "") -> Column:
    """Do the reads of a pair (contig1, start1, ..., strand2) face one another on one contig, within ``most``?

    Between the outermost bases there must be ``most`` or fewer, and neither
    read may reach past the other's outer end.
    """
    plus = lambda c: F.when(F.col("strand1") == "+", F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    minus = lambda c: F.when(F.col("strand1") == "+", F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
    size = minus("end") - plus("start")
    return (F.col("contig1") == F.col("contig2")) & (F.col("strand1") != F.col("strand2")) & (size <= most) & (plus("start") <= minus("start")) & (plus("end") <= minus("end"))


PAIR = ["contig1", "start1", "end1", "strand1", "contig2", "start2", "end2", "strand2"]


def pair_metrics(pairs: DataFrame, most: int) -> DataFrame:
    """One row: total, unique, duplicate, concord, concorduni, discord, discorduni."""
    distinct = pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).withColumn("ok", concordant(most))
    ok = F.col("ok")
    return distinct.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("unique"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("concord"),
        F.count_if(ok).alias("concorduni"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("discord"),
        F.count_if(~ok).alias("discorduni"),
    )


def filter_pairs(pairs: DataFrame, most: int, remove_dup: bool = False, remove_concordant: bool = False) -> DataFrame:
    """Pairs, each kept once with ``remove_dup``, without concordant ones with ``remove_concordant``."""
    rows = pairs.select(*PAIR)
    rows = rows.distinct() if remove_dup else rows
    return rows.where(~concordant(most)) if remove_concordant else rows


def pair_distances(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """Concordant pairs with ``outer`` (fragment length) and ``inner`` (gap between the reads)."""
    first, last = F.least("start1", "start2"), F.greatest("end1", "end2")
    inner = F.greatest("start1", "start2") - F.least("end1", "end2")
    rows = pairs.where(concordant(most if most is not None else 1 << 60))
    return rows.withColumns({"outer": last - first, "inner": inner})


def insert_metrics(pairs: DataFrame, most: int = 2000) -> DataFrame:
    """One row: n, mean and sample deviation of the inner distance."""
    return pair_distances(pairs, most).agg(F.count(F.lit(1)).alias("n"), F.avg("inner").alias("mean"), F.stddev_samp("inner").alias("sd"))


def mark_duplicates(reads: DataFrame) -> DataFrame:
    """Reads with ``is_dup``: not the best of those with the same 5' end and strand.

    The best has the highest mapping quality, then the smallest name.
    """
    site = F.when(S.has("flag", S.REVERSE), F.col("end")).otherwise(F.col("start"))
    rank = F.row_number().over(Window.partitionBy("contig", site, S.has("flag", S.REVERSE)).orderBy(F.desc("mapq"), "qname", "read_no", "start", "end"))
    return reads.withColumn("is_dup", rank > 1)


def strand_specificity(reads: DataFrame) -> DataFrame:
    """(kind, n) of mapped reads on sense transcripts: sense, antisense or discord.

    A first read facing a reverse mate, or a reverse second read facing a forward
    mate, is sense; the mirror of either, and a first read whose mate points the
    same way forward, is antisense; all else, and improper pairs, are discord.
    """
    bit = lambda b: S.has("flag", b)
    first, rev, mate = bit(S.READ1), bit(S.REVERSE), bit(S.MATE_REVERSE)
    kind = (
        F.when(~bit(S.PROPER), "discord")
        .when(first, F.when(rev, F.when(mate, "discord").otherwise("antisense")).otherwise(F.when(mate, "sense").otherwise("antisense")))
        .when(bit(S.READ2), F.when(rev, F.when(mate, "discord").otherwise("sense")).otherwise(F.when(mate, "antisense").otherwise("discord")))
        .otherwise("unpaired")
    )
    return reads.where(~bit(S.UNMAPPED)).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- base calls

_SEGMENTS = "cast(array() as array<struct<kind:string,pos:bigint,at:int,len:int>>)"


def _segments() -> Column:
    """Of a read, its matches (M), insertions (I) and deletions (D) in order: kind, reference position, offset in the read, length."""

    def step(acc: Column, c: Column) -> Column:
        op, n = c["op"], c["len"]
        kind = F.when(op.isin(0, 7, 8), "M").when(op == 1, "I").when(op == 2, "D")
        made = F.array(F.struct(kind.alias("kind"), acc["pos"].alias("pos"), acc["at"].alias("at"), n.alias("len")))
        return F.struct(
            F.when(op.isin(0, 2, 3, 7, 8), acc["pos"] + n).otherwise(acc["pos"]).alias("pos"),
            F.when(op.isin(0, 1, 4, 7, 8), acc["at"] + n).otherwise(acc["at"]).alias("at"),
            F.when(kind.isNotNull(), F.concat(acc["out"], made)).otherwise(acc["out"]).alias("out"),
        )

    begin = F.struct(F.col("start").cast("long").alias("pos"), F.lit(0).alias("at"), F.expr(_SEGMENTS).alias("out"))
    return F.aggregate("cigar", begin, step, lambda acc: acc["out"])


def base_calls(reads: DataFrame, group_del: bool = False, ignore_indel: bool = False, min_baseq: int = 0) -> DataFrame:
    """A row for each call of each read: the read's columns without sequence and CIGAR, and pos, base, baseq.

    Clipping is stripped and indels before the first or after the last match are
    dropped.  Inserted bases join the call before them, with the rounded-down mean
    quality of all.  A deleted base is ``-``, with the rounded-down mean quality
    of the bases beside the deletion; ``group_del`` gives one call of as many
    dashes, at the first deleted base.  With ``ignore_indel`` there are neither.
    A read without sequence, qualities or CIGAR has no calls.
    """
    rows = reads.where(F.col("start").isNotNull() & F.col("seq").isNotNull() & F.col("qual").isNotNull() & (F.size("cigar") > 0))
    rows = rows.withColumn("_s", _segments())
    kinds = F.transform("_s", lambda s: s["kind"])
    first = F.array_position(kinds, "M").cast("int")
    last = (F.size("_s") - F.array_position(F.reverse(kinds), "M") + 1).cast("int")
    rows = rows.where(first > 0).withColumn("_s", F.slice("_s", first, last - first + 1))
    rows = rows.withColumn("_p", F.explode(F.transform("_s", lambda s, i: F.struct(s.alias("s"), F.get("_s", i + 1).alias("next"))))).drop("_s")
    kind, length, at = F.col("_p.s.kind"), F.col("_p.s.len"), F.col("_p.s.at")
    rows = rows.where((kind == "M") | ((kind == "D") & F.lit(not ignore_indel)))
    calls = F.when((kind == "D") & F.lit(group_del), F.lit(1)).otherwise(length)
    rows = rows.withColumn("_n", calls).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    i = F.col("_i")
    inserted = F.lit(not ignore_indel) & (F.col("_p.next.kind") == "I") & (i == F.col("_n") - 1)
    extra = F.coalesce(F.when(inserted, F.col("_p.next.len")), F.lit(0))
    own = F.when(kind == "M", F.substring("seq", at + i + 1, F.lit(1))).when(F.lit(group_del), F.repeat(F.lit("-"), length)).otherwise(F.lit("-"))
    base = F.concat(own, F.substring("seq", F.coalesce("_p.next.at", F.lit(0)) + 1, extra))
    held = F.slice("qual", F.coalesce("_p.next.at", F.lit(1)), extra + 1)
    joined = F.floor(F.aggregate(held, F.lit(0), lambda a, q: a + q) / (extra + 1)).cast("int")
    beside = F.floor((F.get("qual", at - 1) + F.get("qual", at)) / 2).cast("int")
    baseq = F.when(extra > 0, joined).when(kind == "D", beside).otherwise(F.get("qual", at + i))
    rows = rows.withColumns({"pos": F.col("_p.s.pos") + i, "base": base, "baseq": baseq}).drop("_p", "_n", "_i", "cigar", "seq", "qual")
    return rows.where(F.col("baseq") >= min_baseq) if min_baseq else rows


def call_counts(calls: DataFrame, min_mapq: int = 0, min_baseq: int = 0) -> DataFrame:
    """(contig, pos, base, n, n_forward, mean_mapq) over calls."""
    rows = calls.where((F.col("mapq") >= min_mapq) & (F.col("baseq") >= min_baseq))
    return rows.groupBy("contig", "pos", "base").agg(F.count(F.lit(1)).alias("n"), F.count_if(S.has_none("flag", S.REVERSE)).alias("n_forward"), F.avg("mapq").alias("mean_mapq"))


def position_calls(calls: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """All observations of each base at each position: (contig, pos, base, observations of baseq, mapq, strand).

    Only positions of ``at`` (contig, pos), if given.  Equal observations are
    counted before anything is shuffled or joined, and repeated at the end: a
    position's observations are one value, whose size is the depth there.
    """
    strand = F.when(S.has("flag", S.REVERSE), "-").otherwise("+")
    seen = F.struct("baseq", "mapq", strand.alias("strand"))
    counts = calls.groupBy("contig", "pos", "base", seen.alias("o")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    if at is not None:
        counts = counts.join(at.select("contig", "pos").distinct(), ["contig", "pos"], "left_semi")
    held = counts.groupBy("contig", "pos", "base").agg(F.collect_list(F.struct("o", "n")).alias("_o"))
    return held.select("contig", "pos", "base", F.array_sort(F.flatten(F.transform("_o", lambda x: F.array_repeat(x["o"], x["n"])))).alias("observations"))


#: Bases of a stretch of a contig, by which reads far from all positions are told; the stretches are bounded by the genome over it.
STRETCH = 1 << 12


def reads_at(reads: DataFrame, positions: DataFrame) -> DataFrame:
    """Reads (contig, start, end) near ``positions`` (contig, pos): each once, none that covers one is left out.

    A read is near if it touches a stretch that holds a position.  The stretches'
    numbers are broadcast, so reads aren't shuffled, and far ones make no calls.
    """
    stretch = lambda p: F.floor(p / F.lit(STRETCH)).cast("long")
    held = positions.where(F.col("pos").isNotNull()).select("contig", stretch(F.col("pos")).alias("_k")).distinct()
    held = held.withColumn("_before", F.lag("_k").over(Window.partitionBy("contig").orderBy("_k")))
    rows = reads.withColumn("_first", stretch(F.col("start")))
    rows = rows.withColumn("_k", F.explode(F.sequence("_first", stretch(F.greatest(F.col("start"), F.col("end") - 1)))))
    near = rows.join(F.broadcast(held), ["contig", "_k"])
    return near.where(F.col("_before").isNull() | (F.col("_before") < F.col("_first"))).select(*reads.columns)  # at its first such stretch


def pileup(variants: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls at the variants' positions (0-based ``pos``): an equi-join on (contig, pos), since calls are by position."""
    return variants.join(calls, ["contig", "pos"])
