"""Variants: allele normalisation, filters, counts and metrics.

``pos`` is counted from 1.  A deletion's ``var`` is as many dashes as bases are
deleted; an insertion's is the base before it and the inserted ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import stats
from helixlake.operators.ordered import neighbour_count

KEY = ["contig", "pos", "ref", "var"]


def normalise(calls: DataFrame) -> DataFrame:
    """Distinct (contig, pos, ref, var) of calls whose ``var`` lists alleles between slashes.

    ``X`` is a substitution; ``-XYZ`` deletes the bases after the position;
    ``+XYZ`` inserts them after it.
    """
    allele = calls.select("contig", F.col("pos").alias("_p"), F.col("ref").alias("_r"), F.explode(F.split("var", "/")).alias("_a"))
    bases = F.expr("substring(_a, 2)")
    gone, more = F.col("_a").startswith("-"), F.col("_a").startswith("+")
    return allele.select(
        "contig",
        F.when(gone, F.col("_p") + 1).otherwise(F.col("_p")).alias("pos"),
        F.when(gone, F.substring("_a", 2, 1)).otherwise(F.col("_r")).alias("ref"),
        F.when(gone, F.expr("repeat('-', length(_a) - 1)")).when(more, F.concat("_r", bases)).otherwise(F.col("_a")).alias("var"),
    ).distinct()


def variant_key() -> Column:
    return F.concat_ws(":", "contig", F.col("pos").cast("string"), "ref", "var")


def annotation_input(variants: DataFrame) -> DataFrame:
    """(contig, start, end, ref, var) for interval annotators: an insertion replaces 0, a deletion leaves ``-``."""
    dash, longer = F.col("var").startswith("-"), F.length("var") > 1
    return variants.select(
        "contig",
        F.col("pos").alias("start"),
        F.when(dash, F.col("pos") + F.length("var") - 1).otherwise(F.col("pos")).alias("end"),
        F.when(dash | longer, F.lit("0")).otherwise(F.col("ref")).alias("ref"),
        F.when(dash, F.lit("-")).when(longer, F.expr("substring(var, 2)")).otherwise(F.col("var")).alias("var"),
    )


def germline_filter(calls: DataFrame, min_cov: int = 10, min_var: int = 2, min_freq: float = 0.1, max_freq: float = 1.0, max_bias: float = 0.9) -> DataFrame:
    """Calls (reads1, reads2, reads2plus) of enough coverage, of a frequency in range, and not on one strand only."""
    cov = F.col("reads1") + F.col("reads2")
    freq = F.try_divide(F.col("reads2"), cov)
    return calls.where((cov >= min_cov) & (F.col("reads2") >= min_var) & freq.between(min_freq, max_freq) & (stats.strand_bias(F.col("reads2plus"), F.col("reads2")) <= max_bias))


def somatic_reasons(calls: DataFrame, others: DataFrame | None = None, min_cov_normal: int = 10, min_cov_tumour: int = 10, min_freq_tumour: float = 0.05, max_freq_normal: float = 1.0, min_var_tumour: int = 2, max_p: float = 0.05, somatic: bool = True, flank: int = 25, max_neighbours: int = 0) -> DataFrame:
    """Calls with ``neighbours`` and ``reason``: the first test failed, or accepted.

    Columns normal_ref, normal_var, tumour_ref, tumour_var, status and p.
    Neighbours are positions of the calls and of ``others`` within ``flank``,
    without the call's own.
    """
    places = calls.select("contig", "pos").distinct()
    if others is not None:
        places = places.unionByName(others.select("contig", "pos")).distinct()
    near = neighbour_count(places, ["contig"], "pos", flank, "neighbours")
    cn, ct = F.col("normal_ref") + F.col("normal_var"), F.col("tumour_ref") + F.col("tumour_var")
    reason = (
        F.when(F.lit(somatic) & (F.col("status") != "Somatic"), "status")
        .when(cn < min_cov_normal, "normal coverage")
        .when(ct < min_cov_tumour, "tumour coverage")
        .when(F.col("tumour_var") < min_var_tumour, "tumour reads")
        .when(F.try_divide(F.col("tumour_var"), ct) < min_freq_tumour, "tumour frequency")
        .when(F.try_divide(F.col("normal_var"), cn) > max_freq_normal, "normal frequency")
        .when(F.col("p") > max_p, "p-value")
        .when(F.col("neighbours") > max_neighbours, "neighbours")
        .otherwise("accepted")
    )
    return calls.join(near, ["contig", "pos"], "left").withColumn("reason", reason)


def control_test_filter(counts: DataFrame, control: str, test: str, min_cov: int = 10, max_control_freq: float = 0.01, min_test_freq: float = 0.05, min_mapq: float = 20.0) -> DataFrame:
    """Variants (KEY) of which the control sample is clean and the test sample is not; from ``allele_counts``."""
    side = lambda s, x: counts.where(F.col("sample") == s).select(*KEY, *[F.col(c).alias(f"{x}_{c}") for c in ("n_ref", "n_var", "freq", "mapq")])
    both = side(control, "control").join(side(test, "test"), KEY)
    enough = (F.col("control_n_ref") + F.col("control_n_var") >= min_cov) & (F.col("test_n_ref") + F.col("test_n_var") >= min_cov)
    return both.where(enough & (F.col("control_freq") <= max_control_freq) & (F.col("test_freq") >= min_test_freq) & (F.col("control_mapq") >= min_mapq) & (F.col("test_mapq") >= min_mapq))


def allele_counts(variants: DataFrame, calls: DataFrame, by: str = "sample", min_mapq: int = 20, min_baseq: int = 20) -> DataFrame:
    """(KEY, sample, n_ref, n_ref_forward, n_var, n_var_forward, mapq, freq) of base calls (pos 0-based) at the variants.

    ``mapq`` is the mean over calls of either allele, null without any; the
    frequency is 0 then.  Every variant has a row for every sample.
    """
    rows = calls.where((F.col("mapq") >= min_mapq) & (F.col("baseq") >= min_baseq)).select(by, "contig", (F.col("pos") + 1).alias("pos"), "base", "mapq", F.col("flag").bitwiseAND(16).alias("_rev"))
    hits = variants.select(*KEY).distinct().join(rows, ["contig", "pos"])
    ref, var, fwd = F.col("base") == F.col("ref"), F.col("base") == F.col("var"), F.col("_rev") == 0
    sums = hits.groupBy(*KEY, by).agg(F.count_if(ref).alias("n_ref"), F.count_if(ref & fwd).alias("n_ref_forward"), F.count_if(var).alias("n_var"), F.count_if(var & fwd).alias("n_var_forward"), F.avg(F.when(ref | var, F.col("mapq"))).alias("mapq"))
    grid = variants.select(*KEY).distinct().crossJoin(F.broadcast(calls.select(by).distinct()))  # variants by samples: the result's own size
    out = grid.join(sums, [*KEY, by], "left")
    counted = {c: F.coalesce(c, F.lit(0)) for c in ("n_ref", "n_ref_forward", "n_var", "n_var_forward")}
    return out.withColumns(counted).withColumn("freq", F.coalesce(F.try_divide(F.col("n_var"), F.col("n_ref") + F.col("n_var")), F.lit(0.0)))


def variant_metrics(counts: DataFrame, normal: str, by: str = "sample") -> DataFrame:
    """Counts with Fisher's p of each sample against ``normal``, and the least p of the variant.

    The alternative follows the frequencies: greater if the sample's is higher,
    less if lower, two-sided if equal.  The normal sample has no p.
    """
    base = counts.where(F.col(by) == normal).select(*KEY, F.col("n_ref").alias("_r"), F.col("n_var").alias("_v"), F.col("freq").alias("_f"))
    rows = counts.join(base, KEY)
    way = F.when(F.col("freq") > F.col("_f"), "greater").when(F.col("freq") < F.col("_f"), "less").otherwise("two-sided")
    p = F.when(F.col(by) != normal, stats.fisher_exact("n_var", "n_ref", "_v", "_r", way))
    rows = rows.withColumn("p", p).drop("_r", "_v", "_f")
    least = rows.groupBy(*KEY).agg(F.min("p").alias("min_p"))
    return rows.join(least, KEY)


def filter_metrics(metrics: DataFrame, normal: str, by: str = "sample", min_normal_cov: int = 8, min_cov: int = 10, max_normal_freq: float = 0.01, min_freq: float = 0.1, max_p: float = 0.01, min_var: int = 2, min_mapq: float = 40.0, drop_indels: bool = False) -> DataFrame:
    """Rows of variants whose normal sample passes and of which at least one other does.

    A sample that fails loses its p, and ``min_p`` is that of those that pass.
    """
    cov = F.col("n_ref") + F.col("n_var")
    clean = metrics.where((F.col(by) == normal) & (cov >= min_normal_cov) & (F.col("freq") <= max_normal_freq) & (F.col("mapq") >= min_mapq)).select(*KEY)
    rows = metrics.join(clean, KEY, "left_semi")
    if drop_indels:
        rows = rows.where((F.length("var") == 1) & (F.col("var") != "-"))
    ok = (F.col(by) != normal) & (cov >= min_cov) & (F.col("freq") >= min_freq) & (F.col("p") <= max_p) & (F.col("n_var") >= min_var) & (F.col("mapq") >= min_mapq)
    rows = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    any_ok = rows.where("_ok").groupBy(*KEY).agg(F.min("p").alias("_min"))
    out = rows.drop("min_p").join(any_ok, KEY)
    return out.withColumn("p", F.when(F.col("_ok"), F.col("p"))).withColumnRenamed("_min", "min_p").drop("_ok")


def depth_ratio(first: DataFrame, second: DataFrame, depth: str = "depth") -> DataFrame:
    """One row: total depth of the first over that of the second."""
    return first.agg(F.sum(depth).alias("_a")).crossJoin(second.agg(F.sum(depth).alias("_b"))).select(F.try_divide("_a", "_b").alias("ratio"))  # one row each


def frequency_histogram(variants: DataFrame, freq: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n): how many variants have a frequency in each of ``bins`` equal parts of 0 to 1."""
    place = F.least(F.floor(F.col(freq) * bins), F.lit(bins - 1)).cast("int")
    return variants.groupBy(*(by or []), place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


STANDARD_CONTIG = "(?i)^(chr)?([0-9]+|x|y)$"


def standard_contigs(contigs: DataFrame) -> DataFrame:
    """Numbered and sex chromosomes."""
    return contigs.where(F.col("contig").rlike(STANDARD_CONTIG))


def masked_context(variants: DataFrame, sequences: DataFrame) -> DataFrame:
    """Variants with ``low_comp``: within, if their base is soft-masked (lower case), edge, if one beside it is, or none.

    Fails when it runs if the reference base isn't the sequence's.
    """
    rows = variants.join(sequences.select("contig", F.col("seq").alias("_seq")), "contig")
    here = F.substring("_seq", F.col("pos").cast("int"), F.lit(1))
    around = F.substring("_seq", F.greatest(F.lit(1), F.col("pos") - 1).cast("int"), F.when(F.col("pos") > 1, 3).otherwise(2))
    same = F.upper(here) == F.upper("ref")
    checked = F.when(same, F.when(here.rlike("[a-z]"), "within").when(around.rlike("[a-z]"), "edge").otherwise("none")).otherwise(F.raise_error(F.concat(F.lit("reference differs at "), F.col("pos").cast("string"))).cast("string"))
    return rows.withColumn("low_comp", checked).drop("_seq")


def repeat_context(variants: DataFrame, sequences: DataFrame, flank: int = 100) -> DataFrame:
    """Indels with monomer, mono_ref and mono_var: the shortest repeating unit of the indel, and how often it stands there in a row before and after.

    Looks at most ``flank`` bases around.  Substitutions have nulls.
    """
    rows = variants.join(sequences.select("contig", F.upper("seq").alias("_seq")), "contig")
    dash = F.col("var").startswith("-")
    indel = F.when(dash, F.expr("substring(_seq, cast(pos as int), length(var))")).when(F.length("var") > 1, F.upper(F.expr("substring(var, 2)")))
    n = F.length("_indel")
    unit = F.filter(F.sequence(F.lit(1), n), lambda k: (n % k == 0) & (F.repeat(F.substring("_indel", F.lit(1), k), (n / k).cast("int")) == F.col("_indel")))[0]
    # copies in a row right of the place, which begins at the deletion or after the inserted bases' base, and left of it
    at = F.when(dash, F.col("pos") - 1).otherwise(F.col("pos")).cast("int")
    m = F.length("monomer")
    right = F.substring("_seq", F.col("_at") + 1, F.lit(flank))
    begin = F.greatest(F.lit(0), F.col("_at") - flank)
    left = F.substring("_seq", begin + 1, F.col("_at") - begin)
    run = lambda text, unit: F.coalesce(F.length(F.regexp_substr(text, F.concat(F.lit("^(?:"), unit, F.lit(")+")))), F.lit(0))
    copies = (run(right, F.col("monomer")) + run(F.reverse(left), F.reverse("monomer"))) / m
    rows = rows.withColumn("_indel", indel).withColumn("monomer", F.when(F.col("_indel").isNotNull(), F.substring("_indel", F.lit(1), unit))).withColumn("_at", at)
    rows = rows.withColumn("mono_ref", copies.cast("int"))
    change = (n / m).cast("int")
    return rows.withColumn("mono_var", F.when(dash, F.col("mono_ref") - change).otherwise(F.col("mono_ref") + change)).drop("_seq", "_indel", "_at")
