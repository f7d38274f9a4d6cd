"""Annotation: transcription starts, exons, name maps and gene-set enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.functions import stats
from helixlake.operators.intervals import overlap_join

# ---------------------------------------------------------------- features of a GTF


def attribute(name: str) -> Column:
    return F.col("attributes")[name]


def filter_gtf(gtf: DataFrame, contigs: DataFrame, feature: str = "exon") -> DataFrame:
    """Rows of one feature on known contigs."""
    return gtf.where(F.col("feature") == feature).join(contigs.select("contig"), "contig", "left_semi")


def filter_gtf_counts(gtf: DataFrame, contigs: DataFrame, feature: str = "exon") -> DataFrame:
    """One row: total, unknown_contig, other_feature, accepted."""
    known = contigs.select("contig", F.lit(True).alias("_known")).distinct()
    rows = gtf.join(known, "contig", "left")
    bad, other = F.col("_known").isNull(), F.coalesce(F.col("feature") != feature, F.lit(True))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("unknown_contig"), F.count_if(~bad & other).alias("other_feature"), F.count_if(~bad & ~other).alias("accepted"))


def tss(gtf: DataFrame, identifier: Column, feature: str = "exon", skip_ambiguous: bool = False) -> DataFrame:
    """(id, contig, strand, tss): per id, the least start (+) or greatest end (-) of its features.

    An id on several contigs or strands fails when it runs, or is left out.
    """
    rows = gtf.where(F.col("feature") == feature).select(identifier.alias("id"), "contig", "strand", "start", "end").where("id is not null")
    each = rows.groupBy("id").agg(F.min("contig").alias("contig"), F.max("contig").alias("_c"), F.min("strand").alias("strand"), F.max("strand").alias("_s"), F.min("start").alias("_start"), F.max("end").alias("_end"))
    one = (F.col("contig") == F.col("_c")) & (F.col("strand") == F.col("_s"))
    if not skip_ambiguous:
        one = F.when(one, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("several contigs or strands: "), F.col("id").cast("string"))).cast("boolean"))
    return each.where(one).select("id", "contig", "strand", F.when(F.col("strand") == "-", F.col("_end")).otherwise(F.col("_start")).alias("tss"))


def tss_bed(gtf: DataFrame, source: str | None = None) -> DataFrame:
    """BED6 of first exons' first bases; the name is the transcript's."""
    rows = gtf.where((F.col("feature") == "exon") & (attribute("exon_number") == "1"))
    rows = rows.where(F.col("source") == source) if source else rows
    minus = F.col("strand") == "-"
    return rows.select("contig", F.when(minus, F.col("end") - 1).otherwise(F.col("start")).alias("start"), F.when(minus, F.col("end")).otherwise(F.col("start") + 1).alias("end"), attribute("transcript_id").alias("name"), F.lit(0).alias("score"), "strand")


def exon_bed(gtf: DataFrame, key: str, value: str, source: str | None = None) -> DataFrame:
    """BED6 of the exons of a gene, transcript or name; named transcript_exon_number_source."""
    rows = gtf.where((F.col("feature") == "exon") & (attribute(key) == value))
    rows = rows.where(F.col("source") == source) if source else rows
    name = F.concat_ws("_", attribute("transcript_id"), F.lit("exon"), attribute("exon_number"), F.col("source"))
    return rows.select("contig", "start", "end", name.alias("name"), F.lit(0).alias("score"), "strand")


def name_map(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, values): the distinct values of each key, in order; an empty list if it has none."""
    return rows.select(key.alias("key"), value.alias("value")).where("key is not null").groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def name_map_counts(mapped: DataFrame) -> DataFrame:
    """(size, keys): how many keys have how many values."""
    return mapped.groupBy(F.size("values").alias("size")).agg(F.count(F.lit(1)).alias("keys"))


def transcript_parents(gtf: DataFrame, transcript_types: list[str]) -> DataFrame:
    """(transcript, gene, contig, strand, start, end) by the Parent attribute; genes without such transcripts have a null transcript."""
    t = gtf.where(F.col("feature").isin(transcript_types)).select(attribute("ID").alias("transcript"), attribute("Parent").alias("gene"), "contig", "strand", "start", "end")
    g = gtf.where("feature = 'gene'").select(attribute("ID").alias("gene"), F.col("contig").alias("_c"), F.col("strand").alias("_s"), F.col("start").alias("_b"), F.col("end").alias("_e"))
    both = g.join(t, "gene", "left")
    return both.select("transcript", "gene", *[F.coalesce(c, o).alias(c) for c, o in (("contig", "_c"), ("strand", "_s"), ("start", "_b"), ("end", "_e"))])


def feature_intervals(gtf: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """(class, contig, start, end, strand): features by class; a feature may be of several."""
    table = gtf.sparkSession.createDataFrame([(c, f) for c, fs in classes.items() for f in fs], "class string, feature string")
    return gtf.join(F.broadcast(table), "feature").select("class", "contig", "start", "end", "strand")


def count_genes(reads: DataFrame, exons: DataFrame, stranded: bool = False, **how) -> DataFrame:
    """(gene, n): reads whose overlapping exons all belong to one gene; others count as __ambiguous and __no_feature."""
    on = ["contig", "strand"] if stranded else ["contig"]
    spots = reads.groupBy(*on, "start", "end").agg(F.count(F.lit(1)).alias("_reads"))  # reads of one place count alike
    hits = overlap_join(spots, exons.select(*on, "start", "end", "gene"), on, "left", **how)
    each = hits.groupBy(*on, "start", "end", "_reads").agg(F.min("gene").alias("lo"), F.max("gene").alias("hi"))
    gene = F.when(F.col("lo").isNull(), "__no_feature").when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise("__ambiguous")
    return each.groupBy(gene.alias("gene")).agg(F.sum("_reads").alias("n"))


# ---------------------------------------------------------------- translations


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(in_gene, out_genes): a to b and b to c give a to c; a key that reaches nothing keeps an empty list."""
    step = first.select("in_gene", F.col("out_gene").alias("_mid")).join(second.select(F.col("in_gene").alias("_mid"), "out_gene"), "_mid", "left")
    return step.groupBy("in_gene").agg(F.array_sort(F.collect_set("out_gene")).alias("out_genes"))


def replace_names(rows: DataFrame, gene: str, translation: DataFrame, drop_ambiguous: bool = True) -> DataFrame:
    """Rows with ``gene`` translated; keys without a translation go.

    ``drop_ambiguous`` leaves out genes with several translations and
    translations that several rows reach.
    """
    pairs = translation.where("out_gene is not null").select("in_gene", "out_gene").distinct()
    if drop_ambiguous:
        single = pairs.groupBy("in_gene").agg(F.count(F.lit(1)).alias("_n"), F.min("out_gene").alias("out_gene")).where("_n = 1").drop("_n")
        out = rows.join(single, rows[gene] == single["in_gene"])
        reached = out.groupBy("out_gene").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("out_gene")
        out = out.join(reached, "out_gene", "left_semi")
    else:
        out = rows.join(pairs, rows[gene] == pairs["in_gene"])
    return out.select([F.col("out_gene").alias(c) if c == gene else F.col(c) for c in rows.columns])


# ---------------------------------------------------------------- enrichment


def enrichment(genes: DataFrame, sets: DataFrame, min_size: int = 5, max_size: int = 500, min_hits: int = 3, annotated_only: bool = True, keep_filtered: bool = False, combined: str | None = None, legacy_size_filter: bool = False) -> DataFrame:
    """Hypergeometric enrichment of each (term, query): background, drawn, size, hits, p, fdr.

    ``genes`` (gene, query) has every background gene, with the query (pos, neg,
    sig, ...) it belongs to or null; ``sets`` is (term, gene).  ``drawn`` counts a query's
    genes, ``size`` a term's, ``hits`` those of both; p = P(X >= hits).
    Terms outside the sizes or with fewer than ``min_hits`` hits go, or, with
    ``keep_filtered``, have a null p.  ``combined`` names one more query, the union
    of all.  ``legacy_size_filter`` lets any size pass.
    """
    back = genes.select("gene").distinct()
    members = sets.select("term", "gene").where("term is not null").distinct()
    if annotated_only:
        back = back.join(members.select("gene").distinct(), "gene", "left_semi")
    asked = genes.where("query is not null").select("gene", "query").distinct().join(back, "gene", "left_semi")
    if combined:
        asked = asked.unionByName(asked.select("gene", F.lit(combined).alias("query")).distinct())
    inside = members.join(back, "gene", "left_semi")
    total = back.agg(F.count(F.lit(1)).alias("background"))
    drawn = asked.groupBy("query").agg(F.count(F.lit(1)).alias("drawn"))
    sizes = inside.groupBy("term").agg(F.count(F.lit(1)).alias("size"))
    hits = inside.join(asked, "gene").groupBy("term", "query").agg(F.count(F.lit(1)).alias("hits"))
    # every term by each query: the result's own size
    grid = sizes.crossJoin(F.broadcast(drawn)).crossJoin(F.broadcast(total)).join(hits, ["term", "query"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    fits = F.col("hits") >= min_hits
    if not legacy_size_filter:
        fits = fits & F.col("size").between(min_size, max_size)
    rows = grid.withColumn("_fits", fits)
    rows = rows if keep_filtered else rows.where("_fits")
    p = stats.hypergeom_sf("background", "size", "drawn", "hits")
    rows = rows.withColumn("p", F.when(F.col("_fits"), p)).drop("_fits")
    return stats.benjamini_hochberg(rows, "p")
