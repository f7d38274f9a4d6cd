"""Sinks: FASTQ, FASTA, SAM, BED, GTF, bedGraph, gene sets, matrices and tables by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake import schema as S
from helixlake.operators.sequences import wrap


def write_fastq(rows: DataFrame, path: str, order: list[str] | None = None, gz: bool = False) -> None:
    """Records (name, seq, qual[, description]) as four-line FASTQ, in ``order`` across the part files.

    Fails when it runs on a record whose sequence and quality differ in length.
    """
    if order:
        rows = rows.orderBy(*order)
    title = F.concat(F.lit("@"), F.col("name"), F.coalesce(F.concat(F.lit(" "), F.col("description")), F.lit(""))) if "description" in rows.columns else F.concat(F.lit("@"), F.col("name"))
    fine = F.coalesce(F.length("seq") == F.length("qual"), F.lit(False))
    text = F.when(fine, F.concat_ws("\n", title, "seq", F.lit("+"), "qual")).otherwise(F.raise_error(F.concat(F.lit("lengths differ: "), F.coalesce("name", F.lit("?")))).cast("string"))
    rows.select(text.alias("value")).write.text(path, compression="gzip" if gz else "none")


def write_fasta(rows: DataFrame, path: str, width: int = 60, named: bool = False) -> None:
    """Regions (contig, start, end, seq) as FASTA with headers ``contig:start-end`` counted from 1; with ``named``, of contigs."""
    head = F.concat(F.lit(">"), F.col("contig") if named else S.bin_name("contig", "start", "end"))
    rows.select(F.concat_ws("\n", head, wrap("seq", width)).alias("value")).write.text(path)


def as_fastq(regions: DataFrame, quality: int = 30) -> DataFrame:
    """Regions with sequences as FASTQ records of one quality."""
    return regions.select(S.bin_name("contig", "start", "end").alias("name"), "seq", F.repeat(F.lit(chr(quality + 33)), F.length("seq")).alias("qual"))


def write_sam(reads: DataFrame, path: str) -> None:
    """Reads (``schema.READS``) as SAM lines without a header, positions from 1, in part files that are read side by side."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    place = lambda c: F.coalesce(F.col(c) + 1, F.lit(0)).cast("string")
    cigar = F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), F.substring(F.lit("MIDNSHP=X"), x["op"] + 1, F.lit(1)))), "")
    columns = [
        F.col("qname"), F.col("flag").cast("string"), text("contig"), place("start"), F.col("mapq").cast("string"), F.when(F.length(cigar) > 0, cigar).otherwise("*"),
        text("mate_contig"), place("mate_start"), F.lit("0"), text("seq"), F.coalesce(quality_text(F.col("qual")), F.lit("*")),
    ]
    reads.select(F.concat_ws("\t", *columns).alias("value")).write.text(path)


def write_gtf(rows: DataFrame, path: str) -> None:
    """Rows of ``schema.GTF`` as GTF lines, positions from 1, closed."""
    text = lambda c: F.coalesce(F.col(c), F.lit("."))
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit(' "'), e["value"], F.lit('";')))
    columns = [F.col("contig"), F.col("source"), F.col("feature"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), text("score"), text("strand"), text("frame"), F.array_join(pairs, " ")]
    rows.select(F.concat_ws("\t", *columns).alias("value")).write.text(path)


def write_gmt(members: DataFrame, path: str) -> None:
    """(term, gene) as one line for each term, with its name as the description."""
    rows = members.groupBy("term").agg(F.array_sort(F.collect_set(F.col("gene").cast("string"))).alias("genes"))
    rows.select(F.concat_ws("\t", "term", "term", F.array_join("genes", "\t")).alias("value")).write.text(path)


def write_matrix(cells: DataFrame, bins: DataFrame, path: str, most: int = 5000, digits: int | None = None) -> None:
    """A dense matrix of at most ``most`` bins as one file: names, then rows in order; see ``dense_rows``."""
    rows = dense_rows(cells, bins, most, digits)
    names = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "name"))), lambda x: x["name"]), "\t").alias("row")).select(F.lit(-1).cast("long").alias("bin"), "row")
    names.unionByName(rows.select("bin", "row")).coalesce(1).sortWithinPartitions("bin").select(F.col("row").alias("value")).write.text(path)


def write_tsv(rows: DataFrame, path: str, header: bool = False, gz: bool = False) -> None:
    rows.write.csv(path, sep="\t", header=header, compression="gzip" if gz else "none", emptyValue="", nullValue="NA")


def write_bed(rows: DataFrame, path: str, one_based: bool = False) -> None:
    """BED of the columns there are among contig, start, end, name, score, strand; sorted by place."""
    columns = [c for c in S.BED.names if c in rows.columns]
    out = rows.select(columns)
    out = out.withColumn("start", F.col("start") + 1) if one_based else out
    write_tsv(out.orderBy("contig", "start", "end"), path)


def write_bedgraph(runs: DataFrame, path: str, min_cov: int = 1) -> None:
    """Runs (contig, start, end, cov) of at least ``min_cov``, sorted by place."""
    write_tsv(runs.where(F.col("cov") >= min_cov).select("contig", "start", "end", "cov").orderBy("contig", "start"), path)


def dense_rows(cells: DataFrame, bins: DataFrame, most: int = 5000, digits: int | None = None) -> DataFrame:
    """(bin, name, row): the rows of a dense matrix as tab-separated text, for at most ``most`` bins.

    ``cells`` has both halves.  A row is put together from its own cells.
    """
    n = bins.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} bins; keep the matrix as cells")
    frame = bins.select(F.col("bin").alias("i"), S.bin_name("contig", "start", "end").alias("name"))
    mapped = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "value"))).alias("m"))
    value = lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))
    shown = lambda j: F.format_string(f"%.{digits}f", value(j)) if digits is not None else value(j).cast("string")
    order = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    return frame.join(mapped, "i", "left").select(F.col("i").alias("bin"), "name", F.array_join(F.transform(order, shown), "\t").alias("row"))


def write_by_key(rows: DataFrame, path: str, keys: list[str]) -> None:
    """One directory for each value of the keys."""
    rows.repartition(*keys).write.partitionBy(*keys).csv(path, sep="\t", header=True)


def contig_sizes(chunks: DataFrame) -> DataFrame:
    """(contig, length) of chunked FASTA."""
    return chunks.groupBy("contig").agg(F.sum(F.length("seq")).alias("length"))


def quality_text(qual: Column) -> Column:
    """Qualities as text, offset 33."""
    return F.array_join(F.transform(qual, lambda q: F.char(q + 33)), "")
