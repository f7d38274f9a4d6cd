"""Sequence records: windows, motifs, trimming, pairing, sampling and prefixes."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bases that each IUPAC letter stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
_FROM, _TO = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(F.col(seq) if isinstance(seq, str) else seq, _FROM, _TO))


def reverse_complement_text(motif: str) -> str:
    return motif.translate(str.maketrans(_FROM, _TO))[::-1]


def motif_pattern(motif: str) -> str:
    """A regular expression of an IUPAC motif, in upper case."""
    return "".join(f"[{IUPAC[c]}]" if len(IUPAC[c]) > 1 else c for c in motif.upper())


def upper_ascii(seq: Column) -> Column:
    """a-z in upper case; letters that a full upper-casing would lengthen stay."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def find_motif(rows: DataFrame, motif: str, seq: str = "seq") -> DataFrame:
    """Rows with ``at``: each 0-based place where the motif begins, overlaps included, in either case.

    Places are split off at matches by native functions: the text is cut before
    each match by a zero-width lookahead, so a place is a running sum of lengths.
    """
    text = upper_ascii(F.col(seq))
    cut = F.split(text, f"(?={motif_pattern(motif)})", -1)
    sizes = F.transform(cut, F.length)
    begins = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("sum"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")),
        lambda acc: acc["out"],
    )
    # a place is a match unless it is the first and the text doesn't begin with one
    whole = F.when(text.rlike(f"^{motif_pattern(motif)}"), begins).otherwise(F.slice(begins, 2, F.greatest(F.lit(0), F.size(begins) - 1)))
    return rows.withColumn("at", F.explode(F.when(F.length(seq) > 0, whole)))


def restriction_sites(rows: DataFrame, motif: str, seq: str = "seq") -> DataFrame:
    """(contig, strand, pos) of a site's bounds, 0-based: its end on +, its start on -, both strands searched."""
    n = len(motif)
    plus = find_motif(rows, motif, seq).select("contig", F.lit("+").alias("strand"), (F.col("at") + n).cast("long").alias("pos"))
    minus = find_motif(rows, reverse_complement_text(motif), seq).select("contig", F.lit("-").alias("strand"), F.col("at").cast("long").alias("pos"))
    return plus.unionByName(minus)


def wrap(seq: Column | str, width: int = 60) -> Column:
    """Lines of ``width`` characters, without a newline at the end."""
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.regexp_replace(c, f"((?s).{{{width}}})(?=.)", "$1\n")


def splice(target: Column | str, insert: Column | str, start: int, end: int) -> Column:
    """(chimera, excised): the target with its 0-based [start, end) replaced, and what was there."""
    t = F.col(target) if isinstance(target, str) else target
    i = F.col(insert) if isinstance(insert, str) else insert
    made = F.concat(F.substring(t, 1, start), i, F.substring(t, end + 1, 2**31 - 1 - end))
    return F.struct(made.alias("chimera"), F.substring(t, start + 1, end - start).alias("excised"))


def chunked(fasta: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Whole sequences (contig, seq) as rows of ``width`` bases: contig, chunk, chunk_start, seq."""
    n = F.ceil(F.length("seq") / F.lit(width)).cast("int")
    rows = fasta.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1))))
    return rows.select("contig", "chunk", (F.col("chunk") * F.lit(width)).cast("long").alias("chunk_start"), F.substring("seq", F.col("chunk") * width + 1, F.lit(width)).alias("seq"))


def subsequences(regions: DataFrame, chunks: DataFrame, width: int = 1 << 20, upper: bool = False) -> DataFrame:
    """Regions (contig, start, end, ...) with ``seq``, put together from the chunks they touch."""
    spots = regions.select("contig", "start", "end").distinct()
    touched = spots.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / width).cast("int"), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / width).cast("int"))))
    parts = touched.join(chunks.select("contig", "chunk", "chunk_start", F.col("seq").alias("_part")), ["contig", "chunk"])
    first = F.greatest(F.col("start") - F.col("chunk_start"), F.lit(0))
    last = F.col("end") - F.col("chunk_start")
    piece = F.substring("_part", (first + 1).cast("int"), F.greatest(F.lit(0), last - first).cast("int"))
    joined = parts.groupBy("contig", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    out = regions.join(joined, ["contig", "start", "end"]).select(*regions.columns, "seq")
    return out.withColumn("seq", F.upper("seq")) if upper else out


# ---------------------------------------------------------------- pairs of FASTQ records


def title(column: str = "title") -> Column:
    """(name, description, read_no) of a FASTQ title."""
    parts = F.split(F.col(column), r"\s+", 2)
    description = F.get(parts, 1)
    number = F.regexp_extract(F.coalesce(description, F.lit("")), r"^(\d+):", 1).try_cast("int")
    return F.struct(parts[0].alias("name"), description.alias("description"), number.alias("read_no"))


def mates(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Records of two files side by side by position: the key, then name1, seq1, qual1, name2, ..., null where one ends early."""
    side = lambda df, i: df.select(*key, *[F.col(c).alias(f"{c}{i}") for c in ("name", "seq", "qual")])
    return side(first, 1).join(side(second, 2), key, "full_outer")


def name_check(paired: DataFrame) -> DataFrame:
    """One row: pairs, mismatched names, and records without a mate."""
    alone = F.col("name1").isNull() | F.col("name2").isNull()
    return paired.agg(F.count_if(~alone).alias("pairs"), F.count_if(~alone & (F.col("name1") != F.col("name2"))).alias("mismatches"), F.count_if(alone).alias("unpaired"))


def require_paired(paired: DataFrame) -> DataFrame:
    """``paired``, failing when it runs where names differ or a mate is missing."""
    fine = F.coalesce(F.col("name1") == F.col("name2"), F.lit(False))
    return paired.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("names differ: "), F.coalesce("name1", F.lit("-")), F.lit(" "), F.coalesce("name2", F.lit("-")))).cast("boolean")))


def trim_after(seq: Column, motif: str) -> Column:
    """Length to keep: up to and with the motif's first occurrence, or all."""
    at = F.instr(seq, motif)
    return F.when(at > 0, at + len(motif) - 1).otherwise(F.length(seq))


def interleave(paired: DataFrame, key: list[str], motif: str | None = None, min_length: int = 20) -> DataFrame:
    """Records of both mates, first then second, labelled :1 and :2 after the name; the key, read_no, name, seq, qual.

    With ``motif`` reads are cut after its first occurrence, and a pair goes if a
    read that was cut is shorter than ``min_length``.
    """
    rows = paired
    if motif:
        rows = rows.withColumns({f"_n{i}": trim_after(F.col(f"seq{i}"), motif) for i in (1, 2)})
        short = lambda i: (F.instr(F.col(f"seq{i}"), motif) > 0) & (F.col(f"_n{i}") < min_length)
        rows = rows.where(~(short(1) | short(2)))
        rows = rows.withColumns({f"{c}{i}": F.substring(F.col(f"{c}{i}"), F.lit(1), F.col(f"_n{i}")) for i in (1, 2) for c in ("seq", "qual")})
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("read_no"), F.concat(F.col(f"name{i}"), F.lit(f":{i}")).alias("name"), F.col(f"seq{i}").alias("seq"), F.col(f"qual{i}").alias("qual")) for i in (1, 2)]))
    return rows.select(*key, both.alias("r")).select(*key, "r.*")


def trim_counts(paired: DataFrame, motif: str, min_length: int = 20) -> DataFrame:
    """One row: total pairs, reads cut on either side, and pairs that go for being short."""
    cut = lambda i: F.instr(F.col(f"seq{i}"), motif) > 0
    short = lambda i: cut(i) & (trim_after(F.col(f"seq{i}"), motif) < min_length)
    return paired.agg(F.count(F.lit(1)).alias("total"), F.count_if(cut(1)).alias("trim1"), F.count_if(cut(2)).alias("trim2"), F.count_if(short(1) | short(2)).alias("short"))


def sample(rows: DataFrame, n: int, key: list[str], seed: int = 1234) -> DataFrame:
    """``n`` rows without replacement, the same for the same keys and seed: those of the smallest hashes."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), *key).limit(n)


def common_starts(rows: DataFrame, length: int, report: int, seq: str = "seq") -> DataFrame:
    """The ``report`` most frequent beginnings of ``length``, with their share, and a row ``other`` for the rest."""
    starts = rows.select(F.substring(seq, 1, length).alias("start")).groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = starts.orderBy(F.desc("n"), "start").limit(report)
    kept = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    rest = total.crossJoin(kept).select(F.lit("other").alias("start"), (F.col("total") - F.col("kept")).alias("n"))  # one row each
    return top.unionByName(rest).crossJoin(total).select("start", "n", F.try_divide("n", "total").alias("ratio"))  # one row of totals


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over both lengths, as percent, rounded."""
    return pd.Series([None if x is None or y is None else float(round(100 * SequenceMatcher(None, x, y).ratio())) for x, y in zip(a, b, strict=True)], dtype="float64")


def best_matches(queries: DataFrame, references: DataFrame, trim: bool = True, max_references: int = 10_000) -> DataFrame:
    """Queries (query) with the references (name, seq) of the highest matching ratio, all ties.

    The references are a stated list: they are broadcast, behind a check of their
    number.  ``trim`` cuts the longer of two to the shorter's length.
    """
    if references.limit(max_references + 1).count() > max_references:
        raise ValueError(f"more than {max_references} references")
    both = queries.crossJoin(F.broadcast(references.select("name", F.col("seq").alias("_ref"))))  # a stated list against all queries
    n = F.least(F.length("query"), F.length("_ref"))
    x, y = (F.substring("query", F.lit(1), n), F.substring("_ref", F.lit(1), n)) if trim else (F.col("query"), F.col("_ref"))
    rated = both.withColumn("ratio", matching_ratio(x, y))
    top = F.max("ratio").over(Window.partitionBy("query"))
    return rated.withColumn("_top", top).where("ratio = _top").select("query", "name", "ratio")


def cycle_quality(rows: DataFrame, seq: str = "seq", qual: str = "qual", offset: int = 33) -> DataFrame:
    """(cycle, n, mean_quality, a, c, g, t, other): quality and bases at each place of the reads."""
    place = F.explode(F.sequence(F.lit(1), F.length(seq))).alias("cycle")
    each = rows.where(F.length(seq) > 0).select(seq, qual, place)
    base = F.upper(F.substring(F.col(seq), F.col("cycle"), F.lit(1)))
    q = F.ascii(F.substring(F.col(qual), F.col("cycle"), F.lit(1))) - offset
    count = lambda c: F.count_if(base == c).alias(c.lower())
    return each.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), F.avg(q).alias("mean_quality"), *[count(c) for c in "ACGT"], F.count_if(~base.isin(*"ACGT")).alias("other"))
