"""Readers of tabular formats: GTF, GMT, OBO, GAF, BED, matrices, results, name tables.

They are plain text and CSV scans, so they split, push down and read whatever
path Spark reads.  Missing values become null where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake import schema as S


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where((F.length("value") > 0) & ~F.col("value").startswith("#"))


def _attributes(column: Column) -> Column:
    """``key value;`` or ``key=value;`` pairs as a map; of a repeated key the first value stays."""
    parts = F.filter(F.transform(F.split(column, ";"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    pair = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([^ =]+)", 1).alias("k"), F.regexp_replace(F.regexp_replace(p, r"^[^ =]+[ =]?", ""), '^"|"$', "").alias("v")))
    unique = F.filter(pair, lambda x, i: F.array_position(F.transform(pair, lambda y: y["k"]), x["k"]) == i + 1)
    return F.map_from_entries(unique)


def read_gtf(spark: SparkSession, path: str, fixed_width: bool = True, prefix: str = "") -> DataFrame:
    """A GTF or GFF file as ``schema.GTF``, 0-based; ``fixed_width`` fails on rows without nine columns, else they go."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).select("value", f.alias("f"))
    nine = F.size("f") == 9
    rows = rows.where(F.when(nine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not nine columns: "), F.col("value"))).cast("boolean"))) if fixed_width else rows.where(nine)
    text = lambda i: F.when(F.col("f")[i] != ".", F.col("f")[i])
    return rows.select(
        F.concat(F.lit(prefix), F.col("f")[0]).alias("contig"), F.col("f")[1].alias("source"), F.col("f")[2].alias("feature"), S.from_closed(F.col("f")[3].cast("long")).alias("start"), F.col("f")[4].cast("long").alias("end"),
        text(5).alias("score"), F.col("f")[6].alias("strand"), text(7).alias("frame"), _attributes(F.col("f")[8]).alias("attributes"),
    )


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(term, gene) of a gene-set file, failing when it runs on a term that is defined twice differently."""
    f = F.split("value", "\t")
    sets = _lines(spark, path).select(f[0].alias("term"), F.array_sort(F.array_distinct(F.filter(F.slice(f, 3, F.size(f)), lambda g: F.length(g) > 0))).alias("genes"))
    one = sets.groupBy("term").agg(F.min("genes").alias("genes"), F.max("genes").alias("_other"))
    same = F.col("genes") == F.col("_other")
    one = one.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("term defined twice: "), F.col("term"))).cast("boolean")))
    return one.select("term", F.explode("genes").alias("gene"))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(go_id, go_name, go_domain) of the [Term] paragraphs of an ontology."""
    rows = spark.read.text(path, lineSep="\n\n").where(F.trim("value").startswith("[Term]"))
    tag = lambda t: F.regexp_extract("value", rf"(?m)^{t}:\s*(.*?)\s*$", 1)
    return rows.select(tag("id").alias("go_id"), tag("name").alias("go_name"), tag("namespace").alias("go_domain"))


def read_gaf(spark: SparkSession, path: str, evidence: list[str] | None = None) -> DataFrame:
    """Distinct (gene, go_id) of a gene association file, of the given evidence codes."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where((F.length("value") > 0) & ~F.col("value").startswith("!")).select(f[1].alias("gene"), f[4].alias("go_id"), f[6].alias("evidence"))
    rows = rows.where(F.col("evidence").isin(evidence)) if evidence else rows
    return rows.select("gene", "go_id").distinct()


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED of three to six columns as ``schema.BED``."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").rlike("^(track|browser)")).select(f.alias("f"))
    at = lambda i, kind: F.get("f", F.lit(i)).cast(kind)
    return rows.select(*[at(i, t.dataType).alias(t.name) for i, t in enumerate(S.BED.fields)])


def read_intervals(spark: SparkSession, path: str, one_based: bool = False) -> DataFrame:
    """The first three columns of a tab-separated file: contig, start, end; ``one_based`` starts count from 1."""
    f = F.split("value", "\t")
    return _lines(spark, path).select(f[0].alias("contig"), (f[1].cast("long") - int(one_based)).alias("start"), f[2].cast("long").alias("end"))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end, cov)."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").rlike("^(track|browser)"))
    return rows.select(f[0].alias("contig"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), f[3].cast("double").alias("cov"))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Two columns, contig and length, in order: ``schema.CONTIGS``.  Order is that of the lines of one file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.length(x) > 0)).alias("ordinal", "line"))
    f = F.split("line", r"\s+")
    return rows.select(f[0].alias("contig"), f[1].cast("long").alias("length"), "ordinal")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bins, cells) of dense matrix files: a header of ``contig:start-end`` names, then a row of numbers for each.

    bins: file, contig, start, end, bin; cells: file, i, j, value, zeros left
    out.  A file is read whole, since its rows have no numbers of their own.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.filter(F.split("value", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("lines"))
    names = whole.select("file", F.posexplode(F.split(F.trim(F.col("lines")[0]), r"\s+")).alias("bin", "name"))
    part = F.split("name", "[:-]")
    bins = names.select("file", part[0].alias("contig"), S.from_closed(part[1].cast("long")).alias("start"), part[2].cast("long").alias("end"), F.col("bin").cast("long").alias("bin"))
    rows = whole.select("file", F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("i", "line"))
    cells = rows.select("file", "i", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("j", "v"))
    return bins, cells.select("file", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("value")).where("value <> 0")


def matrix_file_name(name: Column) -> Column:
    """(sample, bin_size, region, min_count) of ``sample.binsize.region.mincount...`` file names."""
    f = F.split(name, r"\.")
    return F.struct(f[0].alias("sample"), f[1].alias("bin_size"), f[2].alias("region"), f[3].alias("min_count"))


def read_results(spark: SparkSession, path: str, gene: str | int, p: str | int, log2: str | int | None = None, most: float = 0.05, header: bool = True) -> DataFrame:
    """(gene, p, query) of a table of tests, with ``log2`` also the fold change.

    Columns by name or ordinal; NA and what isn't a number is null, and such rows
    go.  query: pos or neg (sig without ``log2``) where p is at most ``most``, else
    null; a significant change of 0 and a gene on two rows fail when it runs.
    """
    rows = spark.read.csv(path, sep="\t", header=header, nullValue="NA")
    at = lambda c: F.col(rows.columns[c] if isinstance(c, int) else f"`{c}`")
    out = rows.select(at(gene).alias("gene"), at(p).try_cast("double").alias("p"), *([at(log2).try_cast("double").alias("log2")] if log2 is not None else []))
    out = out.where("gene is not null and p is not null")
    hit = F.col("p") <= most
    if log2 is None:
        query = F.when(hit, F.lit("sig"))
    else:
        query = F.when(hit & (F.col("log2") > 0), "pos").when(hit & (F.col("log2") < 0), "neg").when(hit, F.raise_error(F.concat(F.lit("significant without change: "), F.col("gene"))).cast("string"))
    count = out.groupBy("gene").agg(F.count(F.lit(1)).alias("_n"))
    out = out.withColumn("query", query).join(count, "gene")
    once = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("gene on several rows: "), F.col("gene"))).cast("boolean"))
    return out.where(once).drop("_n")


def read_translation(spark: SparkSession, path: str) -> DataFrame:
    """(in_gene, out_gene) of a table of names; a line of one column has no translation."""
    f = F.split("value", "\t")
    out = F.get(f, F.lit(1))
    return _lines(spark, path).select(f[0].alias("in_gene"), F.when(F.length(out) > 0, out).alias("out_gene")).distinct()


def read_varscan(spark: SparkSession, path: str) -> DataFrame:
    """Somatic calls by ordinal: contig, pos, ref, var, read counts, status and p."""
    rows = spark.read.csv(path, sep="\t", header=True)
    c = [F.col(f"`{x}`") for x in rows.columns]
    at = lambda i, name, kind: c[i].cast(kind).alias(name)
    return rows.select(
        at(0, "contig", "string"), at(1, "pos", "long"), at(2, "ref", "string"), at(3, "var", "string"), at(4, "normal_ref", "int"), at(5, "normal_var", "int"),
        at(8, "tumour_ref", "int"), at(9, "tumour_var", "int"), at(12, "status", "string"), at(14, "p", "double"),
    )


def read_sample_sheet(spark: SparkSession, path: str, required: str = "NORM") -> DataFrame:
    """(name, individual, tissue), failing when it runs on an individual without exactly one sample of tissue ``required``."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).select(f[0].alias("name"), f[1].alias("individual"), f[2].alias("tissue"))
    count = rows.groupBy("individual").agg(F.count_if(F.col("tissue") == required).alias("_n"))
    rows = rows.join(count, "individual")
    one = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no single required sample: "), F.col("individual"))).cast("boolean"))
    return rows.where(one).select("name", "individual", "tissue")


def find_fastq(spark: SparkSession, path: str, prefix: str = "", recursive: bool = True) -> DataFrame:
    """(sample, lane, read1, read2) of FASTQ files under a path: R1 and R2 paired by name, numbered fragments in order.

    Only names are read; Spark lists no empty files.  A file without a mate has a null beside it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select("path", name.alias("name")).where(F.col("name").startswith(prefix) & F.col("name").rlike(r"\.(fastq|fq)(\.gz)?$"))
    key = F.regexp_replace("name", r"_R?[12]((_\d{3})?\.(fastq|fq)(\.gz)?)$", "")
    part = F.regexp_extract("name", r"_(\d{3})\.(?:fastq|fq)", 1)
    no = F.regexp_extract("name", r"_R?([12])(?:_\d{3})?\.(?:fastq|fq)", 1)
    rows = rows.select("path", key.alias("sample"), part.alias("fragment"), no.alias("no"))
    return rows.groupBy("sample", "fragment").agg(F.max(F.when(F.col("no") != "2", F.col("path"))).alias("read1"), F.max(F.when(F.col("no") == "2", F.col("path"))).alias("read2"))


def fragment_gaps(fragments: DataFrame) -> DataFrame:
    """Samples whose fragments, numbered from 001, leave some out: (sample, fragments, last)."""
    rows = fragments.where("fragment <> ''").groupBy("sample").agg(F.count(F.lit(1)).alias("fragments"), F.max(F.col("fragment").cast("int")).alias("last"))
    return rows.where("fragments <> last")


def files_of_samples(samples: DataFrame, files: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """Each sample with the one file whose base name begins with its name, failing when it runs unless there is exactly one.

    A prefix is an equality on the first characters, one join for each length of name in use.
    """
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    lengths = [r[0] for r in samples.select(F.length(name)).distinct().limit(1001).collect()]
    if len(lengths) > 1000:
        raise ValueError("names of too many lengths")
    keyed = files.withColumn("_cut", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring(base, 1, n).alias("s")) for n in lengths]))) if lengths else files.withColumn("_cut", F.struct(F.lit(0).alias("n"), F.lit("").alias("s")))
    hits = samples.join(keyed, (F.length(name) == F.col("_cut.n")) & (F.col(name) == F.col("_cut.s")), "left").groupBy(*samples.columns).agg(F.count(path).alias("_n"), F.min(path).alias(path))
    return hits.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not exactly one file: "), F.col(name))).cast("boolean"))).drop("_n")


def read_parameters(text: str) -> dict[str, object]:
    """``key value`` lines of a parameter file; whole numbers, numbers and text are told apart.  Configuration stays on the driver."""
    out: dict[str, object] = {}
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        key, _, value = line.partition("\t") if "\t" in line else line.partition(" ")
        value = value.strip()
        for kind in (int, float, str):
            try:
                out[key] = kind(value)
                break
            except ValueError:
                continue
    return out


def read_metrics(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(file, <name>...) of log files read whole: the first group of each pattern, null where it isn't found."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    got = lambda p: F.regexp_extract("value", p, 1)
    return rows.select("file", *[F.when(F.length(got(p)) > 0, got(p)).alias(n) for n, p in patterns.items()])


def read_snp_frequencies(spark: SparkSession, path: str, min_cov: int = 0) -> DataFrame:
    """(contig, pos, cov, freq) of tables with the columns SNP (``contig:pos:...``), Cov and Freq, of ``min_cov`` or more."""
    rows = spark.read.csv(path, sep="\t", header=True, nullValue="NA")
    part = F.split("SNP", ":")
    out = rows.select(part[0].alias("contig"), part[1].cast("long").alias("pos"), F.col("Cov").try_cast("int").alias("cov"), F.col("Freq").try_cast("double").alias("freq"))
    return out.where(F.col("cov") >= min_cov)


def file_of(rows: DataFrame) -> DataFrame:
    """Rows of a file scan with ``file``, the base name each came from."""
    return rows.withColumn("file", F.col("_metadata.file_name"))
