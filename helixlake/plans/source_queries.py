"""Queries that write the test tables in a file format, read them back and sum them up; and orders and set checks.

The SQL sums up the tables themselves, so a row that a sink or a source loses or
changes shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake import schema as S
from helixlake.operators import intervals as iv
from helixlake.operators import reads as rd
from helixlake.plans import bindings as b
from helixlake.sources import datasources, tables, writers
from helixlake.sources.shared import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, oracle: str, *views: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = b.sql(oracle, *views) if views else oracle


def _text(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """The path of ``rows``, a column of lines, written as text."""
    path = scratch(spark, name)
    rows.write.text(path)
    return path


def _count(*sums: str) -> list:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums]]


# ---------------------------------------------------------------- sequences and reads


def _records(s, d):
    line = b.table(s, d, "lineitem")
    n = F.col("l_quantity").cast("int")
    seq = F.substring(F.repeat(F.lit("ACGTTGCA"), 8), 1 + F.col("l_linenumber"), n)
    return line.select(F.concat_ws("_", F.lit("r"), "l_orderkey", "l_linenumber").alias("name"), F.concat((F.col("l_linenumber") % 2 + 1).cast("string"), F.lit(":N:0")).alias("description"), seq.alias("seq"), F.repeat(F.lit("I"), F.length(seq)).alias("qual"))


def _fastq(s, d, gz=False):
    datasources.register(s)
    path = scratch(s, "reads.fastq")
    writers.write_fastq(_records(s, d), path, gz=gz)
    rows = s.read.format("fastq").load(path)
    return rows.groupBy("read_no", F.length("seq").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.split("name", "_")[1].cast("long")).alias("keys"), F.min("seq").alias("first"))


_FASTQ = """WITH q AS (SELECT l_orderkey, l_linenumber % 2 + 1 AS read_no, substr(repeat('ACGTTGCA', 8), l_linenumber + 1, CAST(l_quantity AS INTEGER)) AS seq FROM lineitem)
  SELECT read_no, length(seq) AS size, count(*) AS n, sum(l_orderkey)::BIGINT AS keys, min(seq) AS first FROM q GROUP BY 1, 2"""
_add("fastq_files", _fastq, _FASTQ)
_add("fastq_gzip_files", lambda s, d: _fastq(s, d, gz=True), _FASTQ)


def _fasta(s, d):
    datasources.register(s)
    path = scratch(s, "parts.fa")
    rows = b.table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("contig"), F.repeat(F.lit("ACGTN"), F.col("p_size")).alias("seq"))
    writers.write_fasta(rows, path, 60, named=True)
    return writers.contig_sizes(s.read.format("fasta").option("chunk", 64).load(path))


_add("fasta_files", _fasta, "SELECT 'p' || p_partkey AS contig, 5 * p_size AS length FROM part")


def _alignments(s, d):
    """The reads with a clip, a deletion and an insertion by turns, and bases to match."""
    r = b.reads(s, d)
    n = (F.col("end") - F.col("start")).cast("int")
    op = lambda code, size: F.struct(F.lit(code).alias("op"), (size if not isinstance(size, int) else F.lit(size)).cast("int").alias("len"))
    long = n > 6
    cigar = F.when(long & (F.col("read_no") % 4 == 1), F.array(op(4, 2), op(0, n))).when(long & (F.col("read_no") % 4 == 2), F.array(op(0, F.lit(2)), op(2, 3), op(0, n - 5))).when(long & (F.col("read_no") % 4 == 3), F.array(op(0, F.lit(3)), op(1, 2), op(0, n - 3))).otherwise(F.array(op(0, n)))
    bases = F.aggregate(cigar, F.lit(0), lambda t, x: t + F.when(x["op"].isin(0, 1, 4), x["len"]).otherwise(0))
    return r.withColumns({"cigar": cigar, "bases": bases}).select(
        F.col("qname").cast("string").alias("qname"), "flag", "contig", "start", "end", "mapq", "cigar", F.repeat(F.lit("A"), F.col("bases")).alias("seq"), F.transform(F.sequence(F.lit(1), "bases"), lambda i: (i % 40).cast("int")).alias("qual"),
        F.lit(None).cast("string").alias("mate_contig"), F.lit(None).cast("long").alias("mate_start"), "read_no",
    )


def _sam(s, d):
    datasources.register(s)
    path = scratch(s, "reads.sam")
    writers.write_sam(_alignments(s, d), path)
    return s.read.format("sam").load(path)


_add(
    "sam_files",
    lambda s, d: _sam(s, d).groupBy("contig", F.size("cigar").alias("ops")).agg(*_count("start", "end", "flag", "mapq"), F.sum(F.length("seq")).alias("bases"), F.sum(F.size("qual")).alias("quals")),
    """, q AS (SELECT *, "end" - start AS k, "end" - start > 6 AS long FROM reads),
    z AS (SELECT *, CASE WHEN NOT long THEN 1 WHEN read_no % 4 = 1 THEN 2 WHEN read_no % 4 IN (2, 3) THEN 3 ELSE 1 END AS ops,
      CASE WHEN NOT long THEN k WHEN read_no % 4 = 1 THEN k + 2 WHEN read_no % 4 = 2 THEN k - 3 WHEN read_no % 4 = 3 THEN k + 2 ELSE k END AS b FROM q)
    SELECT contig, ops, count(*) AS n, sum(start)::BIGINT AS sum_start, sum("end")::BIGINT AS sum_end, sum(flag)::BIGINT AS sum_flag, sum(mapq)::BIGINT AS sum_mapq, sum(b)::BIGINT AS bases, sum(b)::BIGINT AS quals FROM z GROUP BY 1, 2""",
    "reads",
)
_add(
    "sam_region",
    lambda s, d: _sam(s, d).where("contig = 'chr3' and mapq >= 20 and start < 5000 and end > 1000").groupBy("flag").agg(*_count("start")),
    " SELECT flag, count(*) AS n, sum(start)::BIGINT AS sum_start FROM reads WHERE contig = 'chr3' AND mapq >= 20 AND start < 5000 AND \"end\" > 1000 GROUP BY 1",
    "reads",
)
_add(
    "start_clipped",
    lambda s, d: _alignments(s, d).groupBy(rd.start_clipped().alias("clipped"), S.has("flag", S.REVERSE).alias("reverse")).agg(*_count("start")),
    """ SELECT ("end" - start > 6 AND read_no % 4 = 1 AND flag & 16 = 0) AS clipped, flag & 16 > 0 AS reverse, count(*) AS n, sum(start)::BIGINT AS sum_start FROM reads GROUP BY 1, 2""",
    "reads",
)
_add(
    "block_coverage",
    lambda s, d: rd.blocks(_alignments(s, d)).groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases")),
    """, q AS (SELECT *, "end" - start AS k, "end" - start > 6 AS long FROM reads)
    SELECT contig, sum(CASE WHEN long AND read_no % 4 IN (2, 3) THEN 2 ELSE 1 END)::BIGINT AS n, sum(CASE WHEN long AND read_no % 4 = 2 THEN k - 3 ELSE k END)::BIGINT AS bases FROM q GROUP BY 1""",
    "reads",
)

# ---------------------------------------------------------------- places


def _back(write, read):
    def query(s, d):
        path = scratch(s, "places")
        write(s, d, path)
        return read(s, path)

    return query


_PLACES = ' SELECT contig, count(*) AS n, sum(start)::BIGINT AS sum_start, sum("end")::BIGINT AS sum_end FROM features GROUP BY 1'
_add("bed_files", _back(lambda s, d, p: writers.write_bed(b.features(s, d).withColumn("score", F.lit(1)), p), lambda s, p: tables.read_bed(s, p).groupBy("contig", "strand").agg(*_count("start", "end", "score"))), ' SELECT contig, strand, count(*) AS n, sum(start)::BIGINT AS sum_start, sum("end")::BIGINT AS sum_end, count(*) AS sum_score FROM features GROUP BY 1, 2', "features")
_add("interval_files", _back(lambda s, d, p: writers.write_bed(b.features(s, d).select("contig", "start", "end"), p, one_based=True), lambda s, p: tables.read_intervals(s, p, one_based=True).groupBy("contig").agg(*_count("start", "end"))), _PLACES, "features")
_add(
    "bedgraph_files",
    _back(lambda s, d, p: writers.write_bedgraph(b.features(s, d).withColumn("cov", F.col("id") % 10), p, 4), lambda s, p: tables.read_bedgraph(s, p).groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum("cov").cast("long").alias("cov"))),
    " SELECT contig, count(*) AS n, sum(id % 10)::BIGINT AS cov FROM features WHERE id % 10 >= 4 GROUP BY 1",
    "features",
)
_add(
    "contig_files",
    lambda s, d: tables.read_contigs(s, _text(s, b.contigs(s, d).coalesce(1).sortWithinPartitions("ordinal").select(F.concat_ws("\t", "contig", F.col("length").cast("string"))), "contigs")),
    " SELECT contig, length, ordinal FROM contigs",
    "contigs",
)


def _gtf(s, d):
    path = scratch(s, "features.gtf")
    none = F.lit(None).cast("string")
    rows = b.features(s, d).select("contig", F.col("biotype").alias("source"), F.lit("exon").alias("feature"), "start", "end", none.alias("score"), "strand", none.alias("frame"), F.create_map(F.lit("gene_id"), F.concat(F.lit("g"), "id"), F.lit("gene_name"), F.col("term")).alias("attributes"))
    writers.write_gtf(rows, path)
    return tables.read_gtf(s, path)


_add(
    "gtf_files",
    lambda s, d: _gtf(s, d).groupBy("contig", F.col("attributes")["gene_name"].alias("name")).agg(*_count("start", "end"), F.sum(F.substring(F.col("attributes")["gene_id"], 2, 20).cast("long")).alias("ids"), F.count("score").alias("scores")),
    ' SELECT contig, term AS name, count(*) AS n, sum(start)::BIGINT AS sum_start, sum("end")::BIGINT AS sum_end, sum(id)::BIGINT AS ids, 0::BIGINT AS scores FROM features GROUP BY 1, 2',
    "features",
)


def _matrix(s, d):
    path = scratch(s, "s1.500.all.1.countMatrix")
    bins = s.range(25).select(F.lit("chr1").alias("contig"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"), F.col("id").alias("bin"))
    nation = b.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("j"))
    cells = nation.where("(i + j) % 3 = 0").withColumn("value", (F.col("i") * 25 + F.col("j")).cast("double"))
    writers.write_matrix(cells, bins, path, digits=1)
    return tables.read_matrix(s, path)


_add("matrix_files", lambda s, d: _matrix(s, d)[1].drop("file"), "SELECT i::BIGINT AS i, j::BIGINT AS j, (i * 25 + j)::DOUBLE AS value FROM (SELECT n_nationkey AS i, unnest(range(25)) AS j FROM nation) WHERE (i + j) % 3 = 0 AND i * 25 + j > 0")
_add("matrix_file_bins", lambda s, d: _matrix(s, d)[0].drop("file"), """SELECT 'chr1' AS contig, n_nationkey * 10::BIGINT AS start, n_nationkey * 10 + 10::BIGINT AS "end", n_nationkey::BIGINT AS bin FROM nation""")

# ---------------------------------------------------------------- names, sets and results


def _gmt(s, d):
    path = scratch(s, "terms.gmt")
    writers.write_gmt(b.features(s, d).select("term", F.concat(F.lit("g"), "id").alias("gene")), path)
    return tables.read_gmt(s, path)


_add("gmt_files", lambda s, d: _gmt(s, d).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("gene").alias("first")), " SELECT term, count(*) AS n, min('g' || id) AS first FROM features GROUP BY 1", "features")
_add(
    "obo_files",
    lambda s, d: tables.read_obo(s, _text(s, b.table(s, d, "nation").coalesce(1).select(F.concat(F.lit("[Term]\nid: GO:"), "n_nationkey", F.lit("\nname: "), "n_name", F.lit("\nnamespace: r"), "n_regionkey", F.lit("\n"))), "terms.obo")),
    "SELECT 'GO:' || n_nationkey AS go_id, n_name AS go_name, 'r' || n_regionkey AS go_domain FROM nation",
)
_add(
    "gaf_files",
    lambda s, d: tables.read_gaf(s, _text(s, b.features(s, d).select(F.concat_ws("\t", F.lit("DB"), F.col("id").cast("string"), F.lit("x"), F.lit(""), "term", F.lit("r"), F.when(F.col("id") % 3 == 0, "IDA").otherwise("IEA"))), "genes.gaf"), ["IDA"]).groupBy("go_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gene").cast("long")).alias("genes")),
    " SELECT term AS go_id, count(*) AS n, sum(id)::BIGINT AS genes FROM features WHERE id % 3 = 0 GROUP BY 1",
    "features",
)


def _results(s, d, **how):
    path = scratch(s, "results.tsv")
    part = F.col("p_partkey")
    rows = b.table(s, d, "part").select(F.concat(F.lit("g"), "p_partkey").alias("gene"), F.when((part % 11 == 0) & (F.col("p_size") > 25), F.lit("NA")).otherwise((part % 7 - 3.5).cast("string")).alias("log2"), F.when(part % 13 == 0, F.lit("NA")).otherwise((F.col("p_size") / 1000).cast("string")).alias("p"))
    writers.write_tsv(rows, path, header=True)
    return tables.read_results(s, path, most=0.025, **how)


_PART = "SELECT p_partkey AS k, p_size FROM part WHERE p_partkey % 13 <> 0"
_add("result_files", lambda s, d: _results(s, d, gene="gene", p="p", log2="log2").groupBy("query").agg(F.count(F.lit(1)).alias("n")), f"WITH q AS ({_PART}) SELECT CASE WHEN p_size > 25 THEN NULL WHEN k % 7 - 3.5 > 0 THEN 'pos' ELSE 'neg' END AS query, count(*) AS n FROM q GROUP BY 1")
_add("result_files_by_ordinal", lambda s, d: _results(s, d, gene=0, p=2).groupBy("query").agg(F.count(F.lit(1)).alias("n")), f"WITH q AS ({_PART}) SELECT CASE WHEN p_size <= 25 THEN 'sig' END AS query, count(*) AS n FROM q GROUP BY 1")
_add(
    "translation_files",
    lambda s, d: tables.read_translation(s, _text(s, b.features(s, d).select(F.concat_ws("\t", F.concat(F.lit("g"), "id"), F.when(F.col("id") % 4 > 0, F.col("term")))), "names.tsv")),
    " SELECT DISTINCT 'g' || id AS in_gene, CASE WHEN id % 4 > 0 THEN term END AS out_gene FROM features",
    "features",
)
_add(
    "snp_frequency_files",
    _back(
        lambda s, d, p: writers.write_tsv(b.points(s, d).select(F.concat_ws(":", "contig", F.col("pos").cast("string"), F.lit("A"), F.lit("G")).alias("SNP"), (F.col("id") % 50).alias("Cov"), F.when(F.col("id") % 5 > 0, F.col("id") % 100 / 100).alias("Freq")), p, header=True),
        lambda s, p: tables.read_snp_frequencies(s, p, 20).groupBy("contig").agg(*_count("pos", "cov"), F.count("freq").alias("known"), F.round(F.sum("freq"), 6).alias("freq")),
    ),
    " SELECT contig, count(*) AS n, sum(pos)::BIGINT AS sum_pos, sum(id % 50)::BIGINT AS sum_cov, count(*) FILTER (WHERE id % 5 > 0) AS known, round(sum((id % 100) / 100.0) FILTER (WHERE id % 5 > 0), 6) AS freq FROM points WHERE id % 50 >= 20 GROUP BY 1",
    "points",
)


def _varscan(s, d, path):
    e = F.col("id")
    rows = b.points(s, d).select("contig", "pos", F.lit("A").alias("ref"), F.lit("G").alias("var"), (e % 20).alias("n1"), (e % 3).alias("n2"), F.lit("1%").alias("f1"), F.lit("x").alias("g1"), (e % 30).alias("t1"), (e % 9).alias("t2"), F.lit("2%").alias("f2"), F.lit("y").alias("g2"), "kind", F.lit(1).alias("v"), (e % 100 / 1000).alias("pv"))
    writers.write_tsv(rows, path, header=True)


_add(
    "somatic_call_files",
    _back(_varscan, lambda s, p: tables.read_varscan(s, p).groupBy("contig", "status").agg(*_count("pos", "normal_ref", "normal_var", "tumour_ref", "tumour_var"), F.round(F.sum("p"), 6).alias("p"))),
    """ SELECT contig, kind AS status, count(*) AS n, sum(pos)::BIGINT AS sum_pos, sum(id % 20)::BIGINT AS sum_normal_ref, sum(id % 3)::BIGINT AS sum_normal_var, sum(id % 30)::BIGINT AS sum_tumour_ref, sum(id % 9)::BIGINT AS sum_tumour_var, round(sum((id % 100) / 1000.0), 6) AS p FROM points GROUP BY 1, 2""",
    "points",
)
_add(
    "sample_sheets",
    lambda s, d: tables.read_sample_sheet(s, _text(s, b.table(s, d, "nation").select(F.concat_ws("\t", F.concat(F.lit("s"), "n_nationkey"), F.concat(F.lit("i"), F.floor(F.col("n_nationkey") / 5).cast("string")), F.when(F.col("n_nationkey") % 5 == 0, "NORM").otherwise("TUM"))), "samples.tsv")),
    "SELECT 's' || n_nationkey AS name, 'i' || (n_nationkey // 5) AS individual, CASE WHEN n_nationkey % 5 = 0 THEN 'NORM' ELSE 'TUM' END AS tissue FROM nation",
)
_add(
    "metric_files",
    lambda s, d: tables.read_metrics(s, _text(s, b.table(s, d, "region").coalesce(1).agg(F.array_join(F.array_sort(F.collect_list(F.concat("r_name", F.lit(": "), F.col("r_regionkey").cast("string")))), "\n").alias("value")), "run.log"), {"asia": r"ASIA: (\d+)", "none": r"MARS: (\d+)"}).drop("file"),
    "SELECT max(r_regionkey) FILTER (WHERE r_name = 'ASIA')::VARCHAR AS asia, NULL::VARCHAR AS none FROM region",
)


def _found(s, d):
    files = b.table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("no")).where("k % 4 > 0 or no = '1'")
    path = scratch(s, "fastq")
    name = F.concat(F.lit("s"), "k", F.lit("_R"), "no", F.lit("_001.fastq"))
    rows = files.select(name.alias("name"), F.lit("@r\nA\n+\nI").alias("value"))
    rows.repartition(4).write.partitionBy("name").text(path)
    # a directory for each name: the files in it are Spark's, so names come from the directories
    listed = s.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace(F.regexp_extract("path", r"name=([^/]+)/", 1), "%3D", "=").alias("path"))
    return listed.distinct()


_add(
    "files_of_samples",
    lambda s, d: tables.files_of_samples(b.table(s, d, "nation").select(F.concat(F.lit("s"), "n_nationkey", F.lit("_")).alias("name")), _found(s, d).where("path like '%_R1_%'")),
    "SELECT 's' || n_nationkey || '_' AS name, 's' || n_nationkey || '_R1_001.fastq' AS path FROM nation",
)

# ---------------------------------------------------------------- order and sets

_add("numbered", lambda s, d: iv.numbered(b.features(s, d).select("contig", "start", "end", "id"), chunk=1024), ' SELECT contig, start, "end", id, row_number() OVER (PARTITION BY contig ORDER BY start, "end") - 1 AS index FROM features', "features")
_add("sorted_by_place", lambda s, d: iv.sorted_by_place(b.features(s, d).select("contig", "start", "end", "id")), ' SELECT contig, start, "end", id FROM features', "features")
_add("union_distinct", lambda s, d: iv.union_distinct(b.features(s, d).select("contig", "strand"), b.reads(s, d).select("contig", "strand")), " SELECT contig, strand FROM features UNION SELECT contig, strand FROM reads", "features", "reads")
_add("require_subset", lambda s, d: iv.require_subset(b.features(s, d).select("contig", "id"), b.contigs(s, d), ["contig"]), " SELECT contig, id FROM features", "features")
_add("require_disjoint", lambda s, d: iv.require_disjoint(b.features(s, d).select("id"), b.features(s, d).select((-1 - F.col("id")).alias("id")), ["id"]), " SELECT id FROM features", "features")
_add(
    "covered_in_all",
    lambda s, d: iv.covered_in_all(b.features(s, d).select("id", F.col("id").alias("a"), (F.col("end") - F.col("start")).alias("c"), F.when(F.col("id") % 3 > 0, F.lit(300)).alias("e")), ["a", "c", "e"], 200),
    ' SELECT id, id AS a, "end" - start AS c, 300 AS e FROM features WHERE id >= 200 AND "end" - start >= 200 AND id % 3 > 0',
    "features",
)
