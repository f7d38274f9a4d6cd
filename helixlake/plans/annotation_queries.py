"""Queries over annotation, enrichment, variants and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.functions import stats
from helixlake.operators import annotate as an
from helixlake.operators import reads as rd
from helixlake.operators import variants as vr
from helixlake.plans import bindings as b
from helixlake.plans import read_queries as rq

QUERIES, ORACLES = {}, {}
SHORT = {"bucket": 512, "levels": 1}


def _add(name: str, query, oracle: str | None, *views: str) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = b.sql(oracle, *views)


# ---------------------------------------------------------------- a GTF of the features: an exon each, a gene by name and contig

GTF = """, gtf AS (SELECT contig, term AS source, CASE id % 4 WHEN 0 THEN 'CDS' WHEN 1 THEN 'gene' ELSE 'exon' END AS feature, start, "end", CASE WHEN strand = '-' THEN '-' ELSE '+' END AS strand,
  name || '.' || contig || CASE WHEN strand = '-' THEN '-' ELSE '+' END AS gene_id, 't' || (id // 3) AS transcript_id, (id % 3 + 1)::VARCHAR AS exon_number, biotype, id FROM features)"""


def _gtf(s, d):
    f = b.features(s, d)
    strand = F.when(F.col("strand") == "-", "-").otherwise("+")
    gene = F.concat("name", F.lit("."), "contig", strand)
    attributes = F.create_map(F.lit("gene_id"), gene, F.lit("transcript_id"), F.concat(F.lit("t"), F.expr("id div 3")), F.lit("exon_number"), (F.col("id") % 3 + 1).cast("string"), F.lit("ID"), F.concat(F.lit("g"), F.col("id")), F.lit("Parent"), F.concat(F.lit("g"), F.expr("id - id % 4 + 1")))
    feature = F.when(F.col("id") % 4 == 0, "CDS").when(F.col("id") % 4 == 1, "gene").otherwise("exon")
    return f.select("contig", F.col("term").alias("source"), feature.alias("feature"), "start", "end", F.lit(".").alias("score"), strand.alias("strand"), F.lit(".").alias("frame"), attributes.alias("attributes"), "biotype", "id")


KNOWN = "(SELECT contig FROM contigs WHERE ordinal < 6)"
_add("filter_gtf", lambda s, d: an.filter_gtf(_gtf(s, d), b.contigs(s, d).where("ordinal < 6")).select("id", "contig", "source", "start", "end"), GTF + f' SELECT id, contig, source, start, "end" FROM gtf WHERE feature = \'exon\' AND contig IN {KNOWN}', "features", "contigs")
_add(
    "filter_gtf_counts",
    lambda s, d: an.filter_gtf_counts(_gtf(s, d), b.contigs(s, d).where("ordinal < 6")),
    GTF + f" SELECT count(*) AS total, count(*) FILTER (WHERE contig NOT IN {KNOWN}) AS unknown_contig, count(*) FILTER (WHERE contig IN {KNOWN} AND feature <> 'exon') AS other_feature, count(*) FILTER (WHERE contig IN {KNOWN} AND feature = 'exon') AS accepted FROM gtf",
    "features", "contigs",
)
_add("tss", lambda s, d: an.tss(_gtf(s, d), an.attribute("gene_id")), GTF + """ SELECT gene_id AS id, min(contig) AS contig, min(strand) AS strand, CASE WHEN min(strand) = '-' THEN max("end") ELSE min(start) END AS tss FROM gtf WHERE feature = 'exon' GROUP BY 1""", "features")
_add("tss_skip_ambiguous", lambda s, d: an.tss(_gtf(s, d), F.col("source"), skip_ambiguous=True), GTF + """ SELECT source AS id, min(contig) AS contig, min(strand) AS strand, CASE WHEN min(strand) = '-' THEN max("end") ELSE min(start) END AS tss FROM gtf WHERE feature = 'exon' GROUP BY 1 HAVING count(DISTINCT contig) = 1 AND count(DISTINCT strand) = 1""", "features")
_add("tss_bed", lambda s, d: an.tss_bed(_gtf(s, d)), GTF + """ SELECT contig, CASE WHEN strand = '-' THEN "end" - 1 ELSE start END AS start, CASE WHEN strand = '-' THEN "end" ELSE start + 1 END AS "end", transcript_id AS name, 0 AS score, strand FROM gtf WHERE feature = 'exon' AND exon_number = '1'""", "features")
_add("exon_bed", lambda s, d: an.exon_bed(_gtf(s, d), "transcript_id", "t7"), GTF + """ SELECT contig, start, "end", transcript_id || '_exon_' || exon_number || '_' || source AS name, 0 AS score, strand FROM gtf WHERE feature = 'exon' AND transcript_id = 't7'""", "features")
NAMES = " SELECT gene_id AS key, array_to_string(list_sort(list(DISTINCT {0})), ',') AS values FROM gtf GROUP BY 1"
for name, column in (("gene2biotype", "biotype"), ("gene2transcript", "transcript_id"), ("gene2source", "source")):
    _add(name, lambda s, d, c=column: an.name_map(_gtf(s, d), an.attribute("gene_id"), F.col(c) if c in ("biotype", "source") else an.attribute(c)).withColumn("values", F.array_join("values", ",")), GTF + NAMES.format(column), "features")
_add("name_map_counts", lambda s, d: an.name_map_counts(an.name_map(_gtf(s, d), an.attribute("gene_id"), F.col("biotype"))), GTF + " SELECT n::INTEGER AS size, count(*) AS keys FROM (SELECT gene_id, count(DISTINCT biotype) AS n FROM gtf GROUP BY 1) GROUP BY 1", "features")
_add(
    "transcript_parents",
    lambda s, d: an.transcript_parents(_gtf(s, d), ["exon"]),
    GTF + """ SELECT 'g' || t.id AS transcript, 'g' || g.id AS gene, coalesce(t.contig, g.contig) AS contig, coalesce(t.strand, g.strand) AS strand, coalesce(t.start, g.start) AS start, coalesce(t."end", g."end") AS "end"
    FROM (SELECT * FROM gtf WHERE feature = 'gene') g LEFT JOIN (SELECT * FROM gtf WHERE feature = 'exon') t ON g.id = t.id - t.id % 4 + 1""",
    "features",
)
_add("feature_intervals", lambda s, d: an.feature_intervals(_gtf(s, d), {"coding": ["CDS", "exon"], "all": ["CDS", "exon", "gene"]}), GTF + """ SELECT c.class, contig, start, "end", strand FROM gtf JOIN (VALUES ('coding', 'CDS'), ('coding', 'exon'), ('all', 'CDS'), ('all', 'exon'), ('all', 'gene')) c(class, feature) USING (feature)""", "features")
_add(
    "count_genes",
    lambda s, d: an.count_genes(b.reads(s, d).where(rd.coverage_filter(10)), b.features(s, d).select("contig", "start", "end", F.col("term").alias("gene")), **SHORT),
    """, r AS (SELECT row_number() OVER () AS rid, * FROM reads WHERE flag & 516 = 0 AND mapq >= 10), h AS (SELECT rid, min(f.term) AS lo, max(f.term) AS hi FROM r LEFT JOIN features f ON f.contig = r.contig AND f."end" > r.start AND f.start < r."end" GROUP BY 1)
    SELECT CASE WHEN lo IS NULL THEN '__no_feature' WHEN lo = hi THEN lo ELSE '__ambiguous' END AS gene, count(*) AS n FROM h GROUP BY 1""",
    "reads", "features",
)

# ---------------------------------------------------------------- translations: nations to regions, parts to brands


def _first(s, d):
    return b.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("in_gene"), F.concat(F.lit("s"), F.col("p_size")).alias("out_gene"))


def _second(s, d):
    return b.table(s, d, "part").where("p_size < 40").select(F.concat(F.lit("s"), F.col("p_size")).alias("in_gene"), F.col("p_brand").alias("out_gene")).distinct()


_add(
    "compose_translations",
    lambda s, d: an.compose(_first(s, d), _second(s, d)).withColumn("out_genes", F.array_join("out_genes", ",")),
    ", t AS (SELECT DISTINCT 's' || p_size AS m, p_brand AS o FROM part WHERE p_size < 40) SELECT p_partkey::VARCHAR AS in_gene, array_to_string(coalesce(list_sort(list(DISTINCT o) FILTER (WHERE o IS NOT NULL)), []), ',') AS out_genes FROM part LEFT JOIN t ON m = 's' || p_size GROUP BY 1",
    "contigs",
)
_add(
    "replace_names",
    lambda s, d: an.replace_names(b.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("gene"), "o_orderkey"), "gene", b.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("in_gene"), F.concat(F.lit("n"), F.round("c_acctbal").cast("long")).alias("out_gene"))),
    ", t AS (SELECT c_custkey::VARCHAR AS i, 'n' || round(c_acctbal)::BIGINT AS o FROM customer), j AS (SELECT o AS gene, o_orderkey, count(*) OVER (PARTITION BY o) AS k FROM orders JOIN t ON i = o_custkey::VARCHAR) SELECT gene, o_orderkey FROM j WHERE k = 1",
    "contigs",
)
_add(
    "replace_names_all",
    lambda s, d: an.replace_names(b.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("gene"), "o_orderkey"), "gene", b.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("in_gene"), F.col("c_mktsegment").alias("out_gene")), False),
    " SELECT c_mktsegment AS gene, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey",
    "contigs",
)

# ---------------------------------------------------------------- enrichment: brands and types as terms, parts by revenue as queries

GENES = """, rev AS (SELECT p_partkey AS gene, coalesce(sum(l_quantity), 0) AS q FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1),
  genes AS (SELECT gene, CASE WHEN q > 900 THEN 'pos' WHEN q < 600 THEN 'neg' END AS query FROM rev),
  sets AS (SELECT p_brand AS term, p_partkey AS gene FROM part UNION ALL SELECT p_type, p_partkey FROM part),
  asked AS (SELECT * FROM genes WHERE query IS NOT NULL UNION ALL SELECT gene, 'com' FROM genes WHERE query IS NOT NULL),
  g AS (SELECT t.term, q.query, t.size, q.drawn, (SELECT count(*) FROM genes) AS background, coalesce(h.hits, 0) AS hits FROM (SELECT term, count(*) AS size FROM sets GROUP BY 1) t CROSS JOIN (SELECT query, count(*) AS drawn FROM asked GROUP BY 1) q
    LEFT JOIN (SELECT term, query, count(*) AS hits FROM sets JOIN asked USING (gene) GROUP BY 1, 2) h ON h.term = t.term AND h.query = q.query),
  ok AS (SELECT *, hits >= 3 AND size BETWEEN 5 AND 500 AS fits FROM g),
  tail AS (SELECT term, query, sum(exp(lgamma(size + 1) - lgamma(x + 1) - lgamma(size - x + 1) + lgamma(background - size + 1) - lgamma(drawn - x + 1) - lgamma(background - size - drawn + x + 1) - lgamma(background + 1) + lgamma(drawn + 1) + lgamma(background - drawn + 1))) AS p
    FROM (SELECT *, unnest(range(hits, least(size, drawn) + 1)) AS x FROM ok WHERE fits) WHERE x >= drawn + size - background GROUP BY 1, 2),
  e AS (SELECT ok.term, ok.query, background, drawn, size, hits, fits, CASE WHEN p IS NOT NULL THEN least(1.0, p) END AS p FROM ok LEFT JOIN tail USING (term, query)),
  r AS (SELECT *, count(p) OVER () AS m, CASE WHEN p IS NOT NULL THEN count(p) OVER (ORDER BY p NULLS LAST) END AS k FROM e),
  f AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / k) OVER (ORDER BY p DESC NULLS LAST ROWS UNBOUNDED PRECEDING)) END AS fdr FROM r)"""


def _genes(s, d):
    q = b.table(s, d, "part").join(b.table(s, d, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left").groupBy(F.col("p_partkey").alias("gene")).agg(F.coalesce(F.sum("l_quantity"), F.lit(0)).alias("q"))
    return q.select("gene", F.when(F.col("q") > 900, "pos").when(F.col("q") < 600, "neg").alias("query"))


def _sets(s, d):
    p = b.table(s, d, "part")
    return p.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene")).unionByName(p.select(F.col("p_type").alias("term"), F.col("p_partkey").alias("gene")))


SIGNIFICANT = ["round(p, 6) AS p", "round(fdr, 6) AS fdr"]
_add("enrichment", lambda s, d: an.enrichment(_genes(s, d), _sets(s, d), combined="com").selectExpr("term", "query", "background", "drawn", "size", "hits", *SIGNIFICANT), GENES + " SELECT term, query, background, drawn, size, hits, round(p, 6) AS p, round(fdr, 6) AS fdr FROM f WHERE fits", "contigs")
_add("enrichment_all_terms", lambda s, d: an.enrichment(_genes(s, d), _sets(s, d), combined="com", keep_filtered=True).selectExpr("term", "query", "background", "drawn", "size", "hits", *SIGNIFICANT), GENES + " SELECT term, query, background, drawn, size, hits, round(p, 6) AS p, round(fdr, 6) AS fdr FROM f", "contigs")
_add("genes_of_term", lambda s, d: _genes(s, d).where("query is not null").join(_sets(s, d), "gene").select("term", "query", "gene"), GENES + " SELECT term, query, gene FROM sets JOIN genes USING (gene) WHERE query IS NOT NULL", "contigs")

# ---------------------------------------------------------------- rank statistics


def _values(s, d):
    return b.table(s, d, "lineitem").select("l_returnflag", "l_linenumber", (F.col("l_quantity") * 4).cast("long").alias("v"))


_add(
    "mann_whitney",
    lambda s, d: stats.mann_whitney(_values(s, d), "v", "l_returnflag", "A", "R", ["l_linenumber"], 10).select("l_linenumber", "n1", "n2", F.round("mean1", 6).alias("mean1"), F.round("mean2", 6).alias("mean2"), "u"),
    """, x AS (SELECT l_linenumber, l_returnflag AS g, (l_quantity * 4)::BIGINT AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')),
    r AS (SELECT *, rank() OVER (PARTITION BY l_linenumber ORDER BY v) + (count(*) OVER (PARTITION BY l_linenumber, v) - 1) / 2 AS k FROM x)
    SELECT l_linenumber, count(*) FILTER (WHERE g = 'A') AS n1, count(*) FILTER (WHERE g = 'R') AS n2, round(avg(v) FILTER (WHERE g = 'A'), 6) AS mean1, round(avg(v) FILTER (WHERE g = 'R'), 6) AS mean2,
      sum(k) FILTER (WHERE g = 'A') - count(*) FILTER (WHERE g = 'A') * (count(*) FILTER (WHERE g = 'A') + 1) / 2 AS u FROM r GROUP BY 1""",
    "contigs",
)
_add("average_rank", lambda s, d: stats.average_rank(b.table(s, d, "part").select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"]), " SELECT p_partkey, p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rank FROM part", "contigs")


def _expression(s, d):
    sums = b.table(s, d, "lineitem").groupBy("l_partkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return sums.select(*[F.coalesce(c, F.lit(0.0)).alias(c.lower()) for c in ("A", "N", "R")])


WIDE = ", w AS (SELECT coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS a, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS n, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS r FROM lineitem GROUP BY l_partkey)"
COLS = [("a", "n"), ("a", "r"), ("n", "r")]
_add("correlation_pearson", lambda s, d: stats.correlations(_expression(s, d), COLS).withColumn("r", F.round("r", 6)), WIDE + " SELECT 'a' AS a, 'n' AS b, round(corr(a, n), 6) AS r FROM w UNION ALL SELECT 'a', 'r', round(corr(a, r), 6) FROM w UNION ALL SELECT 'n', 'r', round(corr(n, r), 6) FROM w", "contigs")
RANKS = WIDE + ", k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS a, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS n, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS r FROM w)"
_add("correlation_spearman", lambda s, d: stats.correlations(_expression(s, d), COLS, "spearman").withColumn("r", F.round("r", 6)), RANKS + " SELECT 'a' AS a, 'n' AS b, round(corr(a, n), 6) AS r FROM k UNION ALL SELECT 'a', 'r', round(corr(a, r), 6) FROM k UNION ALL SELECT 'n', 'r', round(corr(n, r), 6) FROM k", "contigs")
_add(
    "correlation_kendall",
    lambda s, d: stats.correlations(_expression(s, d), [("a", "n")], "kendall").withColumn("r", F.round("r", 6)),
    WIDE + """, i AS (SELECT a, n, row_number() OVER () AS k FROM w), p AS (SELECT sign(x.a - y.a) AS s, sign(x.n - y.n) AS t FROM i x JOIN i y ON x.k < y.k)
    SELECT 'a' AS a, 'n' AS b, round(sum(s * t) / sqrt(sum(s * s)::DOUBLE * sum(t * t)::DOUBLE), 6) AS r FROM p""",
    "contigs",
)

# ---------------------------------------------------------------- variants at the points; bases as in the base-call queries

VARIANTS = """, v AS (SELECT DISTINCT contig, pos + 1 AS pos, substr('ACGTTGCAAC', pos % 10 + 1, 1) AS ref, translate(substr('ACGTTGCAAC', pos % 10 + 1, 1), 'ACGT', 'TGCA') AS var FROM points)"""


def _variants(s, d):
    base = F.substring(F.lit(rq.LETTERS), (F.col("pos") % 10 + 1).cast("int"), F.lit(1))
    return b.points(s, d).select("contig", (F.col("pos") + 1).alias("pos"), base.alias("ref"), F.translate(base, "ACGT", "TGCA").alias("var")).distinct()


ALLELES = rq.BITS + VARIANTS + """, kk AS (SELECT contig, pos + 1 AS pos, base, mapq, flag, sample FROM k WHERE mapq >= 20 AND baseq >= 20),
  h AS (SELECT v.*, kk.sample, count(*) FILTER (WHERE base = ref) AS n_ref, count(*) FILTER (WHERE base = ref AND flag & 16 = 0) AS n_ref_forward, count(*) FILTER (WHERE base = var) AS n_var, count(*) FILTER (WHERE base = var AND flag & 16 = 0) AS n_var_forward, avg(mapq) FILTER (WHERE base IN (ref, var)) AS mapq FROM v JOIN kk USING (contig, pos) GROUP BY ALL),
  al AS (SELECT v.*, s.sample, coalesce(n_ref, 0) AS n_ref, coalesce(n_ref_forward, 0) AS n_ref_forward, coalesce(n_var, 0) AS n_var, coalesce(n_var_forward, 0) AS n_var_forward, mapq, CASE WHEN coalesce(n_ref + n_var, 0) = 0 THEN 0 ELSE n_var / (n_ref + n_var) END AS freq
    FROM v CROSS JOIN (SELECT DISTINCT sample FROM reads) s LEFT JOIN h USING (contig, pos, ref, var, sample))"""


def _alleles(s, d):
    return vr.allele_counts(_variants(s, d), rq._bits(s, d))


_add("allele_counts", lambda s, d: _alleles(s, d).withColumns({"mapq": F.round("mapq", 6), "freq": F.round("freq", 6)}), ALLELES + " SELECT * REPLACE (round(mapq, 6) AS mapq, round(freq, 6) AS freq) FROM al", "reads", "points")
_add(
    "control_test_filter",
    lambda s, d: vr.control_test_filter(_alleles(s, d), "A", "R", 3, 0.5, 0.5).select(*vr.KEY, "control_n_ref", "test_n_var"),
    ALLELES + """ SELECT c.contig, c.pos, c.ref, c.var, c.n_ref AS control_n_ref, t.n_var AS test_n_var FROM al c JOIN al t USING (contig, pos, ref, var) WHERE c.sample = 'A' AND t.sample = 'R' AND c.n_ref + c.n_var >= 3 AND t.n_ref + t.n_var >= 3 AND c.freq <= 0.5 AND t.freq >= 0.5 AND c.mapq >= 20 AND t.mapq >= 20""",
    "reads", "points",
)
FISHER = ALLELES + """, tb AS (SELECT al.*, n.n_ref AS nr, n.n_var AS nv, n.freq AS nf FROM al JOIN (SELECT * FROM al WHERE sample = 'A') n USING (contig, pos, ref, var)),
  ob AS (SELECT *, n_ref + n_var + nr + nv AS t, n_var + n_ref AS rowk, n_var + nv AS col FROM tb),
  px AS (SELECT contig, pos, sample, n_var, freq, nf, x, exp(lgamma(rowk + 1) - lgamma(x + 1) - lgamma(rowk - x + 1) + lgamma(t - rowk + 1) - lgamma(col - x + 1) - lgamma(t - rowk - col + x + 1) - lgamma(t + 1) + lgamma(col + 1) + lgamma(t - col + 1)) AS p
    FROM (SELECT *, unnest(range(greatest(0, col + rowk - t), least(col, rowk) + 1)) AS x FROM ob WHERE sample <> 'A')),
  pv AS (SELECT contig, pos, sample, least(1.0, coalesce(sum(p) FILTER (WHERE CASE WHEN freq > nf THEN x >= n_var WHEN freq < nf THEN x <= n_var ELSE p <= here * (1 + 1e-7) END), 1.0)) AS p
    FROM (SELECT *, max(p) FILTER (WHERE x = n_var) OVER (PARTITION BY contig, pos, sample) AS here FROM px) GROUP BY 1, 2, 3),
  mt AS (SELECT al.*, pv.p, min(pv.p) OVER (PARTITION BY contig, pos, ref, var) AS min_p FROM al LEFT JOIN pv USING (contig, pos, sample))"""
_add("variant_metrics", lambda s, d: vr.variant_metrics(_alleles(s, d), "A").select(*vr.KEY, "sample", "n_ref", "n_var", F.round("p", 6).alias("p"), F.round("min_p", 6).alias("min_p")), FISHER + " SELECT contig, pos, ref, var, sample, n_ref, n_var, round(p, 6) AS p, round(min_p, 6) AS min_p FROM mt", "reads", "points")
_add(
    "filter_metrics",
    lambda s, d: vr.filter_metrics(vr.variant_metrics(_alleles(s, d), "A"), "A", "sample", 2, 2, 0.5, 0.3, 0.9, 1, 20).select(*vr.KEY, "sample", F.round("p", 6).alias("p"), F.round("min_p", 6).alias("min_p")),
    FISHER + """, cl AS (SELECT contig, pos, ref, var FROM mt WHERE sample = 'A' AND n_ref + n_var >= 2 AND freq <= 0.5 AND mapq >= 20),
    t AS (SELECT mt.*, coalesce(sample <> 'A' AND n_ref + n_var >= 2 AND freq >= 0.3 AND p <= 0.9 AND n_var >= 1 AND mapq >= 20, false) AS ok FROM mt JOIN cl USING (contig, pos, ref, var)),
    a AS (SELECT contig, pos, ref, var, min(p) AS least_p FROM t WHERE ok GROUP BY ALL) SELECT contig, pos, ref, var, sample, CASE WHEN ok THEN round(p, 6) END AS p, round(least_p, 6) AS min_p FROM t JOIN a USING (contig, pos, ref, var)""",
    "reads", "points",
)

CALLSET = """, cs AS (SELECT id, contig, pos + 1 AS pos, substr('ACGT', id % 4 + 1, 1) AS ref, CASE kind WHEN 'view' THEN '-' || repeat('CA', (id % 3 + 1)::INTEGER) WHEN 'click' THEN '+GT' WHEN 'error' THEN 'A/+C' ELSE 'T' END AS var,
  (id * 7) % 40 AS normal_ref, id % 5 AS normal_var, (id * 3) % 50 AS tumour_ref, (id * 11) % 30 AS tumour_var, CASE WHEN id % 3 = 0 THEN 'Germline' ELSE 'Somatic' END AS status, p / 500 AS p FROM points)"""


def _callset(s, d):
    i = F.col("id")
    var = F.when(F.col("kind") == "view", F.concat(F.lit("-"), F.expr("repeat('CA', cast(id % 3 + 1 as int))"))).when(F.col("kind") == "click", "+GT").when(F.col("kind") == "error", "A/+C").otherwise("T")
    return b.points(s, d).select(
        "id", "contig", (F.col("pos") + 1).alias("pos"), F.substring(F.lit("ACGT"), (i % 4 + 1).cast("int"), F.lit(1)).alias("ref"), var.alias("var"), ((i * 7) % 40).alias("normal_ref"), (i % 5).alias("normal_var"),
        ((i * 3) % 50).alias("tumour_ref"), ((i * 11) % 30).alias("tumour_var"), F.when(i % 3 == 0, "Germline").otherwise("Somatic").alias("status"), (F.col("p") / 500).alias("p"),
    )


NORMAL = CALLSET + """, nm AS (SELECT DISTINCT contig, CASE WHEN a LIKE '-%' THEN pos + 1 ELSE pos END AS pos, CASE WHEN a LIKE '-%' THEN substr(a, 2, 1) ELSE ref END AS ref, CASE WHEN a LIKE '-%' THEN repeat('-', length(a) - 1) WHEN a LIKE '+%' THEN ref || substr(a, 2) ELSE a END AS var
  FROM (SELECT *, unnest(string_split(var, '/')) AS a FROM cs))"""
_add("normalise_alleles", lambda s, d: vr.normalise(_callset(s, d)), NORMAL + " SELECT * FROM nm", "points")
_add("annotation_input", lambda s, d: vr.annotation_input(vr.normalise(_callset(s, d))), NORMAL + """ SELECT contig, pos AS start, CASE WHEN var LIKE '-%' THEN pos + length(var) - 1 ELSE pos END AS "end", CASE WHEN var LIKE '-%' OR length(var) > 1 THEN '0' ELSE ref END AS ref, CASE WHEN var LIKE '-%' THEN '-' WHEN length(var) > 1 THEN substr(var, 2) ELSE var END AS var FROM nm""", "points")
_add(
    "germline_filter",
    lambda s, d: vr.germline_filter(_callset(s, d).select("id", F.col("tumour_ref").alias("reads1"), F.col("tumour_var").alias("reads2"), (F.col("id") % (F.col("tumour_var") + 1)).alias("reads2plus"))),
    CALLSET + """ SELECT id, tumour_ref AS reads1, tumour_var AS reads2, id % (tumour_var + 1) AS reads2plus FROM cs WHERE tumour_ref + tumour_var >= 10 AND tumour_var >= 2 AND tumour_var / (tumour_ref + tumour_var) BETWEEN 0.1 AND 1
    AND greatest((id % (tumour_var + 1)) / tumour_var, 1 - (id % (tumour_var + 1)) / tumour_var) <= 0.9""",
    "points",
)
_add(
    "somatic_reasons",
    lambda s, d: vr.somatic_reasons(_callset(s, d), max_neighbours=6, max_p=0.2).select("id", "neighbours", "reason"),
    CALLSET + """, pl AS (SELECT DISTINCT contig, pos FROM cs), nb AS (SELECT *, (count(*) OVER (PARTITION BY contig ORDER BY pos RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) - 1)::BIGINT AS neighbours FROM pl)
    SELECT id, neighbours, CASE WHEN status <> 'Somatic' THEN 'status' WHEN normal_ref + normal_var < 10 THEN 'normal coverage' WHEN tumour_ref + tumour_var < 10 THEN 'tumour coverage' WHEN tumour_var < 2 THEN 'tumour reads'
      WHEN tumour_var / (tumour_ref + tumour_var) < 0.05 THEN 'tumour frequency' WHEN normal_var / (normal_ref + normal_var) > 1 THEN 'normal frequency' WHEN p > 0.2 THEN 'p-value' WHEN neighbours > 6 THEN 'neighbours' ELSE 'accepted' END AS reason FROM cs JOIN nb USING (contig, pos)""",
    "points",
)
_add("depth_ratio", lambda s, d: vr.depth_ratio(_callset(s, d), _callset(s, d), "normal_ref").unionByName(vr.depth_ratio(_callset(s, d).withColumn("depth", F.col("normal_ref") * 2), _callset(s, d).withColumn("depth", F.col("tumour_ref") * 2))), CALLSET + " SELECT 1.0::DOUBLE AS ratio UNION ALL SELECT sum(normal_ref * 2) / sum(tumour_ref * 2) FROM cs", "points")
_add("frequency_histogram", lambda s, d: vr.frequency_histogram(_callset(s, d), "p", 20, ["contig"]), CALLSET + " SELECT contig, least(floor(p * 20), 19)::INTEGER AS bin, count(*) AS n FROM cs GROUP BY 1, 2", "points")
_add("standard_contigs", lambda s, d: vr.standard_contigs(b.contigs(s, d).unionByName(b.contigs(s, d).withColumn("contig", F.concat(F.lit("un_"), "contig")))), " SELECT * FROM contigs", "contigs")
_add(
    "expression_matrix",
    lambda s, d: b.table(s, d, "lineitem").groupBy("l_partkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).na.fill(0.0).select(F.col("l_partkey").alias("gene"), F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r")),
    " SELECT l_partkey AS gene, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS a, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS n, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS r FROM lineitem GROUP BY 1",
    "contigs",
)
