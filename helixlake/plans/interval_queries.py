"""Queries over intervals: joins, nearest, merge, coverage, bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.operators import intervals as iv
from helixlake.operators import reads as rd
from helixlake.plans import bindings as b

#: Reads and features here are at most a few hundred long, so one level of buckets does.
SHORT = {"bucket": 512, "levels": 1}

QUERIES, ORACLES = {}, {}


def _add(name: str, query, oracle: str, *views: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = b.sql(oracle, *views)


def _good(spark, d):
    return b.reads(spark, d).where(rd.coverage_filter(10, remove_dup=True))


GOOD = "flag & 1540 = 0 AND mapq >= 10"
OVERLAP = 'f.contig = r.contig AND f."end" > r.start AND f.start < r."end"'

_add(
    "overlap_join",
    lambda s, d: iv.overlap_join(b.features(s, d), _good(s, d).select("contig", "start", "end", "qname", "read_no"), **SHORT).select("id", "contig", "start", "end", "start_r", "end_r", "qname", "read_no"),
    f' SELECT f.id, f.contig, f.start, f."end", r.start AS start_r, r."end" AS end_r, r.qname, r.read_no FROM features f JOIN reads r ON {OVERLAP} WHERE {GOOD}',
    "features", "reads",
)
_add(
    "overlap_stranded",
    lambda s, d: iv.overlap_join(iv.stranded(b.points(s, d).select("id", "contig", F.col("pos").alias("start"), (F.col("pos") + 20).alias("end"), "strand")), b.features(s, d).select("contig", "start", "end", "strand", F.col("id").alias("feature")), ["contig", "strand"], **SHORT).select("id", "feature", "strand"),
    ' SELECT p.id, f.id AS feature, f.strand FROM points p JOIN features f ON p.contig = f.contig AND f."end" > p.pos AND f.start < p.pos + 20 AND (p.strand = \'*\' OR contains(p.strand, f.strand))',
    "features", "points",
)
for how, word in (("left_semi", "EXISTS"), ("left_anti", "NOT EXISTS")):
    _add(
        f"overlap_{how[5:]}",
        lambda s, d, how=how: iv.overlap_join(b.features(s, d), b.points(s, d).where("kind = 'error' and p > 60").select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")), how=how, **SHORT).select("id", "contig", "start", "end"),
        f' SELECT id, contig, start, "end" FROM features f WHERE {word} (SELECT 1 FROM points p WHERE p.kind = \'error\' AND p.p > 60 AND p.contig = f.contig AND f."end" > p.pos AND f.start < p.pos + 1)',
        "features", "points",
    )
_add(
    "intersect_first",
    lambda s, d: iv.intersect_intervals(b.features(s, d).select("id", "contig", "start", "end"), b.features(s, d).select("contig", (F.col("start") + 3).alias("start"), (F.col("end") + 3).alias("end"), F.col("id").alias("other")), mode="first", **SHORT),
    """, o AS (SELECT contig, start + 3 AS start, "end" + 3 AS "end", id AS other FROM features),
    j AS (SELECT f.id, f.contig, greatest(f.start, o.start) AS start, least(f."end", o."end") AS "end", o.other,
      row_number() OVER (PARTITION BY f.id ORDER BY o.start, o."end", o.other) AS k
      FROM features f JOIN o ON f.contig = o.contig AND f."end" > o.start AND f.start < o."end")
    SELECT id, contig, start, "end", other FROM j WHERE k = 1""",
    "features",
)
for kind, at in (("starts_at", "start"), ("ends_at", '"end"')):
    _add(
        kind,
        lambda s, d, kind=kind: getattr(iv, kind)(iv.stranded(b.points(s, d).select("id", "contig", "pos", "strand")), b.features(s, d).select("contig", "start", "end", "strand", F.col("id").alias("feature")), ["contig", "strand"]).select("id", "feature"),
        f" SELECT p.id, f.id AS feature FROM points p JOIN features f ON p.contig = f.contig AND f.{at} = p.pos AND (p.strand = '*' OR contains(p.strand, f.strand))",
        "features", "points",
    )
for side, fn, gap, test in (("left", iv.nearest_left, 'p.pos - f."end"', 'f."end" <= p.pos'), ("right", iv.nearest_right, "f.start - p.pos", "f.start >= p.pos")):
    _add(
        f"nearest_{side}",
        lambda s, d, fn=fn: fn(iv.stranded(b.points(s, d).select("id", "contig", "pos", "strand")), b.features(s, d).select("contig", "start", "end", "strand", F.col("id").alias("feature")), ["contig", "strand"], ["id"], most=100, chunk=1024).select("id", "feature", "start", "end", "distance"),
        f""", j AS (SELECT p.id, f.id AS feature, f.start, f."end", {gap} AS distance, min({gap}) OVER (PARTITION BY p.id) AS least
          FROM points p JOIN features f ON p.contig = f.contig AND {test} AND {gap} <= 100 AND (p.strand = '*' OR contains(p.strand, f.strand)))
        SELECT id, feature, start, "end", distance FROM j WHERE distance = least""",
        "features", "points",
    )

MERGE = """, m AS (SELECT contig, strand, start, "end", max("end") OVER (PARTITION BY contig, strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {0}),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach - start < {1} THEN 1 ELSE 0 END) OVER (PARTITION BY contig, strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT contig, strand, min(start) AS start, max("end") AS "end", count(*) AS n_merged FROM g GROUP BY contig, strand, island"""
_add("merge_strand", lambda s, d: iv.merge_intervals(_good(s, d), ["contig", "strand"], chunk=1024), MERGE.format(f"(SELECT * FROM reads WHERE {GOOD})", 1), "reads")
_add("merge_gap", lambda s, d: iv.merge_intervals(b.features(s, d).withColumn("strand", F.concat("strand", "term")), ["contig", "strand"], -30, chunk=1024), MERGE.format("(SELECT * REPLACE (strand || term AS strand) FROM features)", -30), "features")

RUNS = """, e AS (SELECT contig, start AS pos, 1 AS d FROM {0} WHERE start < "end" UNION ALL SELECT contig, "end", -1 FROM {0} WHERE start < "end"),
  n AS (SELECT contig, pos, sum(d) AS d FROM e GROUP BY 1, 2 HAVING sum(d) <> 0),
  runs AS (SELECT contig, pos AS start, lead(pos) OVER w AS "end", (sum(d) OVER w)::BIGINT AS cov FROM n WINDOW w AS (PARTITION BY contig ORDER BY pos))"""
_add("bedgraph", lambda s, d: iv.coverage(_good(s, d), chunk=1024), RUNS.format(f"(SELECT * FROM reads WHERE {GOOD})") + ' SELECT contig, start, "end", cov FROM runs WHERE "end" IS NOT NULL AND cov > 0', "reads")
_add(
    "bedgraph_zero",
    lambda s, d: iv.coverage(b.reads(s, d).where("mapq >= 35"), zero=True, lengths=b.contigs(s, d), chunk=1024),
    """, r AS (SELECT * FROM reads WHERE mapq >= 35), e AS (SELECT contig, start AS pos, 1 AS d FROM r UNION ALL SELECT contig, "end", -1 FROM r), n AS (SELECT contig, pos, sum(d) AS d FROM e GROUP BY 1, 2 HAVING sum(d) <> 0),
    z AS (SELECT contig, pos, sum(d) AS d FROM (SELECT * FROM n UNION ALL SELECT contig, 0, 0 FROM contigs UNION ALL SELECT contig, length, 0 FROM contigs) GROUP BY 1, 2),
    runs AS (SELECT contig, pos AS start, lead(pos) OVER w AS "end", (sum(d) OVER w)::BIGINT AS cov FROM z WINDOW w AS (PARTITION BY contig ORDER BY pos)) SELECT * FROM runs WHERE "end" IS NOT NULL""",
    "reads", "contigs",
)
_add(
    "bedgraph_regions",
    lambda s, d: iv.clip(iv.coverage(_good(s, d), chunk=1024), b.features(s, d).select("contig", "start", "end", "id"), **SHORT).select("id", "contig", "start", "end", "cov"),
    RUNS.format(f"(SELECT * FROM reads WHERE {GOOD})") + ' SELECT f.id, f.contig, greatest(f.start, r.start) AS start, least(f."end", r."end") AS "end", r.cov FROM features f JOIN runs r ON f.contig = r.contig AND f."end" > r.start AND f.start < r."end" WHERE r.cov > 0',
    "reads", "features",
)
_add(
    "mean_coverage",
    lambda s, d: iv.mean_coverage(b.features(s, d), _good(s, d), ["id"], **SHORT).select("id", "contig", "start", "end", "bases", "mean_cov"),
    f""" SELECT f.id, f.contig, f.start, f."end", coalesce(sum(least(f."end", r."end") - greatest(f.start, r.start)), 0)::BIGINT AS bases,
      coalesce(sum(least(f."end", r."end") - greatest(f.start, r.start)), 0)::BIGINT / (f."end" - f.start) AS mean_cov
    FROM features f LEFT JOIN (SELECT * FROM reads WHERE {GOOD}) r ON {OVERLAP} GROUP BY f.id, f.contig, f.start, f."end" """,
    "features", "reads",
)
_add(
    "mean_coverage_samples",
    lambda s, d: iv.mean_coverage(b.features(s, d), _good_all(s, d), ["id"], ["sample"], **SHORT).groupBy("id").pivot("sample", ["A", "N", "R"]).agg(F.first("bases")).select("id", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r")),
    f""" SELECT f.id, coalesce(sum(x) FILTER (WHERE sample = 'A'), 0)::BIGINT AS a, coalesce(sum(x) FILTER (WHERE sample = 'N'), 0)::BIGINT AS n, coalesce(sum(x) FILTER (WHERE sample = 'R'), 0)::BIGINT AS r
    FROM features f LEFT JOIN (SELECT f.id, r.sample, least(f."end", r."end") - greatest(f.start, r.start) AS x FROM features f JOIN reads r ON {OVERLAP} WHERE flag & 4 = 0) j USING (id) GROUP BY f.id""",
    "features", "reads",
)


def _good_all(spark, d):
    return b.reads(spark, d).where("flag & 4 = 0")


_add(
    "coverage_counts",
    lambda s, d: iv.coverage_counts(b.features(s, d), _good(s, d), 40, **SHORT),
    RUNS.format(f"(SELECT * FROM reads WHERE {GOOD})")
    + """, c AS (SELECT least(r.cov, 40) AS cov, sum(least(f."end", r."end") - greatest(f.start, r.start))::BIGINT AS bases FROM features f JOIN runs r ON f.contig = r.contig AND f."end" > r.start AND f.start < r."end" WHERE r.cov > 0 GROUP BY 1)
    SELECT cov, bases FROM c UNION ALL SELECT 0, ((SELECT sum("end" - start) FROM features) - (SELECT sum(bases) FROM c))::BIGINT""",
    "features", "reads",
)
_add(
    "coverage_histogram",
    lambda s, d: iv.coverage_histogram(iv.coverage_counts(b.features(s, d), _good(s, d), 30, **SHORT), 30),
    RUNS.format(f"(SELECT * FROM reads WHERE {GOOD})")
    + """, c AS (SELECT least(r.cov, 30) AS cov, sum(least(f."end", r."end") - greatest(f.start, r.start))::BIGINT AS bases FROM features f JOIN runs r ON f.contig = r.contig AND f."end" > r.start AND f.start < r."end" WHERE r.cov > 0 GROUP BY 1),
    a AS (SELECT cov, bases FROM c UNION ALL SELECT 0, ((SELECT sum("end" - start) FROM features) - (SELECT sum(bases) FROM c))::BIGINT),
    l AS (SELECT i AS cov, coalesce(a.bases, 0)::BIGINT AS bases FROM range(31) t(i) LEFT JOIN a ON a.cov = i)
    SELECT cov, bases, (sum(bases) OVER (ORDER BY cov DESC))::DOUBLE / (sum(bases) OVER ())::DOUBLE AS fraction FROM l""",
    "features", "reads",
)
_add(
    "mean_coverage_all",
    lambda s, d: iv.mean_coverage_all(b.features(s, d), _good(s, d), ["id"], **SHORT),
    f""", m AS (SELECT sum(least(f."end", r."end") - greatest(f.start, r.start))::BIGINT AS bases FROM features f JOIN reads r ON {OVERLAP} WHERE {GOOD})
    SELECT bases, (SELECT sum("end" - start)::BIGINT FROM features) AS length, bases / (SELECT sum("end" - start)::BIGINT FROM features) AS mean_cov FROM m""",
    "features", "reads",
)
_add(
    "independent",
    lambda s, d: iv.independent(b.features(s, d).withColumn("end", F.col("start") + 20 + F.col("id") % 3 * 11), ["contig", "strand"]),
    """, f AS (SELECT * REPLACE (start + 20 + id % 3 * 11 AS "end") FROM features),
    m AS (SELECT contig, strand, start, max("end") OVER (PARTITION BY contig, strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f)
    SELECT contig, strand, bool_and(coalesce(reach <= start, true)) AS independent FROM m GROUP BY 1, 2""",
    "features",
)
_add(
    "neighbours",
    lambda s, d: iv.ordered.neighbour_count(b.points(s, d).select("id", "contig", "pos"), ["contig"], "pos", 25, "neighbours", 1024),
    " SELECT id, contig, pos, (count(*) OVER (PARTITION BY contig ORDER BY pos RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) - 1)::BIGINT AS neighbours FROM points",
    "points",
)
_add(
    "check_intervals",
    lambda s, d: iv.check_intervals(b.reads(s, d).select("qname", "read_no", "contig", "start", F.when(F.col("mapq") == 0, F.col("start")).otherwise(F.col("end") * 2).alias("end")), b.contigs(s, d).where("ordinal < 6")).groupBy("problem").agg(F.count(F.lit(1)).alias("n")),
    """, r AS (SELECT contig, start, CASE WHEN mapq = 0 THEN start ELSE "end" * 2 END AS "end" FROM reads)
    SELECT CASE WHEN c.contig IS NULL THEN 'unknown contig' WHEN start >= "end" THEN 'empty' WHEN start < 0 OR "end" > length THEN 'outside contig' END AS problem, count(*) AS n
    FROM r LEFT JOIN (SELECT * FROM contigs WHERE ordinal < 6) c USING (contig) GROUP BY 1""",
    "reads", "contigs",
)
_add("tiles", lambda s, d: iv.tile(b.features(s, d), 40, 10, complete=False).select("id", "contig", "start", "end"), ' SELECT id, contig, unnest(range(start, "end" - 10, 30)) AS start, unnest(range(start, "end" - 10, 30)) + 40 AS "end" FROM features', "features")
_add("bins_equal", lambda s, d: iv.bins(b.contigs(s, d), 500, True), ' SELECT contig, (length % 500) // 2 + i * 500 AS start, (length % 500) // 2 + i * 500 + 500 AS "end", i AS bin FROM (SELECT *, unnest(range(length // 500)) AS i FROM contigs)', "contigs")
_add(
    "bins_unequal",
    lambda s, d: iv.bins(b.contigs(s, d), 700, False),
    """, n AS (SELECT *, (length + 699) // 700 AS n FROM contigs), q AS (SELECT *, (length + n - 1) // n AS big FROM n), x AS (SELECT *, n - (n * big - length) AS nbig, unnest(range(n)) AS i FROM q)
    SELECT contig, i * big - greatest(0, i - nbig) AS start, (i + 1) * big - greatest(0, i + 1 - nbig) AS "end", i AS bin FROM x""",
    "contigs",
)
_add(
    "bin_counts",
    lambda s, d: iv.bins(b.contigs(s, d), 500, True).join(_binned(s, d), ["contig", "bin"], "left").select("contig", "start", "end", F.coalesce("n", F.lit(0)).cast("long").alias("n")),
    f""", g AS (SELECT contig, CASE WHEN strand = '-' THEN "end" - 1 ELSE start END AS pos FROM reads WHERE {GOOD}),
    k AS (SELECT contig, (pos - (length % 500) // 2) // 500 AS bin, count(*) AS n FROM g JOIN contigs USING (contig) WHERE pos >= (length % 500) // 2 GROUP BY 1, 2),
    x AS (SELECT contig, length, unnest(range(length // 500)) AS i FROM contigs)
    SELECT x.contig, (length % 500) // 2 + i * 500 AS start, (length % 500) // 2 + i * 500 + 500 AS "end", coalesce(k.n, 0)::BIGINT AS n FROM x LEFT JOIN k ON k.contig = x.contig AND k.bin = i""",
    "reads", "contigs",
)


def _binned(spark, d):
    rows = _good(spark, d).select("contig", rd.anchor("readstart").alias("pos")).join(F.broadcast(b.contigs(spark, d)), "contig")  # eight contigs
    rows = rows.select("contig", iv.equal_bin(F.col("pos"), F.col("length"), 500).alias("bin")).where("bin is not null")
    return rows.groupBy("contig", "bin").agg(F.count(F.lit(1)).alias("n"))


_add(
    "bin_of_points",
    lambda s, d: iv.bin_of_points(b.points(s, d).select("id", "contig", "pos"), iv.bins(b.contigs(s, d).where("ordinal < 7"), 700, False).where("bin % 4 <> 3")),
    """, c AS (SELECT * FROM contigs WHERE ordinal < 7), n AS (SELECT *, (length + 699) // 700 AS n FROM c), q AS (SELECT *, (length + n - 1) // n AS big FROM n), x AS (SELECT *, n - (n * big - length) AS nbig, unnest(range(n)) AS i FROM q),
    b AS (SELECT contig, i * big - greatest(0, i - nbig) AS start, (i + 1) * big - greatest(0, i + 1 - nbig) AS "end", i AS bin FROM x WHERE i % 4 <> 3)
    SELECT p.id, p.contig, p.pos, b.bin, CASE WHEN c.contig IS NULL THEN 'nochr' WHEN b.bin IS NULL THEN 'nobin' ELSE 'found' END AS outcome
    FROM points p LEFT JOIN c ON c.contig = p.contig LEFT JOIN b ON b.contig = p.contig AND p.pos >= b.start AND p.pos < b."end" """,
    "points", "contigs",
)
_add(
    "chromosome_arms",
    lambda s, d: iv.chromosome_arms(b.contigs(s, d), b.contigs(s, d).select("contig", (F.col("ordinal") * 500 + 1000).cast("long").alias("start"), (F.col("ordinal") * 500 + 1600).cast("long").alias("end")), named=True),
    """ SELECT contig, 0::BIGINT AS start, (ordinal * 500 + 1000)::BIGINT AS "end", contig || '_ArmL' AS name FROM contigs UNION ALL SELECT contig, (ordinal * 500 + 1600)::BIGINT, length, contig || '_ArmR' FROM contigs""",
    "contigs",
)
_add(
    "flatten_bedgraph",
    lambda s, d: iv.coverage(iv.merge_intervals(_good_all(s, d), ["sample", "contig"], 0, chunk=1024), chunk=1024),
    """, m AS (SELECT sample, contig, start, "end", max("end") OVER (PARTITION BY sample, contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM reads WHERE flag & 4 = 0),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach - start < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
    u AS (SELECT sample, contig, min(start) AS start, max("end") AS "end" FROM g GROUP BY sample, contig, island)"""
    + RUNS.format("u") + ' SELECT contig, start, "end", cov FROM runs WHERE "end" IS NOT NULL AND cov > 0',
    "reads",
)
