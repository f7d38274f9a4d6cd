"""Queries over sequences: the driver's texts as sequence records."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.operators import sequences as sq
from helixlake.plans import bindings as b

QUERIES, ORACLES = {}, {}


def _add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _docs(s, d):
    return b.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("seq"))


UPPER = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_add(
    "motif_sites",
    lambda s, d: sq.find_motif(_docs(s, d), "GATC").unionByName(sq.find_motif(_docs(s, d), "ATA")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").cast("long").alias("first"), F.sum("at").alias("total")),
    f"WITH u AS (SELECT doc_id, {UPPER} AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(length(t))) AS i FROM u) SELECT doc_id, count(*) AS n, min(i)::BIGINT AS first, sum(i)::BIGINT AS total FROM p WHERE substr(t, i + 1, 4) = 'GATC' OR substr(t, i + 1, 3) = 'ATA' GROUP BY 1",
)
_add(
    "reverse_complement",
    lambda s, d: _docs(s, d).select("doc_id", F.md5(sq.reverse_complement("seq")).alias("digest")),
    "SELECT doc_id, md5(array_to_string(list_reverse(string_split(translate(coalesce(text, ''), 'ACGTRYSWKMBDHVNacgtryswkmbdhvn', 'TGCAYRSWMKVHDBNtgcayrswmkvhdbn'), '')), '')) AS digest FROM documents",
)
_add(
    "wrap_lines",
    lambda s, d: _docs(s, d).select("doc_id", F.md5(sq.wrap(F.regexp_replace("seq", "\n", " "), 60)).alias("digest")),
    "WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS x FROM documents) SELECT doc_id, md5(array_to_string(list_transform(range(0, length(x), 60), lambda i: substr(x, (i + 1)::BIGINT, 60)), chr(10))) AS digest FROM t",
)
_add(
    "splice",
    lambda s, d: _docs(s, d).select("doc_id", sq.splice("seq", F.lit("GATTACA"), 5, 12).alias("x")).select("doc_id", F.md5("x.chimera").alias("chimera"), "x.excised"),
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents) SELECT doc_id, md5(substr(x, 1, 5) || 'GATTACA' || substr(x, 13)) AS chimera, substr(x, 6, 7) AS excised FROM t",
)
_add(
    "subsequences",
    lambda s, d: sq.subsequences(_docs(s, d).select(F.col("doc_id").alias("contig"), (F.col("doc_id") % 50).alias("start"), (F.length("seq") - 1).cast("long").alias("end")).where("end > start"), sq.chunked(_docs(s, d).withColumnRenamed("doc_id", "contig"), 512), 512).select("contig", "start", "end", F.md5("seq").alias("digest")),
    "WITH t AS (SELECT doc_id AS contig, doc_id % 50 AS start, (length(text) - 1)::BIGINT AS \"end\", text FROM documents WHERE text IS NOT NULL) SELECT contig, start, \"end\", md5(substr(text, start + 1, \"end\" - start)) AS digest FROM t WHERE \"end\" > start",
)
_add(
    "common_starts",
    lambda s, d: sq.common_starts(_docs(s, d), 4, 10).withColumn("ratio", F.round("ratio", 6)),
    """WITH g AS (SELECT substr(coalesce(text, ''), 1, 4) AS start, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT * FROM g ORDER BY n DESC, start LIMIT 10), c AS (SELECT count(*) AS total FROM documents)
    SELECT start, n, round(n / total, 6) AS ratio FROM (SELECT * FROM t UNION ALL SELECT 'other', (SELECT total FROM c) - (SELECT sum(n) FROM t)::BIGINT) u, c""",
)
_add("sample", lambda s, d: sq.sample(_docs(s, d), 150, ["doc_id"]).select("doc_id", F.length("seq").cast("long").alias("n")), "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n FROM documents ORDER BY md5('1234:' || doc_id), doc_id LIMIT 150")


def _mates(s, d):
    c = b.table(s, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("seq"))
    r = c.select("conv_id", F.expr("turn div 2").alias("pair"), (F.col("turn") % 2).alias("side"), F.concat(F.lit("c"), F.col("conv_id"), F.lit("."), F.expr("turn div 2"), F.when(F.col("role") == "system", "s").otherwise("")).alias("name"), "seq", F.expr("repeat('I', length(seq))").alias("qual"))
    return sq.mates(r.where("side = 0"), r.where("side = 1"), ["conv_id", "pair"])


MATES = """WITH r AS (SELECT conv_id, turn // 2 AS pair, turn % 2 AS side, 'c' || conv_id || '.' || (turn // 2) || CASE WHEN role = 'system' THEN 's' ELSE '' END AS name, coalesce(text, '') AS seq FROM conversations),
  m AS (SELECT coalesce(a.conv_id, z.conv_id) AS conv_id, coalesce(a.pair, z.pair) AS pair, a.name AS name1, a.seq AS seq1, z.name AS name2, z.seq AS seq2 FROM (SELECT * FROM r WHERE side = 0) a FULL JOIN (SELECT * FROM r WHERE side = 1) z ON a.conv_id = z.conv_id AND a.pair = z.pair)"""
_add("name_check", lambda s, d: sq.name_check(_mates(s, d)), MATES + " SELECT count(*) FILTER (WHERE name1 IS NOT NULL AND name2 IS NOT NULL) AS pairs, count(*) FILTER (WHERE name1 <> name2) AS mismatches, count(*) FILTER (WHERE name1 IS NULL OR name2 IS NULL) AS unpaired FROM m")
KEPT = MATES + """, k AS (SELECT *, CASE WHEN instr(seq1, 'the ') > 0 THEN instr(seq1, 'the ') + 3 ELSE length(seq1) END AS n1, CASE WHEN instr(seq2, 'the ') > 0 THEN instr(seq2, 'the ') + 3 ELSE length(seq2) END AS n2, instr(seq1, 'the ') > 0 AS t1, instr(seq2, 'the ') > 0 AS t2 FROM m WHERE name1 IS NOT NULL AND name2 IS NOT NULL)"""
_add("trim_counts", lambda s, d: sq.trim_counts(_mates(s, d).where("name1 is not null and name2 is not null"), "the ", 30), KEPT + " SELECT count(*) AS total, count(*) FILTER (WHERE t1) AS trim1, count(*) FILTER (WHERE t2) AS trim2, count(*) FILTER (WHERE (t1 AND n1 < 30) OR (t2 AND n2 < 30)) AS short FROM k")
_add(
    "interleave_trim",
    lambda s, d: sq.interleave(_mates(s, d).where("name1 is not null and name2 is not null"), ["conv_id", "pair"], "the ", 30).select("conv_id", "pair", "read_no", "name", F.md5("seq").alias("seq"), F.length("qual").cast("long").alias("n")),
    KEPT + """, ok AS (SELECT * FROM k WHERE NOT ((t1 AND n1 < 30) OR (t2 AND n2 < 30))) SELECT conv_id, pair, 1 AS read_no, name1 || ':1' AS name, md5(substr(seq1, 1, n1)) AS seq, n1::BIGINT AS n FROM ok UNION ALL SELECT conv_id, pair, 2, name2 || ':2', md5(substr(seq2, 1, n2)), n2::BIGINT FROM ok""",
)
_add("interleave", lambda s, d: sq.interleave(_mates(s, d).where("name1 is not null and name2 is not null"), ["conv_id", "pair"]).select("conv_id", "pair", "read_no", "name"), MATES + " SELECT conv_id, pair, 1 AS read_no, name1 || ':1' AS name FROM m WHERE name1 IS NOT NULL AND name2 IS NOT NULL UNION ALL SELECT conv_id, pair, 2, name2 || ':2' FROM m WHERE name1 IS NOT NULL AND name2 IS NOT NULL")
_add(
    "cycle_quality",
    lambda s, d: sq.cycle_quality(b.table(s, d, "conversations").select(F.coalesce("text", F.lit("")).alias("seq"), F.expr("repeat('I', length(coalesce(text, '')))").alias("qual"))),
    """WITH p AS (SELECT text, unnest(range(1, length(text) + 1)) AS cycle FROM conversations WHERE text IS NOT NULL), c AS (SELECT cycle, translate(substr(text, cycle, 1), 'acgt', 'ACGT') AS x FROM p)
    SELECT cycle::INTEGER AS cycle, count(*) AS n, 40.0::DOUBLE AS mean_quality, count(*) FILTER (WHERE x = 'A') AS a, count(*) FILTER (WHERE x = 'C') AS c, count(*) FILTER (WHERE x = 'G') AS g, count(*) FILTER (WHERE x = 'T') AS t, count(*) FILTER (WHERE x NOT IN ('A', 'C', 'G', 'T')) AS other FROM c GROUP BY 1""",
)
_add(
    "attribute_map",
    lambda s, d: b.table(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")),
    "SELECT 'k' AS key, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 2",
)
_add(
    "page_links",
    lambda s, d: b.table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("link")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("link").alias("last")),
    "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) SELECT page_id, count(*) AS n, max(link) AS last FROM l GROUP BY 1",
)
_add("fuzzy_best_match", lambda s, d: sq.best_matches(b.table(s, d, "part").select(F.col("p_name").alias("query")).distinct(), b.table(s, d, "part").select(F.col("p_type").alias("name"), F.lower("p_type").alias("seq")).distinct()))
