"""The driver's tables seen as genomic ones.

Every view exists twice, as a DataFrame and as DuckDB SQL, by integer arithmetic
alone, so both sides see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BIN = 500
#: Least length of a contig; the furthest read or feature ends within ``REACH`` of five times the last part's key.
CONTIG_LENGTH, REACH = 12_000, 600
CHROMOSOMES = 8

VIEWS = {
    "contigs": "SELECT 'chr' || (i + 1) AS contig, (greatest(12000, (SELECT max(p_partkey) FROM part) * 5 + 600) + i * 37)::BIGINT AS length, i::INTEGER AS ordinal FROM range(8) t(i)",
    "reads": """
      SELECT l_orderkey AS qname, l_linenumber AS read_no, l_returnflag AS sample, 'chr' || (l_suppkey % 8 + 1) AS contig,
        l_partkey * 5 + l_linenumber AS start, l_partkey * 5 + l_linenumber + CAST(l_quantity AS BIGINT) AS "end",
        CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, CAST(round(l_tax * 100) AS INTEGER) * 5 AS mapq,
        1 + CASE WHEN round(l_discount * 100) < 8 THEN 2 ELSE 0 END + CASE WHEN round(l_discount * 100) = 10 THEN 4 ELSE 0 END
          + CASE WHEN round(l_discount * 100) = 9 THEN 8 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END
          + CASE WHEN l_suppkey % 3 = 0 THEN 32 ELSE 0 END + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END
          + CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END + CASE WHEN round(l_tax * 100) = 8 THEN 512 ELSE 0 END
          + CASE WHEN l_returnflag = 'R' THEN 1024 ELSE 0 END + CASE WHEN l_linenumber = 6 THEN 2048 ELSE 0 END AS flag
      FROM lineitem""",
    "features": """
      SELECT p_partkey AS id, 'chr' || (p_partkey % 8 + 1) AS contig, p_partkey * 5 AS start, p_partkey * 5 + p_size * 10 AS "end",
        CASE p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand, p_brand AS term, p_type AS biotype, p_name AS name
      FROM part""",
    "points": """
      SELECT event_id AS id, 'chr' || (user_id % 8 + 1) AS contig, event_id % 10000 AS pos, event_type AS kind, value AS p,
        CASE event_id % 4 WHEN 0 THEN '*' WHEN 1 THEN '+' WHEN 2 THEN '+.' ELSE '-' END AS strand
      FROM events""",
}


def sql(body: str, *views: str) -> str:
    """``body`` with the named views as common table expressions."""
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    least = table(spark, sf_dir, "part").agg(F.greatest(F.lit(CONTIG_LENGTH), F.coalesce(F.max("p_partkey"), F.lit(0)) * 5 + REACH).alias("least"))  # one row
    return spark.range(CHROMOSOMES).crossJoin(F.broadcast(least)).select(F.concat(F.lit("chr"), i + 1).alias("contig"), (F.col("least") + i * 37).alias("length"), i.cast("int").alias("ordinal"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax, discount = F.round(F.col("l_tax") * 100).cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    bit = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0))
    start = F.col("l_partkey") * 5 + F.col("l_linenumber")
    line = F.col("l_linenumber")
    flag = (
        F.lit(1) + bit(discount < 8, 2) + bit(discount == 10, 4) + bit(discount == 9, 8) + bit(F.col("l_linestatus") == "F", 16)
        + bit(F.col("l_suppkey") % 3 == 0, 32) + F.when(line % 2 == 1, F.lit(64)).otherwise(F.lit(128)) + bit(line == 7, 256)
        + bit(tax == 8, 512) + bit(F.col("l_returnflag") == "R", 1024) + bit(line == 6, 2048)
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("qname"),
        line.alias("read_no"),
        F.col("l_returnflag").alias("sample"),
        F.concat(F.lit("chr"), F.col("l_suppkey") % 8 + 1).alias("contig"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long")).alias("end"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        (tax * 5).alias("mapq"),
        flag.alias("flag"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.concat(F.lit("chr"), k % 8 + 1).alias("contig"),
        (k * 5).alias("start"),
        (k * 5 + F.col("p_size") * 10).alias("end"),
        F.when(k % 3 == 0, "+").when(k % 3 == 1, "-").otherwise(".").alias("strand"),
        F.col("p_brand").alias("term"),
        F.col("p_type").alias("biotype"),
        F.col("p_name").alias("name"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"),
        F.concat(F.lit("chr"), F.col("user_id") % 8 + 1).alias("contig"),
        (e % 10000).alias("pos"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("p"),
        F.when(e % 4 == 0, "*").when(e % 4 == 1, "+").when(e % 4 == 2, "+.").otherwise("-").alias("strand"),
    )
