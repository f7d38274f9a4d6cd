"""Structured Streaming over files that arrive: counts by bin, deduplication, gap islands.

Analogues of record streams: a bounded run (``availableNow``) ends when the
files do, state goes when the watermark passes it, and a coverage gap closes a
session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 16) -> DataFrame:
    """Parquet files of a directory as they come, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def bin_counts(reads: DataFrame, size: int) -> DataFrame:
    """(contig, bin, n) so far: reads by the bin that their start lies in."""
    return reads.groupBy("contig", F.floor(F.col("start") / size).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def distinct_reads(reads: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each read once; with ``time``, keys are forgotten when the watermark has passed them."""
    return reads.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time else reads.dropDuplicates(keys)


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of runs of events without a gap as long as ``gap``."""
    w = F.session_window(time, gap)
    rows = events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Run over all files there are and leave the result in an in-memory table (tests and small results)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run over all files there are, appending to Parquet; a restart goes on where the last run stopped."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
