"""Running aggregates along a coordinate, in two levels.

A window over a whole contig would put every row of the contig into one task.
Here rows are grouped into chunks of the coordinate; the window runs within a
chunk, and what came before the chunk is one number, from a window over the
chunks' totals.  The totals are one row a chunk, so their number is bounded by
the coordinate's range over the chunk, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def chunk_of(position: Column, width: int = CHUNK) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def _offsets(df: DataFrame, keys: list[str], total: Column, combine, backward: bool = False) -> DataFrame:
    totals = df.groupBy(*keys, "_chunk").agg(total.alias("_total"))
    order = F.col("_chunk").desc() if backward else F.col("_chunk")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_chunk", combine("_total").over(before).alias("_offset"))


def _with_offset(df: DataFrame, keys: list[str], offsets: DataFrame) -> DataFrame:
    return df.join(offsets, [*keys, "_chunk"], "left")


def running_sum(df: DataFrame, keys: list[str], position: str, value: str, name: str, order: list | None = None, chunk: int = CHUNK) -> DataFrame:
    """Sum of ``value`` up to and with each row, in order of ``position`` within ``keys``."""
    df = df.withColumn("_chunk", chunk_of(F.col(position), chunk))
    offsets = _offsets(df, keys, F.sum(value), F.sum)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*(order or [position])).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce("_offset", F.lit(0)) + F.sum(value).over(inside)
    return _with_offset(df, keys, offsets).withColumn(name, total).drop("_chunk", "_offset")


def running_max(df: DataFrame, keys: list[str], position: str, value: str, name: str, order: list | None = None, exclusive: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Largest ``value`` up to each row, without the row itself if ``exclusive``; null if there is none."""
    df = df.withColumn("_chunk", chunk_of(F.col(position), chunk))
    offsets = _offsets(df, keys, F.max(value), F.max)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*(order or [position])).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    most = F.greatest(F.col("_offset"), F.max(value).over(inside))
    return _with_offset(df, keys, offsets).withColumn(name, most).drop("_chunk", "_offset")


def next_position(df: DataFrame, keys: list[str], position: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """The next larger position within ``keys``, whose positions are distinct; null at the end."""
    df = df.withColumn("_chunk", chunk_of(F.col(position), chunk))
    offsets = _offsets(df, keys, F.min(position), F.min, backward=True)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(position)
    return _with_offset(df, keys, offsets).withColumn(name, F.coalesce(F.lead(position).over(inside), F.col("_offset"))).drop("_chunk", "_offset")


def neighbour_count(df: DataFrame, keys: list[str], position: str, flank: int, name: str, chunk: int | None = None) -> DataFrame:
    """How many other rows of ``keys`` lie within ``flank`` of each.

    Counts of distinct positions are put into the chunk they lie in and, near an
    edge, into the chunk beside it, so each chunk's window sees all it needs.
    Rows without a position have no count.
    """
    chunk = max(chunk or CHUNK, flank + 1)
    counts = df.where(F.col(position).isNotNull()).groupBy(*keys, position).agg(F.count(F.lit(1)).alias("_n"))
    home = chunk_of(F.col(position), chunk)
    low, high = chunk_of(F.col(position) - flank, chunk), chunk_of(F.col(position) + flank, chunk)
    seen = counts.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(low, high)))
    around = Window.partitionBy(*keys, "_chunk").orderBy(position).rangeBetween(-flank, flank)
    seen = seen.withColumn("_sum", F.sum("_n").over(around)).where("_chunk = _home").select(*keys, position, (F.col("_sum") - 1).alias(name))
    return df.join(seen, [*keys, position], "left").select(*df.columns, name)
