"""Tables, samples, shared storage and small helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: A token of the word contracts: anything but space, tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``, which may be any path Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made, but only for a local master,
    whose executors live in the driver's process.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="helixlake-"))
    return "file://" + _own_dir[0]


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Meanwhile Python workers get at most ``rows`` rows in a batch, if given; what is run meanwhile counts, not what is planned."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        if rows:
            spark.conf.set(setting, str(rows))
        yield
    finally:
        spark.conf.set(setting, before)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends here.

    Lazy results read these tables, so they stay until ``drop_stored``.  With
    ``rows``, Python workers get at most that many rows in a batch meanwhile, for
    rows that are long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with batches_of(spark, rows):
        df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stored(make(), name)``, without the tables that were stored on the way and, as far as plans are gone, their shuffle files."""
    first = len(_written)
    out = stored(make(), name)
    for path in _written[first:-1]:
        _delete(spark, path)
    del _written[first:-1]
    release(spark)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` returned and that nothing reads any more."""
    path = df._stored_at
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)
    release(df.sparkSession)


def release(spark: SparkSession) -> None:
    """Let shuffle files go: they do once the driver's heap is cleared of the plans that made them.

    Listeners hold a plan until they have heard of its end, hence the pause, and
    the last of what they heard until something else comes, hence the query.
    """
    gc.collect()
    spark.sql("select 1").collect()
    time.sleep(0.5)
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` has written in this process, once results that read them are written; how many there were."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n


def seeded_sample(df: DataFrame, key: Column, group: Column | None, most: int) -> DataFrame:
    """At most ``most`` distinct rows for each group, those with the smallest ``key`` hash.

    Two passes: numbers of keys give a hash bound that leaves a few times ``most`` rows of
    a group, and only those are ranked, so no group meets in one task whole.  The
    key should be of all columns that tell rows apart; equal rows count once, and
    the smallest key is always within the bound.
    """
    group = F.lit(0) if group is None else group
    keyed = df.withColumns({"_group": group, "_key": key})
    counts = keyed.groupBy("_group").agg(F.approx_count_distinct("_key").alias("_n"), F.min("_key").alias("_least"))
    share = F.least(F.lit(1.0), F.lit(3.0 * most + 200.0) / F.col("_n"))
    bound = F.greatest(share * F.lit(float(2**63)) * 2 - F.lit(float(2**63)), F.col("_least").cast("double"))
    near = keyed.join(F.broadcast(counts.select(F.col("_group").alias("_of"), bound.alias("_bound"))), F.col("_group").eqNullSafe(F.col("_of"))).where(F.col("_key").cast("double") <= F.col("_bound")).drop("_of", "_bound").distinct()
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_key"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank", "_key", "_group")


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that what a worker makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hex_digest(column: Column) -> Column:
    """Lower-case SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(column, 256)


def schema(**columns: str) -> T.StructType:
    """A schema of nullable columns from DDL type names."""
    return T.StructType().fromDDL(", ".join(f"`{k}` {v}" for k, v in columns.items()))
