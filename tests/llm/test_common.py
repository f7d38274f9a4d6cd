import time
import zlib

import pytest
from pyspark.sql import functions as F

from helixlake.llm import common as c


def test_buckets(spark):
    ids = [0, 1, 7, -3, 123456789, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", c.crc_bucket("doc_id", 5).alias("b")).collect()
    assert {r["doc_id"]: r["b"] for r in rows} == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i in ids}


def test_sample_is_bounded_and_seeded(spark):
    df = spark.range(20_000).select("id", (c.F.col("id") % 2).alias("g"))
    key = c.F.xxhash64(c.F.lit("s"), "id")
    one, two = (sorted(r["id"] for r in c.seeded_sample(d, key, c.F.col("g"), 300).collect()) for d in (df, df.repartition(9)))
    assert one == two and len(one) == 600
    assert c.seeded_sample(df.limit(0), key, None, 5).count() == 0
    assert c.seeded_sample(df.where("id < 3"), key, None, 5).count() == 3


def test_sample_of_rows_with_one_key(spark):
    rows = spark.range(20_000).select(c.F.lit(7).cast("long").alias("id"), (c.F.col("id") % 2500).cast("string").alias("text"))
    key = c.F.xxhash64(c.F.lit("s"), "id", "text")
    assert c.seeded_sample(rows, key, None, 300).count() == 300  # of distinct texts
    same = spark.range(20_000).select(c.F.lit(None).cast("long").alias("id"), c.F.lit("a").alias("text"), c.F.lit(None).cast("string").alias("g"))
    assert c.seeded_sample(same, key, c.F.col("g"), 300).count() == 1


def test_stored_tables(spark, tmp_path):
    c.drop_stored(spark)
    df = c.stored(spark.range(5).toDF("x"), "t")
    assert df.count() == 5 and c.drop_stored(spark) == 1 and c.drop_stored(spark) == 0
    with pytest.raises(Exception):
        df.count()


def test_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(25))], names=["x"])
    assert [b.num_rows for b in c.sliced([batch], 10)] == [10, 10, 5]


def test_shuffles_of_the_last_query_are_released(spark):
    """Without anything that runs after it: the listeners still hold its plan then."""
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    c.release(spark)
    time.sleep(2)
    before = kept()
    table = c.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert kept() > before
    c.release(spark)
    until = time.time() + 10
    while kept() > before and time.time() < until:
        time.sleep(0.2)
    assert kept() <= before
    c.discard(table)
