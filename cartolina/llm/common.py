"""What the training-data operators share: inputs, scratch space on shared storage, prefix sums."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that are neither word nor part of one, for the operators that split on white space.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees; where that is unset, a temporary one if all runs in one process, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='cartolina-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows for which a task of its own is worth while, where about how many rows a table has is known before it is written.
ROWS = 1 << 13


def few(df: DataFrame, rows: int) -> DataFrame:
    """The frame in at most one task for each ROWS of its rows; tasks that hold next to nothing are joined, without a shuffle."""
    return df.coalesce(max(1, -(-rows // ROWS)))


def staged(df: DataFrame, name: str, narrow: bool = False, rows: int | None = None) -> DataFrame:
    """The frame written to shared storage and read again: its lineage ends there and outlives executors.

    narrow: its rows are a few dozen bytes, so that a shuffle to files of a sensible size costs little beside one small file a task.
    rows: about how many it has, or a bound, so that a small table isn't dealt over as many files as the session has shuffle partitions;
    it bears on the number of files alone.
    """
    path = scratch(df.sparkSession, name)
    if rows is not None and (not narrow or -(-rows // ROWS) < shuffle_parts(df.sparkSession)):
        df = df.repartition(max(1, -(-rows // ROWS))) if narrow else few(df, rows)
    elif narrow:
        df = df.hint("rebalance")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """Arrow batches of at most so many rows for the jobs within: for rows of many kB each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as long, called doc_id) and the text; every other column, whatever its name, stays out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def buckets_for(rows: int) -> int:
    """A power of two near the square root: as many buckets in a group as rows in a bucket."""
    return 1 << max(4, (max(rows, 1).bit_length() + 1) // 2)


def running(df: DataFrame, group: str, bucket: str, order: list, value, out: str) -> DataFrame:
    """df with out: the sum of value over the rows before, in its group, by bucket and order.

    Bucket must agree with order. Windows never hold more than one bucket or one row a bucket, so that a
    group with most of the rows is spread over as many tasks as it has buckets.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_in_bucket"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, bucket, F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, [group, bucket]).withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_start")
