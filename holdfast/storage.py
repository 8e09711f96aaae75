"""Cutting lineage: intermediate results that more than one job reads.

They are written as Parquet to the shared folder the cluster names in
``spark.checkpoint.dir``, so a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from holdfast.shipping import ship


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    # One machine, nothing set (tests): a folder of our own, kept for the session.
    own = tempfile.mkdtemp(prefix="holdfast-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches of so many rows and bytes at most: of long texts, ten thousand rows fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """The same rows, read back from a table in the shared folder. ``rows_per_file``: at most so many, for large rows (0: any).

    Shuffles that end in such a table are not read again, so their files go when it is written.
    """
    spark = df.sparkSession
    ship(spark)
    small_batches(spark)
    path = f"{shared_folder(spark)}/holdfast-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, True)
    try:
        df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, for costly row work on a scan of fewer parts than there are cores."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
