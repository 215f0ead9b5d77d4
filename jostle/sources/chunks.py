"""Chunked output that can be resumed: finished chunks are skipped, foreign ones rejected."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def pending_chunks(df: DataFrame, chunk: str, done: DataFrame | None) -> DataFrame:
    """Rows of chunks that are not stored yet. Reading only the partition column of ``done``
    touches no data files' contents."""
    if done is None:
        return df
    return df.join(done.select(chunk).distinct(), chunk, "left_anti")


def write_pending(df: DataFrame, chunk: str, path: str, contract: str) -> DataFrame:
    """Append the missing chunks under ``path`` and return everything stored.

    Every row carries the contract id it was made under; a stored chunk of another contract stops
    the write. Chunks are partition folders, and only those of this job are replaced, so a job that
    was lost half-way is simply run again.
    """
    spark = df.sparkSession
    done = read_chunks(spark, path)
    if done is not None and not done.where(F.col("contract") != contract).isEmpty():
        raise ValueError("stored chunks belong to another contract")
    # Rebalancing groups a chunk's rows into few files and splits a chunk that is too large for one task.
    (
        pending_chunks(df.withColumn("contract", F.lit(contract)), chunk, done)
        .hint("rebalance", chunk)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(path)
    )
    return spark.read.parquet(path)
