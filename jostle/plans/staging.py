"""Staged tables: written once as Parquet in the shared folder and read back.

A staged table cuts lineage, survives the loss of executors, and is read with column pruning and
filter pushdown, so one pass over the raw events serves every later analysis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from jostle.session import fresh_path


# Once a table is written, nothing reads the shuffle files behind it; Spark then deletes them at the end of the write.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._staged_table = True
    return written


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if :func:`stage` returned it, else a staged copy."""
    return df if getattr(df, "_staged_table", False) else stage(df, name)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`stage` wrote and that no lazy result still reads."""
    if not getattr(df, "_staged_table", False):
        raise ValueError("not a staged table")
    context = df.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if folder is not None:
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


# Rows that one task may generate from its input.
ROWS_PER_TASK = 1_000_000


def fan_out(df: DataFrame, expected_rows: int, *columns: str) -> DataFrame:
    """Spread rows before each is expanded into many.

    A small table sits in few partitions, and adaptive execution would merge them further; what it
    expands to decides how many tasks are needed, so their number is fixed here.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-expected_rows // ROWS_PER_TASK))
    return df.repartition(tasks, *columns)
