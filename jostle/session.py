"""Session construction and the shared folder for staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("jostle")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording a Python call site for every column expression costs more than planning them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    tune(session)
    session.sparkContext.setLogLevel("ERROR")
    return session


# Generated methods beyond HotSpot's 8000 bytes are never compiled to machine code.
# Staged tables take 3 bytes a row or less: 128 MB of them are tens of millions of rows, more than one task can sort in memory.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.files.maxPartitionBytes": str(16 * 1024 * 1024)}


def tune(spark: SparkSession) -> None:
    """Session settings for plans with wide generated expressions and for small files of many rows, left alone where already set."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, spark.conf.get(key, value))


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a temporary folder; on a cluster a machine-local path
    would be invisible to the other executors, so an unset folder is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master  # local-cluster has executors of its own
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used before."""
    return os.path.join(
        shared_folder(spark), f"jostle-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex[:12]}"
    )
