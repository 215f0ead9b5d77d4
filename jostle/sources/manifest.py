"""File digests against a manifest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of every file below ``folder`` that matches ``pattern``, hashed by the tasks
    that read them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    relative = F.regexp_replace(F.col("path"), f"^.*?{re.escape(folder.rstrip('/'))}/", "")
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of every path in either table: ok, modified, missing or unexpected. A digest in the
    manifest that is not 64 hex digits fails the job."""
    digest = F.when(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.col("sha256")).otherwise(F.raise_error(F.lit("invalid digest in manifest")))
    found = files.select("path", F.col("sha256").alias("found"), F.lit(True).alias("there"))
    joined = found.join(manifest.select("path", digest.alias("listed"), F.lit(True).alias("known")), "path", "full_outer")
    # A file whose digest is NULL is there; it just does not match.
    status = (
        F.when(F.col("there").isNull(), "missing").when(F.col("known").isNull(), "unexpected")
        .when(F.col("found").eqNullSafe(F.col("listed")), "ok").otherwise("modified")
    )
    return joined.select("path", status.alias("status"))


def manifest_difference(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """H4: paths on one side only."""
    have, want = files.select("path"), manifest.select("path")
    return want.exceptAll(have).withColumn("status", F.lit("missing")).unionByName(
        have.exceptAll(want).withColumn("status", F.lit("unexpected"))
    )
