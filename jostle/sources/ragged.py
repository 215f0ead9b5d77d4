"""Flat value arrays with offsets, unpacked into (source, bin, feature) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jostle.functions.ints import div

# Flat positions per block; a segment is matched to values block by block.
BLOCK = 65536


def segments(offsets: DataFrame) -> DataFrame:
    """(source_id, start, stop) from rows (position, source_id, start) plus a closing row whose
    source_id is NULL.

    The next offset is found through blocks of positions, so no window spans all sources.
    """
    blocked = offsets.withColumn("__b", div(F.col("position"), BLOCK))
    inside = Window.partitionBy("__b").orderBy("position")
    following = blocked.withColumn("stop", F.lead("start").over(inside))
    firsts = blocked.groupBy("__b").agg(F.min_by("start", "position").alias("__next")).withColumn("__b", F.col("__b") - 1)
    return (
        following.join(firsts, "__b", "left")
        .withColumn("stop", F.coalesce("stop", "__next"))
        .where(F.col("source_id").isNotNull())
        .select("source_id", "start", "stop")
    )


def unpack_ragged(values: DataFrame, parts: DataFrame, width: int) -> DataFrame:
    """Values (pos, value) of segments [start, stop) as (source_id, t, f, value).

    The range condition start <= pos < stop is turned into an equi-join on blocks of positions: a
    segment is repeated for the blocks it touches, so a long segment is spread over many tasks.
    A segment that is empty or not a multiple of ``width`` fails the job.
    """
    length = F.col("stop") - F.col("start")
    broken = F.col("stop").isNull() | (length <= 0) | (F.pmod(length, F.lit(width)) != 0)
    blocks = F.when(broken, F.raise_error(F.lit("invalid offsets"))).otherwise(
        F.sequence(div(F.col("start"), BLOCK), div(F.col("stop") - 1, BLOCK))
    )
    touched = parts.withColumn("__b", F.explode(blocks))
    placed = values.withColumn("__b", div(F.col("pos"), BLOCK)).join(touched, "__b").where(
        (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    )
    inside = F.col("pos") - F.col("start")
    return placed.select("source_id", div(inside, width).alias("t"), F.pmod(inside, F.lit(width)).alias("f"), "value")
