"""The first k rows of every group, for any k and groups of any size, without ordering a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jostle.plans.joins import attach
from jostle.plans.staging import stage, staged

#: Up to so many rows a group, Spark itself limits each task before the shuffle.
TASK_ROWS = 1_000
#: Buckets of a histogram, and rows that may be ordered beyond the k of a group.
BUCKETS, SPARE = 256, 1_000


def ranked(rows: DataFrame, keys: Sequence[str], score: str, tie: str, out: str = "rank") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())
    return rows.withColumn(out, F.row_number().over(order))


def _narrowed(rows: DataFrame, keys: Sequence[str], value: Column, cuts: DataFrame) -> DataFrame:
    """One round: in each group the histogram bucket in which the k-th value lies becomes the new range."""
    inside = attach(rows.select(*keys, value.alias("__v")), cuts, list(keys), spread=F.col("__v")).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
    share = (F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    bucket = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0).cast("long"))
    counted = inside.groupBy(*keys, bucket.alias("__bucket")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.max("__need").alias("__need")
    )
    above = F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1))  # BUCKETS rows a group
    placed = counted.withColumn("__above", F.coalesce(above, F.lit(0)))
    here = placed.where((F.col("__above") < F.col("__need")) & (F.col("__above") + F.col("__n") >= F.col("__need")))
    return stage(here.select(*keys, F.col("__least").alias("__lo"), F.col("__most").alias("__hi"), (F.col("__need") - F.col("__above")).alias("__need"), F.col("__n").alias("__rows")), "cuts")


def _cut(rows: DataFrame, keys: Sequence[str], value: Column, needs: DataFrame, spare: int) -> DataFrame:
    """(keys, __lo, __need, __rows): ``value`` from __lo on leaves few rows beyond the wanted ones, or __lo alone is too many."""
    ends = attach(rows, needs, list(keys), spread=value).groupBy(*keys).agg(
        F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.max("__need").alias("__need"), F.count(F.lit(1)).alias("__rows")
    )
    open_, done = stage(ends, "cuts"), None
    while True:
        ready = (F.col("__rows") <= F.col("__need") + spare) | (F.col("__lo") == F.col("__hi"))
        finished = open_.where(ready)
        done = finished if done is None else done.unionByName(finished)
        left = open_.where(~ready)
        if left.isEmpty():
            return stage(done, "cut")
        open_ = _narrowed(rows, keys, value, left)


def top_k(rows: DataFrame, keys: Sequence[str], score: str, tie: str, k: int, out: str = "rank", task_rows: int = TASK_ROWS, spare: int = SPARE) -> DataFrame:
    """The first ``k`` rows of each group by ``score`` descending, then ``tie`` ascending (numbers, unique in a group), with their rank.

    Up to ``task_rows`` the literal bound of a window does it. Beyond, the place of the k-th score is found by histograms of each group that
    are refined until few rows are left in its bucket (256 counters a group and round), equal scores in the same way by ``tie``; only
    the rows up to that place are ordered. A score that is NULL or not finite has no place in a histogram: then the window does it all.
    """
    keys = list(keys)
    if k <= task_rows:
        return ranked(rows, keys, score, tie, out).where(F.col(out) <= k)
    rows = staged(rows, "scores")
    value, order = F.col(score).cast("double"), -F.col(tie).cast("double")
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    if not rows.where(odd).isEmpty():
        return ranked(rows, keys, score, tie, out).where(F.col(out) <= k)
    sizes = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")), "sizes")
    large = sizes.where(F.col("__size") > k).select(*keys, F.lit(k).cast("long").alias("__need"))
    cuts = _cut(rows, keys, value, large, spare)
    # Groups in which one score has more rows than are wanted: a cut among these, by the tie.
    tied = cuts.where((F.col("__rows") > F.col("__need") + spare)).select(*keys, F.col("__lo").alias("__score"), "__need")
    at = attach(rows, tied.select(*keys, "__score"), keys, spread=F.col(tie)).where(value == F.col("__score"))
    ties = _cut(at.select(*keys, tie), keys, order, tied.select(*keys, "__need"), spare).select(*keys, F.col("__lo").alias("__tie"))
    limits = stage(cuts.select(*keys, F.col("__lo").alias("__from")).join(ties, keys, "left"), "limits")
    kept = attach(rows, limits, keys, how="left", spread=F.col(tie))
    low = F.col("__from").isNull() | (value > F.col("__from")) | ((value == F.col("__from")) & (F.col("__tie").isNull() | (order >= F.col("__tie"))))
    return ranked(kept.where(low).drop("__from", "__tie"), keys, score, tie, out).where(F.col(out) <= k)
