"""Joins of values with a table of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jostle.plans.joins import BROADCAST_BYTES, SALTS, measured_bytes
from jostle.plans.staging import ROWS_PER_TASK, fan_out, staged

#: Buckets that the span of the values is cut into; a range lies in at most so many.
BUCKETS = 512


def interval_join(rows: DataFrame, value: str, ranges: DataFrame, lo: str = "lo", hi: str = "hi", broadcast_bytes: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """J7 with a table: every row with every range ``lo <= value <= hi``; both ends belong to it, a NULL end is open.

    Ranges may overlap, be empty or lie outside all values. A row in no range (a NULL or NaN value among them) has NULL for the
    columns of ``ranges``, and a range without a row NULL for those of ``rows``. Columns must have distinct names.

    Both sides are cut by equal buckets of the values' span: a value lies in one, a range in those it touches, and they meet by equality
    on the bucket instead of each with each. A small table of ranges, which is measured, is broadcast with its buckets; otherwise both sides
    are shuffled by bucket, and a bucket that holds much is split by salt. Rows are spread over the tasks that their pairs need.
    """
    taken = {c.lower() for c in rows.columns} & {c.lower() for c in ranges.columns}
    if taken:
        raise ValueError(f"both sides have {sorted(taken)}")
    rows, ranges = staged(rows.withColumn("__row", F.monotonically_increasing_id()), "values"), staged(ranges.withColumn("__range", F.monotonically_increasing_id()), "ranges")
    number = F.col(value).cast("double")
    usable = number.isNotNull() & ~F.isnan(number)
    inside = rows.where(usable & (F.abs(number) < float("inf")))
    low, high = inside.agg(F.min(number), F.max(number)).first()  # two numbers
    low, high = (0.0, 0.0) if low is None else (low, high)
    width = (high - low) / buckets
    # Monotone in the value, so a value within a range has a bucket within the range's.
    bucket = (lambda v: F.least(F.greatest(F.floor((v - low) / width), F.lit(0)), F.lit(buckets - 1)).cast("int")) if width > 0 else (lambda v: F.lit(0))
    start, stop = F.coalesce(F.col(lo).cast("double"), F.lit(low)), F.coalesce(F.col(hi).cast("double"), F.lit(high))
    clipped = lambda v: F.greatest(F.least(v, F.lit(high)), F.lit(low))
    whole = F.col(lo).isNull() | F.col(hi).isNull() | (F.col(lo) <= F.col(hi))
    touched = ranges.where(whole).withColumn("__bucket", F.explode(F.sequence(bucket(clipped(start)), bucket(clipped(stop)))))
    placed = rows.where(usable).withColumn("__bucket", bucket(clipped(number)))
    # What a row meets decides how many tasks are needed, not how few files the rows are in.
    counted = placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).join(touched.groupBy("__bucket").agg(F.count(F.lit(1)).alias("m")), "__bucket")
    pairs, most = counted.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)), F.coalesce(F.max(F.col("n") * F.col("m")), F.lit(0))).first()  # two numbers
    on = ["__bucket"]
    if measured_bytes(touched) <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        touched, placed = F.broadcast(touched), fan_out(placed, pairs, "__row")
    else:
        salts = min(SALTS, max(1, -(-most // ROWS_PER_TASK)))
        on = ["__bucket", "__salt"]
        placed = fan_out(placed.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int")), pairs, *on)
        touched = touched.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    holds = (F.col(lo).isNull() | (F.col(lo) <= F.col(value))) & (F.col(hi).isNull() | (F.col(value) <= F.col(hi)))
    met = staged(placed.join(touched, on).where(holds).drop(*on), "met")
    lone = rows.join(met.select("__row").distinct(), "__row", "left_anti")
    empty = ranges.join(met.select("__range").distinct(), "__range", "left_anti")
    shown = [c for c in [*rows.columns, *ranges.columns] if not c.startswith("__")]
    return met.select(*shown).unionByName(lone.drop("__row"), allowMissingColumns=True).unionByName(empty.drop("__range"), allowMissingColumns=True)
