"""Positions, mid-ranks, running totals and exact percentiles within groups of any size.

A window over one group runs in one task, so plain windows are used only when the largest group
was counted and is small. Otherwise rows are range-partitioned on (keys, order) -- which also cuts
through a hot group and through ties, since the order ends in a unique column --, staged with
their range number, and each range is ranked by itself and shifted by the rows of the group in
earlier ranges. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jostle.plans.joins import attach
from jostle.plans.staging import stage, staged as staged_once

# Largest group that one task may sort.
GROUP_ROWS = 2_000_000
ROWS_PER_RANGE = 1_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in all); one small row reaches the driver."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return (row[0] or 0), (row[1] or 0)


def _window(keys: Sequence[str]) -> Window:
    # A constant partition key keeps the "no partition" case explicit: it is only reached after
    # the count above has shown that the whole input is one small group.
    return Window.partitionBy(*(keys or [F.lit(0)]))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    weight: Column | dict[str, Column] | None = None,
    out: str = "position",
    group_rows: int | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add the running sum of ``weight`` (default 1: the 1-based position) up to and including the
    row, in ``order`` within ``keys``. ``order`` must be total within a group.

    A dict of weights gives one running sum per entry, named by it, from a single ordering.
    """
    keys = list(keys)
    if not isinstance(weight, dict):
        weight = {out: F.lit(1).cast("long") if weight is None else weight}
    staged = staged_once(df, "order")
    limit = GROUP_ROWS if group_rows is None else group_rows
    largest, total = largest_group(staged, keys)
    if largest <= limit:
        w = _window(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return staged.withColumns({name: F.sum(value).over(w) for name, value in weight.items()})
    ranges = ranges or max(8, -(-total // ROWS_PER_RANGE))
    ranged = stage(
        staged.withColumns({f"__weight_{name}": value for name, value in weight.items()})
        .repartitionByRange(ranges, *[F.col(k) for k in keys], *order)
        .withColumn("__range", F.spark_partition_id()),
        "range",
    )
    # One row per (group, range): at most ``ranges`` rows in a group.
    sums = ranged.groupBy(*keys, "__range").agg(*[F.sum(f"__weight_{name}").alias(f"__sum_{name}") for name in weight])
    before = _window(keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "__range", *[F.coalesce(F.sum(f"__sum_{name}").over(before), F.lit(0)).alias(f"__before_{name}") for name in weight]
    )
    inside = (
        _window([*keys, "__range"]).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # (group, range) pairs are as fine as the ranked pieces, so this join has no hot key.
    placed = ranged.withColumns({f"__inside_{name}": F.sum(f"__weight_{name}").over(inside) for name in weight}).join(
        offsets, [*keys, "__range"]
    )
    placed = placed.withColumns({name: F.col(f"__inside_{name}") + F.col(f"__before_{name}") for name in weight})
    return placed.drop("__range", *[f"__{part}_{name}" for part in ("weight", "inside", "before") for name in weight])


def midranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | None = None,
    out: str = "rank",
    **how,
) -> DataFrame:
    """(keys, value, ``out``): the 1-based average rank of every distinct value of a group.

    Equal values are counted before the shuffle, so ties cost one row however many there are.
    """
    count = F.sum(weight) if weight else F.count(F.lit(1))
    distinct = df.groupBy(*keys, value).agg(count.cast("long").alias("__n"))
    ordered = running(distinct, keys, [F.col(value).asc()], F.col("__n"), out="__upto", **how)
    rank = F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)
    return ordered.select(*keys, value, rank.alias(out))


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[tuple[str, float]],
    **how,
) -> DataFrame:
    """Exact linearly interpolated percentiles per group as columns named in ``probabilities``.

    Works on distinct values with their counts and never holds a group in one task.
    """
    keys = list(keys)
    distinct = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    )
    ordered = stage(running(distinct, keys, [F.col(value).asc()], F.col("__n"), out="__upto", **how), "quantile")
    totals = ordered.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    if keys:
        placed = attach(ordered, stage(totals, "totals"), keys, spread=F.col(value))
    else:
        placed = ordered.join(F.broadcast(totals))  # an ungrouped aggregate is exactly one row
    picks = []
    for name, p in probabilities:
        at = F.lit(float(p)) * (F.col("__total") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            # zero-based places (upto - n) .. (upto - 1) hold this value
            here = (place >= F.col("__upto") - F.col("__n")) & (place < F.col("__upto"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"__{name}_{side}"))
    picked = placed.groupBy(*keys).agg(F.max("__total").alias("__total"), *picks)
    columns = []
    for name, p in probabilities:
        at = F.lit(float(p)) * (F.col("__total") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        columns.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, *columns)


def running_in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[Column],
    weight: Column,
    out: str = "position",
) -> DataFrame:
    """Running sum like :func:`running` where ``block`` is a nondecreasing function of ``order``
    that bounds the rows of a (keys, block) pair by the data model, e.g. a span of time bins.

    One shuffle on (keys, block); a hot key is spread over its blocks, and only one row per block
    is ordered per key. The input is staged, because rows and block totals both read it.
    """
    keys = list(keys)
    blocked = stage(df.withColumns({"__block": block, "__weight": weight}), "blocks")
    inside = (
        _window([*keys, "__block"]).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = _window(keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, "__block")
        .agg(F.sum("__weight").alias("__sum"))
        .select(*keys, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    )
    return (
        blocked.withColumn("__inside", F.sum("__weight").over(inside))
        .join(offsets, [*keys, "__block"])
        .withColumn(out, F.col("__inside") + F.col("__before"))
        .drop("__block", "__weight", "__inside", "__before")
    )
