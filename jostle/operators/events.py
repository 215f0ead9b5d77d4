"""Event streams to sparse count tables.

Events are ``(source_id, us, unit)`` with ``us`` an integer microsecond; cells are
``(source_id, horizon, t, f, n)``. Time is relative to the first event of a source, and an event on
the final boundary belongs to the last bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jostle.functions.ints import div
from jostle.plans.joins import attach
from jostle.plans.staging import fan_out, stage

# Fixed value: largest storable count.
MAX_COUNT = 65535
# Time bins per block wherever cells of a source are ordered.
BLOCK_BINS = 1024


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def event_bounds(events: DataFrame, step: int, source_list: DataFrame | None = None) -> DataFrame:
    """One row per source: first and last event and the horizon, at least one bin.

    Sources of ``source_list`` without events get one empty bin.
    """
    bounds = events.groupBy("source_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    if source_list is not None:
        bounds = source_list.select("source_id").distinct().join(bounds, "source_id", "left")
    length = F.coalesce(F.col("last_us") - F.col("first_us"), F.lit(0).cast("long"))
    return bounds.withColumn("horizon", F.greatest(F.lit(1).cast("long"), div(length + (step - 1), step)))


CELL = ["source_id", "horizon", "t", "f"]


def bin_events(events: DataFrame, bounds: DataFrame, step: int, units_per_feature: int = 1, cells: int | None = None, **how) -> DataFrame:
    """Counts per (source, bin, feature).

    The event table is joined to the staged bounds (broadcast when counted small, salted
    otherwise) and partially counted before the only shuffle, which is on the full cell key.
    With an expected number of ``cells`` the events are dealt to as many tasks as these need and counted there.
    """
    placed = attach(
        events.select("source_id", "us", "unit"), bounds.select("source_id", "first_us", "horizon"),
        ["source_id"], spread=F.col("us"), **how,
    )
    t = F.least(div(F.col("us") - F.col("first_us"), step), F.col("horizon") - 1)
    f = div(F.col("unit"), units_per_feature)
    placed = placed.select("source_id", "horizon", t.alias("t"), f.alias("f"))
    if cells is not None:
        placed = fan_out(placed, cells, *CELL)
    return placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


def bin_events_oracle(events: DataFrame, step: int, units_per_feature: int = 1, cells: int | None = None, **how) -> DataFrame:
    """A second route to the same cells, for cross-checks.

    Horizons come from quotient and remainder instead of a rounded-up quotient, an event is placed
    by the start of its bin, and cells are summed from unit weights.
    """
    sides = stage(events.groupBy("source_id").agg(F.min("us").alias("a"), F.max("us").alias("b")), "sides")
    joined = attach(events.select("source_id", "us", "unit"), sides, ["source_id"], spread=F.col("us"), **how)
    since = F.col("us") - F.col("a")
    length = F.col("b") - F.col("a")
    bins = div(length, step) + F.when(F.pmod(length, F.lit(step)) > 0, 1).otherwise(0)
    horizon = F.when(bins < 1, F.lit(1).cast("long")).otherwise(bins)
    full = div(since - F.pmod(since, F.lit(step)), step)
    t = F.when(full >= horizon, horizon - 1).otherwise(full)
    f = div(F.col("unit") - F.pmod(F.col("unit"), F.lit(units_per_feature)), units_per_feature)
    placed = joined.select("source_id", horizon.alias("horizon"), t.alias("t"), f.alias("f"), F.lit(1).alias("one"))
    if cells is not None:
        placed = fan_out(placed, cells, *CELL)
    return placed.groupBy(*CELL).agg(F.sum("one").alias("n"))


def grid(sources: DataFrame, width: int) -> DataFrame:
    """Every (source_id, horizon, t, f), generated per (source, block of bins) by as many tasks as the
    result needs."""
    size = sources.agg(F.coalesce(F.sum("horizon"), F.lit(0)).alias("bins")).first()["bins"] * width
    blocks = sources.select(
        "source_id", "horizon",
        F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("horizon") - 1, BLOCK_BINS))).alias("block"),
    )
    last = F.least(F.col("horizon"), (F.col("block") + 1) * BLOCK_BINS) - 1
    return (
        fan_out(blocks, size, "source_id", "block")
        .select("source_id", "horizon", F.explode(F.sequence(F.col("block") * BLOCK_BINS, last)).alias("t"))
        .select("source_id", "horizon", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("f"))
    )


def densify(cells: DataFrame, sources: DataFrame, width: int) -> DataFrame:
    """Every (t, f) of every source, zero where no event fell.

    The zero grid is united with the cells, so the result is one aggregation on the cell key; no
    join on the source id is needed.
    """
    return (
        grid(sources, width).withColumn("n", F.lit(0).cast("long"))
        .unionByName(cells.select("source_id", "horizon", "t", "f", "n"))
        .groupBy("source_id", "horizon", "t", "f")
        .agg(F.sum("n").alias("n"))
    )


def validate_counts(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Violation counts per rule for a column that must hold counts."""
    v = F.col(value).cast("double")
    finite = ~(F.isnan(v) | v.isin(float("inf"), float("-inf")))
    rules = {
        "missing": v.isNull(),
        "not_finite": v.isNotNull() & ~finite,
        "negative": finite & (v < 0),
        "not_integral": finite & (v != F.floor(v)),
        "too_large": finite & (v > MAX_COUNT),
    }
    return values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(rule).alias(name) for name, rule in rules.items()]
    )


def validate_events(events: DataFrame, units: int, seq: str, block_rows: int = 65536, ties: Sequence[str] = ()) -> DataFrame:
    """Per source, events without a time, with a unit outside ``[0, units)`` or earlier than
    their predecessor in ``seq`` order; events of one ``seq`` are ordered by ``ties``.

    Predecessors are found inside blocks of ``seq``; the first event of a block is compared with
    the last one of the source's previous block, so a long source is never one window.
    """
    rows = events.withColumn("block", div(F.col(seq), block_rows))
    inside = Window.partitionBy("source_id", "block").orderBy(seq, *ties)
    flagged = rows.withColumn("previous", F.lag("us").over(inside))
    per_block = flagged.groupBy("source_id", "block").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("us").isNull()).alias("missing_time"),
        F.count_if((F.col("unit") < 0) | (F.col("unit") >= units) | F.col("unit").isNull()).alias("unit_out_of_range"),
        F.count_if(F.col("us") < F.col("previous")).alias("decreasing"),
        F.min_by("us", F.struct(seq, *ties)).alias("first"),
        F.max_by("us", F.struct(seq, *ties)).alias("last"),
    )
    across = Window.partitionBy("source_id").orderBy("block")
    return (
        per_block.withColumn("edge", F.when(F.col("first") < F.lag("last").over(across), 1).otherwise(0))
        .groupBy("source_id")
        .agg(
            F.sum("events").alias("events"),
            F.sum("missing_time").alias("missing_time"),
            F.sum("unit_out_of_range").alias("unit_out_of_range"),
            (F.sum("decreasing") + F.sum("edge")).alias("decreasing"),
        )
    )


def content_fingerprint(cells: DataFrame) -> DataFrame:
    """One SHA-256 per source over its whole count table.

    Cells are hashed per block of bins (bounded by bins x features) and the block digests, in
    block order, are hashed again; no row ever holds a whole source.
    """
    entry = F.struct("t", "f", F.concat_ws(",", "t", "f", "n").alias("text"))
    block_hash = F.sha2(
        F.concat_ws("|", F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"])), 256
    )
    blocks = (
        cells.withColumn("block", div(F.col("t"), BLOCK_BINS))
        .groupBy("source_id", "horizon", "block")
        .agg(block_hash.alias("digest"))
    )
    digests = F.transform(F.sort_array(F.collect_list(F.struct("block", "digest"))), lambda e: e["digest"])
    return blocks.groupBy("source_id", "horizon").agg(
        F.sha2(F.concat_ws("|", F.col("horizon").cast("string"), F.concat_ws("|", digests)), 256).alias("fingerprint")
    )
