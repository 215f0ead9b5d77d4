"""One-count moves to an adjacent time bin: enumeration, application, cardinality, batches, panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jostle.functions.ints import div
from jostle.functions.rng import draw
from jostle.operators.events import BLOCK_BINS, MAX_COUNT
from jostle.plans.ordering import running, running_in_blocks


def _has_previous() -> Column:
    return F.col("t") > 0


def _has_next() -> Column:
    return F.col("t") + 1 < F.col("horizon")


def index_cells(cells: DataFrame) -> DataFrame:
    """Add ``cand0``: the index within the source of the first move that leaves the cell."""
    leaving = F.when(_has_previous(), 1).otherwise(0) + F.when(_has_next(), 1).otherwise(0)
    leaving = leaving.cast("long")
    numbered = running_in_blocks(
        cells, ["source_id"], div(F.col("t"), BLOCK_BINS), [F.col("t"), F.col("f")], leaving, "__upto"
    )
    return numbered.withColumn("cand0", F.col("__upto") - leaving).drop("__upto")


def enumerate_moves(cells: DataFrame, *carry: str) -> DataFrame:
    """For each occupied cell the move to the previous bin, then to the next one, if it exists.

    Narrow: each cell is exploded in place. ``cand`` is filled from ``cand0`` when the cells carry
    it; ``carry`` names further cell columns to keep.
    """
    steps = F.filter(
        F.array(F.lit(-1), F.lit(1)), lambda d: ((d < 0) & _has_previous()) | ((d > 0) & _has_next())
    )
    index = []
    if "cand0" in cells.columns:
        both = (F.col("direction") > 0) & _has_previous()
        index = [(F.col("cand0") + F.when(both, 1).otherwise(0)).alias("cand")]
    return cells.select("*", F.explode(steps).alias("direction")).select(
        "source_id",
        *index,
        F.col("t").alias("from_bin"),
        (F.col("t") + F.col("direction")).alias("to_bin"),
        F.col("f").alias("feature"),
        "direction",
        F.col("n").alias("multiplicity"),
        "horizon",
        *carry,
    )


def neighborhood_cardinality(cells: DataFrame) -> DataFrame:
    """Per source the closed form ``2*nnz - nnz(first bin) - nnz(last bin)``."""
    return cells.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("nonzero"),
        F.count_if(F.col("t") == 0).alias("first_bin"),
        F.count_if(F.col("t") == F.col("horizon") - 1).alias("last_bin"),
    ).withColumn("candidates", 2 * F.col("nonzero") - F.col("first_bin") - F.col("last_bin"))


def apply_move(moves: DataFrame, cells: DataFrame) -> DataFrame:
    """The two cells a move changes, with their counts before and after.

    The rest of the neighbor equals its source, so the neighbor stays a two-row delta. The join is
    on the full cell key, which no hot source can dominate. Moving an absent count, past the
    horizon, farther than one bin or into a full cell fails the job.
    """
    legal = (
        (F.abs(F.col("to_bin") - F.col("from_bin")) == 1)
        & F.col("to_bin").between(0, F.col("horizon") - 1)
        & F.col("from_bin").between(0, F.col("horizon") - 1)
    )
    ends = F.array(
        F.struct(F.col("from_bin").alias("t"), F.lit(-1).alias("delta")),
        F.struct(F.col("to_bin").alias("t"), F.lit(1).alias("delta")),
    )
    checked = F.when(legal, ends).otherwise(F.raise_error(F.lit("illegal move")))
    deltas = moves.select("source_id", "cand", F.col("feature").alias("f"), F.explode(checked).alias("end")).select(
        "source_id", "cand", "f", F.col("end.t").alias("t"), F.col("end.delta").alias("delta")
    )
    before = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    after = before + F.col("delta")
    guarded = (
        F.when(after < 0, F.raise_error(F.lit("no count to move")))
        .when(after > MAX_COUNT, F.raise_error(F.lit("destination count too large")))
        .otherwise(after)
    )
    return deltas.join(cells.select("source_id", "t", "f", "n"), ["source_id", "t", "f"], "left").select(
        "source_id", "cand", "t", "f", before.alias("before"), guarded.alias("after")
    )


def batch_groups(rows: DataFrame, rank: str, horizon: str, size: int = 256) -> DataFrame:
    """Contiguous groups of ``size`` ranks, padded to the longest member; ``gap`` = added bins."""
    grouped = rows.withColumn("batch", div(F.col(rank), size))
    group = Window.partitionBy("batch")  # at most ``size`` rows
    return grouped.withColumn("padded_horizon", F.max(horizon).over(group)).withColumn(
        "gap", F.col("padded_horizon") - F.col(horizon)
    )


def select_panel(sources: DataFrame, label: str, quotas: DataFrame, seed: int, largest_quota: int) -> DataFrame:
    """Per label a seeded sample without replacement of ``quota`` sources.

    ``largest_quota`` is a literal bound, so Spark keeps only that many rows per label and task
    before the shuffle.
    """
    order = Window.partitionBy(label).orderBy("__key", "source_id")
    keyed = sources.withColumn("__key", draw(seed, F.col("source_id")))
    ranked = keyed.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= largest_quota)
    return ranked.join(quotas, label).where(F.col("pick") <= F.col("quota")).drop("__key", "quota")


def select_controls(rows: DataFrame, changed: str, gap: str, k: int = 64, **how) -> DataFrame:
    """All changed rows and at most ``k`` unchanged ones with a positive gap, evenly spaced in
    id order."""
    eligible = rows.where(~F.col(changed) & (F.col(gap) > 0)).select("source_id")
    ordered = running(eligible, [], [F.col("source_id").asc()], out="place", **how)
    size = ordered.agg(F.count(F.lit(1)).alias("m"))
    kept = F.least(F.lit(k), F.col("m").cast("int"))
    spots = size.where(F.col("m") > 0).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), kept - 1),
                lambda i: div(i.cast("long") * (F.col("m") - 1), F.greatest(F.lit(1), kept - 1).cast("long")),
            )
        ).alias("spot")
    ).distinct()
    # ``spots`` has at most k rows by construction.
    picked = ordered.join(F.broadcast(spots), F.col("place") - 1 == F.col("spot")).select("source_id")
    return (
        rows.where(changed).select("source_id", F.lit("changed").alias("role"))
        .unionByName(picked.select("source_id", F.lit("control").alias("role")))
        .distinct()
    )


def select_pairs(rows: DataFrame, changed: str, group: str, groups: int = 3) -> DataFrame:
    """The first changed source of each of the first ``groups`` groups that have one, paired with
    the next member of its group (wrapping around).

    Everything is an aggregate per group; the wanted groups are a top-k.
    """
    firsts = (
        rows.where(changed).groupBy(group).agg(F.min("source_id").alias("x_source"))
        .orderBy(group).limit(groups)
    )
    members = rows.select(group, "source_id", "padded_horizon").join(F.broadcast(firsts), group)
    return members.groupBy(group, "x_source").agg(
        F.max("padded_horizon").alias("padded_horizon"),
        F.min(F.when(F.col("source_id") > F.col("x_source"), F.col("source_id"))).alias("__next"),
        F.min("source_id").alias("__first"),
    ).select(group, "x_source", F.coalesce("__next", "__first").alias("y_source"), "padded_horizon")
