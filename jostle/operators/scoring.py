"""Scoring: the column scorer, the Python model surface and decompositions of summed scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jostle.functions import scores as S
from jostle.functions.outcomes import transition_code
from jostle.functions.ints import div
from jostle.operators.events import BLOCK_BINS
from jostle.plans.joins import attach
from jostle.plans.staging import stage


@dataclass(frozen=True)
class LinearScorer:
    """``score(c) = sum over cells of n * weight(c, f, t)``.

    ``weight`` returns a SQL expression for class ``c`` from the expressions of feature and bin, so a
    scorer stays inside generated code.
    """

    classes: int
    weight: Callable[[int, str, str], str]

    def clean(self, cells: DataFrame) -> DataFrame:
        """One score array per source; partial sums leave one row per task and source to shuffle."""
        sums = [F.expr(f"sum(n * {self.weight(c, 'f', 't')})").alias(f"__s{c}") for c in range(self.classes)]
        return cells.groupBy("source_id", "horizon").agg(
            *sums, F.sum("n").alias("input_count"), F.count(F.lit(1)).alias("nonzero")
        ).select(
            "source_id", "horizon", F.array(*[f"__s{c}" for c in range(self.classes)]).alias("scores"),
            "input_count", "nonzero",
        )

    def moved(self, clean_scores: str, f: str, from_bin: str, to_bin: str) -> Column:
        """Scores of a neighbor from those of its source."""
        scores = [
            f"{clean_scores}[{c}] + {self.weight(c, f, to_bin)} - {self.weight(c, f, from_bin)}" for c in range(self.classes)
        ]
        return F.expr(f"array({', '.join(scores)})")


def score_sources(
    cells: DataFrame, scorer: LinearScorer, label: Callable[[Column, Column], Column], known: DataFrame | None = None
) -> DataFrame:
    """Source table: clean scores, prediction, label (from id and clean prediction) and margin.

    ``known`` (source_id, horizon) lists all sources; those without a cell are scored as empty inputs.
    """
    clean = scorer.clean(cells)
    if known is not None:
        empty = F.array(*[F.lit(0).cast("long") for _ in range(scorer.classes)])
        clean = known.select("source_id", "horizon").join(clean.drop("horizon"), "source_id", "left").withColumns({
            "scores": F.coalesce(F.col("scores"), empty.cast(clean.schema["scores"].dataType)),
            "input_count": F.coalesce("input_count", F.lit(0)), "nonzero": F.coalesce("nonzero", F.lit(0)),
        })
    clean = clean.withColumn("clean_prediction", S.predict(F.col("scores")).cast("long"))
    return clean.withColumn("label", label(F.col("source_id"), F.col("clean_prediction")).cast("long")).withColumns(
        {
            "clean_correct": F.col("label") == F.col("clean_prediction"),
            "clean_margin": S.top_margin(F.col("scores")),
        }
    )


def score_moves(
    cells: DataFrame, sources: DataFrame, scorer: LinearScorer, keep_scores: bool = True, keep_opposite: bool = False, **how
) -> DataFrame:
    """The candidate fact table: every move with its prediction and outcome code, and the score
    arrays of neighbor and source unless ``keep_scores`` is off. ``keep_opposite`` adds the prediction of the
    other move of the same cell (NULL without one), so that pairs need no second meeting.

    Source columns are attached to the cells, half as many rows as moves. Both neighbors of a cell
    are scored on the cell's row and only then exploded: the generator keeps later filters on the
    outcome from repeating the scoring expressions.
    """
    lookup = sources.select("source_id", "label", "clean_prediction", F.col("scores").alias("clean_scores"))
    wide = attach(cells, lookup, ["source_id"], spread=F.struct("t", "f"), **how)
    t, f = F.col("t"), F.col("f")
    scored = wide.withColumns({
        "__s0": scorer.moved("clean_scores", "f", "t", "t - 1"),
        "__s1": scorer.moved("clean_scores", "f", "t", "t + 1"),
    }).withColumns({"__p0": S.predict(F.col("__s0")).cast("long"), "__p1": S.predict(F.col("__s1")).cast("long")})
    sides = []
    for i, (step, exists) in enumerate(((-1, t > 0), (1, t + 1 < F.col("horizon")))):
        fields = [F.lit(step).alias("direction"), F.col(f"__p{i}").alias("prediction")]
        if keep_scores:
            fields.append(F.col(f"__s{i}").alias("scores"))
        if keep_opposite:
            other = t + 1 < F.col("horizon") if i == 0 else t > 0
            fields.append(F.when(other, F.col(f"__p{1 - i}")).alias("opposite"))
        sides.append(F.when(exists, F.struct(*fields)))
    exploded = scored.withColumn("__move", F.explode(F.array(*sides))).where(F.col("__move").isNotNull())
    direction, prediction = F.col("__move.direction"), F.col("__move.prediction")
    index = []
    if "cand0" in cells.columns:
        index = [(F.col("cand0") + F.when((direction > 0) & (t > 0), 1).otherwise(0)).alias("cand")]
    vectors = [F.col("__move.scores").alias("scores"), "clean_scores"] if keep_scores else []
    if keep_opposite:
        vectors.append(F.col("__move.opposite").alias("opposite_prediction"))
    code = transition_code(F.col("label"), F.col("clean_prediction"), prediction, scorer.classes)
    return exploded.select(
        "source_id", *index, t.alias("from_bin"), (t + direction).alias("to_bin"), f.alias("feature"),
        direction.alias("direction"), F.col("n").alias("multiplicity"), "horizon", "label", "clean_prediction",
        prediction.alias("candidate_prediction"), code.cast("long").alias("transition_code"), *vectors,
    )


def tensors(cells: DataFrame) -> DataFrame:
    """One model input per source as parallel arrays (t, f, n), assembled in two steps.

    A model reads a whole input at once, so this is the one place a source becomes a row; its size
    is bounded by bins x features of one input, not by its number of events.
    """
    entry = F.struct("t", "f", "n")
    blocks = cells.groupBy("source_id", "horizon", div(F.col("t"), BLOCK_BINS).alias("block")).agg(
        F.sort_array(F.collect_list(entry)).alias("part")
    )
    whole = blocks.groupBy("source_id", "horizon").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "part"))), lambda b: b["part"])).alias("cells")
    )
    return whole.select(
        "source_id", "horizon",
        F.col("cells.t").alias("ts"), F.col("cells.f").alias("fs"), F.col("cells.n").alias("ns"),
    )


def score_batches(
    inputs: DataFrame,
    make_model: Callable[[], Callable],
    width: int,
    padded: str = "horizon",
    group: str | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Apply a frozen model to padded batches through Arrow.

    ``inputs`` are :func:`tensors` with a column ``padded``, the number of bins to feed. The rows of a ``group``
    are one batch, fed in order of source (or backwards) at the length of its longest ``padded``; without
    ``group`` every row is a batch of one. So a result never depends on how rows lie in partitions, and a task holds
    one group: rows x bins x ``width`` values. ``make_model`` runs once per task and returns
    ``model(batch, lengths) -> scores`` for a ``[B, T, width]`` batch with valid lengths. A non-finite or misshapen
    result fails the job.
    """
    made: list = []

    def score(rows):
        import numpy as np
        import pandas as pd

        if not made:
            made.append(make_model())
        rows = rows.sort_values("source_id", ascending=not reverse)
        batch = np.zeros((len(rows), int(rows[padded].max()), width), dtype=np.float64)
        for i, (ts, fs, ns) in enumerate(zip(rows["ts"], rows["fs"], rows["ns"])):
            batch[i, np.asarray(ts, dtype=int), np.asarray(fs, dtype=int)] = np.asarray(ns)
        result = np.asarray(made[0](batch, rows["horizon"].to_numpy()))
        if result.ndim != 2 or len(result) != len(rows) or not np.isfinite(result).all():
            raise ValueError("invalid score output")
        return pd.DataFrame({"source_id": rows["source_id"].to_numpy(), "scores": list(result)})

    def alone(frames: Iterator) -> Iterator:
        for frame in frames:
            for i in range(len(frame)):
                yield score(frame.iloc[i : i + 1])

    schema = "source_id long, scores array<double>"
    if group is None:
        return inputs.mapInPandas(alone, schema)
    return inputs.groupBy(group).applyInPandas(score, schema)


def softmax_time_sum(logits: DataFrame, keys: list[str], column: str, classes: int) -> DataFrame:
    """Per-step softmax of a logit array summed over the steps of ``keys``.

    The softmax is local to the row and the sum is partial before the shuffle.
    """
    steps = logits.withColumn("__p", S.softmax(F.col(column)))
    sums = [F.sum(F.get("__p", F.lit(c))).alias(f"__s{c}") for c in range(classes)]
    return steps.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"__s{c}" for c in range(classes)]).alias("scores"))


def prefix_extra_split(logits: DataFrame, column: str, classes: int) -> DataFrame:
    """Summed scores split into valid bins (t < horizon) and added bins, with the predictions
    under each part and the two consistency errors.

    ``logits`` are rows (source_id, horizon, padded_horizon, t, <array>).
    """
    steps = logits.withColumn("__p", S.softmax(F.col(column)))
    valid = F.col("t") < F.col("horizon")
    aggs = []
    for c in range(classes):
        p = F.get("__p", F.lit(c))
        aggs.append(F.sum(p).alias(f"__a{c}"))
        aggs.append(F.sum(F.when(valid, p).otherwise(0.0)).alias(f"__v{c}"))
        aggs.append(F.sum(F.when(valid, 0.0).otherwise(p)).alias(f"__e{c}"))
    arrays = {
        name: F.array(*[f"__{mark}{c}" for c in range(classes)])
        for name, mark in (("full", "a"), ("prefix", "v"), ("extra", "e"))
    }
    split = steps.groupBy("source_id", "horizon", "padded_horizon").agg(*aggs).select(
        "source_id", "horizon", "padded_horizon", *[column.alias(name) for name, column in arrays.items()]
    )
    rebuilt = F.zip_with("prefix", "extra", lambda p, e: p + e)
    return split.select(
        "source_id", "horizon", "padded_horizon", "full", "prefix", "extra",
        S.predict(F.col("full")).cast("long").alias("padded_prediction"),
        S.predict(F.col("prefix")).cast("long").alias("prefix_prediction"),
        S.linf_change(F.col("full"), rebuilt).alias("split_error"),
        F.abs(
            F.aggregate("extra", F.lit(0.0), lambda a, x: a + x) - (F.col("padded_horizon") - F.col("horizon"))
        ).alias("mass_error"),
    )


def padding_summary(split: DataFrame, native: DataFrame, recorded: DataFrame) -> DataFrame:
    """D7, summary: one row on how padding changes labels and whether the added bins alone explain it.

    ``split`` is :func:`prefix_extra_split`, ``native`` (source_id, native_scores) the run without padding, ``recorded`` (source_id,
    native_recorded, padded_recorded) the predictions of an earlier run. Sources are those of ``split``; one without a native or recorded row is
    counted as ``incomplete`` and as a disagreement with what was recorded, but as no change.
    """
    key = "source_id"
    joined = split.join(native.select(key, "native_scores"), key, "left").join(recorded.select(key, "native_recorded", "padded_recorded"), key, "left")
    label = lambda scores: S.predict(scores).cast("long")
    named = joined.withColumns({
        "own": label(F.col("native_scores")), "with_extra": label(F.zip_with("native_scores", "extra", lambda a, b: a + b)),
        "recorded_change": F.col("native_recorded") != F.col("padded_recorded"),
    })
    own, full, prefix = F.col("own"), F.col("padded_prediction"), F.col("prefix_prediction")
    return named.agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(own.isNull() | F.col("recorded_change").isNull()).alias("incomplete"),
        F.count_if("recorded_change").alias("recorded_changes"), F.count_if(~F.col("recorded_change") & (F.col("padded_horizon") > F.col("horizon"))).alias("unchanged_with_padding"),
        F.count_if(own != full).alias("padding_label_changes"), F.count_if(own != prefix).alias("prefix_only_differs"),
        F.count_if((own != full) & (own == prefix)).alias("restored_without_extra"), F.count_if(own != F.col("with_extra")).alias("native_plus_extra_changes"),
        F.count_if(~own.eqNullSafe(F.col("native_recorded"))).alias("native_disagreements"), F.count_if(~full.eqNullSafe(F.col("padded_recorded"))).alias("padded_disagreements"),
    )


# Bins of one span: a gradient row per span instead of one per bin, with the bins beside it.
SPAN = 64


def _span(t: Column) -> Column:
    return div(t - F.pmod(t, F.lit(SPAN)), SPAN)


def spans(gradients: DataFrame) -> DataFrame:
    """(source_id, f, span, bins, gradients): the cells of a span of bins and of the bin on either side, as arrays.

    Only the first and last bin of a span are sent twice, and keys are shuffled once for a span. Of a repeated cell the largest comes first.
    """
    t = F.col("t")
    own, place = _span(t), F.pmod(t, F.lit(SPAN))
    to = F.array(own, F.when(place == 0, own - 1), F.when(place == SPAN - 1, own + 1))
    sent = gradients.where("t is not null").select("source_id", "f", F.struct(t.cast("long").alias("t"), "g").alias("c"), F.explode(F.filter(to, lambda s: s.isNotNull())).alias("span"))
    cells = F.sort_array(F.collect_list("c"), asc=False)
    return sent.groupBy("source_id", "f", "span").agg(cells.alias("cells")).select(
        "source_id", "f", "span", F.col("cells.t").alias("bins"), F.col("cells.g").alias("gradients")
    )


def gradient_moves(moves: DataFrame, gradients: DataFrame) -> DataFrame:
    """Per move the gain ``g[to] - g[from]`` for each target class; NULL where a cell has no gradient.

    ``gradients`` hold one array over targets per (source_id, t, f). They come to the moves span by span (:func:`spans`), so the moves
    are shuffled once, by the span they leave, and both ends are found in the same row. A move that does not go to a bin beside has none.
    """
    held = spans(gradients).withColumnsRenamed({"f": "feature", "span": "__span", "bins": "__bins", "gradients": "__gradients"})
    joined = moves.withColumn("__span", _span(F.col("from_bin"))).join(held, ["source_id", "feature", "__span"], "left")
    at = lambda t: F.get("__gradients", F.array_position("__bins", F.col(t).cast("long")).cast("int") - 1)
    near = F.abs(F.col("to_bin") - F.col("from_bin")) == 1
    gains = F.when(near, F.zip_with(at("to_bin"), at("from_bin"), lambda a, b: a - b))
    return joined.withColumn("gains", gains).select(*moves.columns, "gains")


def gradient_coverage(gains: DataFrame) -> DataFrame:
    """Moves of each source, and those without a gradient at one of their cells."""
    return gains.groupBy("source_id").agg(F.count(F.lit(1)).alias("moves"), F.count_if(F.col("gains").isNull()).alias("without_gradient"))


def directional_gain(gains: DataFrame, margins: DataFrame, **how) -> DataFrame:
    """Best gain over targets and best predicted target margin (margin + gain) per move."""
    joined = attach(gains, margins.select("source_id", "target_margins"), ["source_id"], spread=F.col("cand"), **how)
    return joined.select(
        "source_id", "cand",
        F.array_max("gains").alias("max_gain"),
        F.array_max(F.zip_with("gains", "target_margins", lambda g, m: g + m)).alias("max_target_margin"),
    )


def stage_sources(cells: DataFrame, scorer: LinearScorer, label) -> DataFrame:
    return stage(score_sources(cells, scorer, label), "sources")
