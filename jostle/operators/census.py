"""Aggregates over the candidate table, in up to three weightings: per candidate, per event
(multiplicity) and per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jostle.functions import scores as S
from jostle.functions.outcomes import OUTCOMES, feature_part, outcome_name, time_part
from jostle.plans.ordering import percentiles, running
from jostle.plans.staging import stage

def _changed() -> Column:
    return F.col("transition_code") != 0


def _is(code: int) -> Column:
    return F.col("transition_code") == code


def _rate(condition: Column, within: Column | None = None) -> Column:
    """Share of rows that satisfy ``condition``; NULL when ``within`` selects none."""
    hit = F.when(condition, 1.0).otherwise(0.0)
    return F.avg(hit if within is None else F.when(within, hit))


def outcome_totals(moves: DataFrame) -> DataFrame:
    """A1: unique and event-weighted counts per outcome, any change and total; zero rows included.

    One aggregate row is turned into report rows, so no outcome can be missing.
    """
    groups = [*[(name, _is(code)) for code, name in OUTCOMES], ("class_changed", _changed()), ("total", F.lit(True))]
    aggs = []
    for name, condition in groups:
        aggs.append(F.count_if(condition).alias(f"{name}_u"))
        aggs.append(F.coalesce(F.sum(F.when(condition, F.col("multiplicity"))), F.lit(0)).cast("long").alias(f"{name}_w"))
    row = moves.agg(*aggs)
    lines = F.array(*[
        F.struct(F.lit(name).alias("outcome"), F.col(f"{name}_u").alias("unique_n"), F.col(f"{name}_w").alias("event_weighted_n"))
        for name, _ in groups
    ])
    return row.select("total_u", "total_w", F.explode(lines).alias("line")).select(
        "line.*",
        F.round(F.try_divide(100.0 * F.col("line.unique_n"), F.col("total_u")), 9).alias("unique_percent"),
        F.round(F.try_divide(100.0 * F.col("line.event_weighted_n"), F.col("total_w")), 9).alias("event_weighted_percent"),
    )


PAIRED = ("paired_neither_changed", "paired_next_only_changed", "paired_previous_only_changed", "paired_both_changed")


def _pair_counts() -> list[Column]:
    """The 2x2 table of cells with two moves, counted on their move to the previous bin."""
    first = (F.col("direction") < 0) & F.col("opposite_prediction").isNotNull()
    previous, after = _changed(), F.col("opposite_prediction") != F.col("clean_prediction")
    cases = (~previous & ~after, ~previous & after, previous & ~after, previous & after)
    return [F.count_if(first & case).alias(name) for name, case in zip(PAIRED, cases)]


def _discordance() -> Column:
    pairs = F.col(PAIRED[0]) + F.col(PAIRED[1]) + F.col(PAIRED[2]) + F.col(PAIRED[3])
    return (F.col(PAIRED[2]) - F.col(PAIRED[1])) / F.greatest(F.lit(1), pairs)


def pair_directions(moves: DataFrame) -> DataFrame:
    """Both moves of a cell side by side, counted per source as a 2x2 table.

    ``moves`` carry the prediction of the other move of their cell (``score_moves`` with ``keep_opposite``), so the
    only shuffle is one partial sum per task and source.
    """
    counted = moves.groupBy("source_id").agg(*_pair_counts())
    return counted.withColumn("paired_direction_discordance", _discordance())


def source_counts(moves: DataFrame) -> DataFrame:
    """The count columns of the source summary that search and inference need."""
    return moves.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("unique_candidates"),
        F.sum("multiplicity").alias("event_weighted_candidates"),
        *[F.count_if(_is(code)).alias(f"{name}_unique") for code, name in OUTCOMES[1:]],
        F.count_if(_changed()).alias("class_changed_unique"),
        F.count_if(F.col("candidate_prediction") == F.col("label")).alias("correct_neighbors"),
    )


def source_geometry(moves: DataFrame, sources: DataFrame, width: int) -> DataFrame:
    """A2: one row per source with rates, counts, margins and splits, from one aggregation of ``moves`` (with the
    opposite prediction). Empty splits are NULL; a source without a move has zero counts and NULL rates.
    """
    tertile = time_part(F.col("from_bin"), F.col("horizon"), 3)
    quartile = feature_part(F.col("feature"), width, 4)
    aggs = [
        F.count(F.lit(1)).alias("unique_candidates"),
        F.sum("multiplicity").alias("event_weighted_candidates"),
        _rate(_changed()).alias("class_change_rate"),
        *[_rate(_is(code)).alias(f"{name}_rate") for code, name in OUTCOMES[1:]],
        F.count_if(_changed()).alias("class_changed_unique"),
        *[F.count_if(_is(code)).alias(f"{name}_unique") for code, name in OUTCOMES[1:]],
        F.min("clean_class_margin").alias("minimum_clean_class_margin"),
        F.min("true_class_margin").alias("minimum_true_class_margin"),
        F.count_distinct("candidate_prediction").alias("distinct_candidate_classes"),
    ]
    for value, name in ((-1, "previous"), (1, "next")):
        side = F.col("direction") == value
        aggs += [
            F.count_if(side).alias(f"{name}_candidates"),
            _rate(_changed(), side).alias(f"{name}_class_change_rate"),
            _rate(_is(1), side).alias(f"{name}_adverse_rate"),
        ]
    aggs += [_rate(_changed(), F.col("__tertile") == i).alias(f"time_tertile_{i + 1}_class_change_rate") for i in range(3)]
    aggs += [_rate(_changed(), F.col("__quartile") == i).alias(f"feature_quartile_{i + 1}_class_change_rate") for i in range(4)]
    rows = moves.withColumns({
        "__tertile": tertile,
        "__quartile": quartile,
        "clean_class_margin": S.target_margin(F.col("scores"), F.col("clean_prediction").cast("int")),
        "true_class_margin": S.target_margin(F.col("scores"), F.col("label").cast("int")),
    })
    summary = rows.groupBy("source_id").agg(*aggs, *_pair_counts()).withColumn(
        "previous_minus_next_class_change_rate",
        F.col("previous_class_change_rate") - F.col("next_class_change_rate"),
    )
    counts = [c for c, t in summary.dtypes if t == "bigint" and c != "source_id" and not c.startswith("minimum_")]
    facts = sources.drop("scores", "nonzero")
    return facts.join(summary, "source_id", "left").fillna(0, counts).withColumn("paired_direction_discordance", _discordance())


def classification_metrics(labelled: DataFrame, keys: list[str], classes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A3: (confusion, per-class metrics, overall metrics) per ``keys`` for columns label, prediction.

    Everything after the sparse confusion counts works on at most classes^2 rows per key.
    """
    in_range = F.col("label").between(0, classes - 1) & F.col("prediction").between(0, classes - 1)
    checked = labelled.withColumn("label", F.when(in_range, F.col("label")).otherwise(F.raise_error(F.lit("class id out of range"))))
    confusion = checked.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    sides = confusion.select(
        *keys, "n",
        F.explode(F.array(
            F.struct(F.col("label").alias("class"), F.lit("support").alias("side")),
            F.struct(F.col("prediction").alias("class"), F.lit("predicted").alias("side")),
        )).alias("s"),
        (F.col("label") == F.col("prediction")).alias("hit"),
    )
    counted = sides.groupBy(*keys, F.col("s.class").alias("class")).agg(
        F.sum(F.when(F.col("s.side") == "support", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.side") == "predicted", F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("hit") & (F.col("s.side") == "support"), F.col("n")).otherwise(0)).alias("hits"),
    )
    zero = F.lit(0.0)
    per_class = (
        counted.withColumn("recall", F.coalesce(F.try_divide("hits", "support"), zero))
        .withColumn("precision", F.coalesce(F.try_divide("hits", "predicted"), zero))
        .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    )
    present = F.col("support") > 0
    overall = per_class.groupBy(*keys).agg(
        F.sum("support").alias("samples"),
        F.sum("hits").alias("correct"),
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(present, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1"),
        F.min(F.when(present, F.col("recall"))).alias("worst_class_recall"),
    )
    return confusion, per_class, overall


def class_report(per_class: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """A3, dense: a row for every class of every key; a class that is neither labelled nor predicted has zeros.

    Works on the aggregated classes: ``classes`` rows a key.
    """
    every = per_class.select(*keys).distinct().withColumn("class", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))))
    values = [c for c in per_class.columns if c not in (*keys, "class")]
    return every.join(per_class, [*keys, "class"], "left").fillna(0, values)


def class_transition_matrix(moves: DataFrame) -> DataFrame:
    """A4: clean-to-candidate class counts, unique and event-weighted."""
    return moves.groupBy("clean_prediction", "candidate_prediction").agg(
        F.count(F.lit(1)).alias("unique_n"), F.sum("multiplicity").alias("event_weighted_n")
    )


def transition_grid(moves: DataFrame, width: int, time_bins: int = 20, feature_bins: int = 14) -> DataFrame:
    """A5: direction x time x feature x outcome counts (sparse)."""
    return moves.groupBy(
        F.when(F.col("direction") > 0, 1).otherwise(0).cast("long").alias("direction_id"),
        time_part(F.col("from_bin"), F.col("horizon"), time_bins).alias("time_bin"),
        feature_part(F.col("feature"), width, feature_bins).alias("feature_bin"),
        "transition_code",
    ).agg(F.count(F.lit(1)).alias("unique_n"), F.sum("multiplicity").alias("event_weighted_n"))


def accuracy_decomposition(summary: DataFrame) -> DataFrame:
    """Clean and neighbor accuracy with every source equal and every candidate equal.

    ``summary`` is one row per source with candidate and outcome counts, so no second pass over the
    candidates is needed.
    """
    weight, correct = F.col("unique_candidates"), F.when(F.col("clean_correct"), 1).otherwise(0)
    row = summary.agg(
        F.avg(correct.cast("double")).alias("equal_source_clean_accuracy"),
        F.avg(F.try_divide(F.col("correct_neighbors"), weight)).alias("equal_source_neighbor_accuracy"),
        (F.sum(correct * weight) / F.sum(weight)).alias("unique_candidate_clean_accuracy"),
        F.try_divide(F.sum("correct_neighbors"), F.sum(weight)).alias("unique_candidate_neighbor_accuracy"),
        F.sum(F.col("corrective_unique") - F.col("adverse_unique")).alias("corrective_minus_adverse"),
    )
    gain = F.col("unique_candidate_neighbor_accuracy") - F.col("unique_candidate_clean_accuracy")
    return row.withColumn("unique_candidate_gain_percentage_points", 100.0 * gain)


def panel_incidence(summary: DataFrame) -> DataFrame:
    """Numbers of correct, vulnerable and changing sources, and mean rates."""
    correct = F.col("clean_correct")
    return summary.agg(
        F.count_if(correct).alias("clean_correct_sources"),
        F.count_if(correct & (F.col("adverse_unique") > 0)).alias("adverse_sensitive_sources"),
        F.count_if(F.col("class_changed_unique") > 0).alias("any_change_sources"),
        F.count_if(F.col("corrective_unique") > 0).alias("corrective_sources"),
        F.count_if(F.col("lateral_unique") > 0).alias("lateral_sources"),
        F.try_divide(F.count_if(correct & (F.col("adverse_unique") > 0)), F.count_if(correct)).alias("adverse_source_incidence"),
        F.avg(F.try_divide("class_changed_unique", "unique_candidates")).alias("mean_source_class_change_rate"),
        F.avg(F.when(correct, F.try_divide("adverse_unique", "unique_candidates"))).alias("mean_adverse_rate"),
    )


def _outcome_list(spark) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.array(*[F.lit(code).cast("long") for code, _ in OUTCOMES])).alias("transition_code")
    )


def distribution_by_outcome(moves: DataFrame, value: str, **how) -> DataFrame:
    """Per outcome the number of candidates and sources, pooled quartiles and mean, and the mean
    of source means; an outcome without candidates gives zero counts and NULLs."""
    rows = stage(moves.select("source_id", "transition_code", F.col(value).cast("double").alias("v")), "response")
    per_source = rows.groupBy("transition_code", "source_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"),
        F.count_if(F.col("v") == 0).alias("zeros"),
    )
    pooled = per_source.groupBy("transition_code").agg(
        F.sum("n").alias("candidates"),
        F.count(F.lit(1)).alias("sources"),
        (F.sum("total") / F.sum("n")).alias("pooled_mean"),
        F.avg("mean").alias("equal_source_mean"),
        F.sum("zeros").alias("exact_zero"),
    )
    cuts = percentiles(rows, ["transition_code"], "v", [("pooled_q1", 0.25), ("pooled_median", 0.5), ("pooled_q3", 0.75)], **how)
    joined = _outcome_list(moves.sparkSession).join(pooled, "transition_code", "left").join(cuts, "transition_code", "left")
    return joined.select(
        outcome_name(F.col("transition_code")).alias("outcome"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("candidates", "sources", "exact_zero")],
        (F.coalesce("candidates", F.lit(0)) - F.coalesce("exact_zero", F.lit(0))).cast("long").alias("nonzero"),
        "pooled_q1", "pooled_median", "pooled_q3", "pooled_mean", "equal_source_mean",
    )


def median_of_medians(moves: DataFrame, value: str, code: int = 0, **how) -> DataFrame:
    """Quartiles over sources of the within-source median among one outcome."""
    rows = moves.where(_is(code)).select("source_id", F.col(value).cast("double").alias("v"))
    medians = percentiles(rows, ["source_id"], "v", [("median", 0.5)], **how)
    return percentiles(
        medians, [], "median",
        [("within_source_median_q1", 0.25), ("within_source_median", 0.5), ("within_source_median_q3", 0.75)], **how,
    )


def trace_group_means(traces: DataFrame) -> DataFrame:
    """Outcome x stage x metric means, unique and event-weighted."""
    weight = F.col("multiplicity")
    return traces.groupBy("transition_code", "stage", "metric").agg(
        F.avg("value").alias("mean_unique"),
        F.try_divide(F.sum(F.col("value") * weight), F.sum(weight)).alias("mean_event_weighted"),
    )


def restoration_rates(patches: DataFrame) -> DataFrame:
    """A10: outcome x stage shares of replacements that restore the clean or the true class."""
    weight = F.col("multiplicity")
    to_clean = F.col("patch_prediction") == F.col("clean_prediction")
    to_true = F.col("patch_prediction") == F.col("label")
    margin = S.target_margin(F.col("patch_scores"), F.col("clean_prediction").cast("int"))

    def weighted(condition: Column) -> Column:
        return F.try_divide(F.sum(F.when(condition, weight).otherwise(0)), F.sum(weight))

    return patches.groupBy("transition_code", "stage").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.sum(weight).alias("n_event_weighted"),
        _rate(to_clean).alias("restored_clean_unique"),
        weighted(to_clean).alias("restored_clean_event_weighted"),
        _rate(to_true).alias("restored_true_unique"),
        weighted(to_true).alias("restored_true_event_weighted"),
        _rate(margin > 0).alias("positive_clean_margin_unique"),
    )


def restoration_ranges(patches: DataFrame, branch_stages: list[int]) -> DataFrame:
    """A10: per outcome the range over the branch stages of the equal-source restoration rates."""
    per_source = patches.where(F.col("stage").isin(branch_stages)).groupBy("transition_code", "stage", "source_id").agg(
        _rate(F.col("patch_prediction") == F.col("clean_prediction")).alias("to_clean"),
        _rate(F.col("patch_prediction") == F.col("label")).alias("to_true"),
    )
    per_stage = per_source.groupBy("transition_code", "stage").agg(F.avg("to_clean").alias("to_clean"), F.avg("to_true").alias("to_true"))
    return per_stage.groupBy("transition_code").agg(
        F.min("to_clean").alias("clean_min"), F.max("to_clean").alias("clean_max"),
        F.min("to_true").alias("true_min"), F.max("to_true").alias("true_max"),
    )


def positive_controls(patches: DataFrame, stages: list[int]) -> DataFrame:
    """At stages that must restore exactly, the largest score difference to the clean scores and
    the share of restored predictions."""
    return patches.where(F.col("stage").isin(stages)).groupBy("stage").agg(
        F.max(S.linf_change(F.col("patch_scores"), F.col("clean_scores"))).cast("double").alias("max_abs_to_clean"),
        _rate(F.col("patch_prediction") == F.col("clean_prediction")).alias("restoration_rate"),
    )


def concentration(values: DataFrame, value: str, identity: str, **how) -> DataFrame:
    """Gini, Herfindahl and effective number of sources; zeros when nothing is to share.

    The rank in the Gini sum is the position in (value, id) order.
    """
    v = F.col(value)
    kind = "long" if dict(values.dtypes)[value] in ("tinyint", "smallint", "int", "bigint", "boolean") else "double"
    ranked = running(values.select(identity, v.cast(kind).alias("v")), [], [F.col("v").asc(), F.col(identity).asc()], out="rank", **how)
    row = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"),
        F.sum(F.col("rank").cast("double") * F.col("v")).alias("ranked"),
        F.sum(F.col("v").cast("double") * F.col("v")).alias("squares"), F.count_if(F.col("v") < 0).alias("negative"),
    )
    usable = (F.col("n") > 0) & (F.col("negative") == 0) & (F.coalesce("total", F.lit(0)) > 0)
    gini = 2.0 * F.col("ranked") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")
    herfindahl = F.when(usable, F.col("squares") / (F.col("total").cast("double") * F.col("total"))).otherwise(0.0)
    return row.select(
        F.when(usable, gini).otherwise(0.0).alias("gini"),
        herfindahl.alias("herfindahl"),
        F.when(usable, 1.0 / herfindahl).otherwise(0.0).alias("effective_number_of_sources"),
    )


def bin_coords(moves: DataFrame, width: int, time_bins: int = 20, feature_bins: int = 14) -> DataFrame:
    """Tertile, quartile and grid bins of each move."""
    t, h, f = F.col("from_bin"), F.col("horizon"), F.col("feature")
    return moves.select(
        "source_id", "cand",
        time_part(t, h, 3).alias("time_tertile"), feature_part(f, width, 4).alias("feature_quartile"),
        time_part(t, h, time_bins).alias("time_bin"), feature_part(f, width, feature_bins).alias("feature_bin"),
    )


def subset_masks(moves: DataFrame, response: str) -> DataFrame:
    """One row per (subset, candidate) for all, nonzero-response and preserved nonzero ones."""
    nonzero = F.col(response) > 0
    tags = F.filter(
        F.array(
            F.lit("all_neighbors"),
            F.when(nonzero, F.lit("nonzero_internal_response")),
            F.when(nonzero & _is(0), F.lit("preserved_nonzero_response")),
        ),
        lambda tag: tag.isNotNull(),
    )
    return moves.withColumn("subset", F.explode(tags))
