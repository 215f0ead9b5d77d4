"""Two models on the same sources: hierarchical outcomes, pairing, cohorts, agreement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jostle.functions import scores as S

OUTCOMES = ("t0", "t1", "t2", "t3", "adverse", "corrective", "lateral")


def hierarchy(moves: DataFrame) -> DataFrame:
    """Level of each scored move: 3 class changed, 0 no score changed, 1 scores changed but not the
    top-two margin, 2 otherwise."""
    unchanged = ~F.exists(S.difference(F.col("scores"), F.col("clean_scores")), lambda d: d != 0)
    same_margin = S.top_margin(F.col("scores")) == S.top_margin(F.col("clean_scores"))
    level = (
        F.when(F.col("transition_code") != 0, 3).when(unchanged, 0).when(same_margin, 1).otherwise(2)
    )
    return moves.withColumn("level", level)


def replica_outcomes(levelled: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: level counts T0..T3 and the split of T3, with the clean facts; zeros without a move."""
    counts = levelled.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        *[F.count_if(F.col("level") == i).alias(f"t{i}") for i in range(4)],
        *[F.count_if(F.col("transition_code") == c).alias(n) for c, n in ((1, "adverse"), (2, "corrective"), (3, "lateral"))],
    )
    return sources.select("source_id", "label", "clean_prediction", "clean_correct").join(counts, "source_id", "left").fillna(0, ["candidates", *OUTCOMES])


def pair_replicas(outcomes: DataFrame, replica: str, values: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Both replicas of a source on one row with A_* / B_* counts and per-candidate rates.

    One conditional aggregation per source replaces two filters and a join.
    """
    aggs = []
    for v in values:
        mine = lambda column, v=v: F.max(F.when(F.col(replica) == v, F.col(column)))
        aggs += [mine("clean_correct").alias(f"{v}_correct"), mine("candidates").alias(f"{v}_neighbors")]
        aggs += [mine(o).alias(f"{v}_{o}") for o in OUTCOMES]
    paired = outcomes.groupBy("source_id", "label").agg(*aggs)
    a = values[0]
    rates = {f"{v}_{o}_rate": F.try_divide(f"{v}_{o}", f"{v}_neighbors") for v in values for o in OUTCOMES}
    return paired.withColumn("neighbors", F.col(f"{a}_neighbors")).withColumns(rates)


def replica_consistency(outcomes: DataFrame, paired: DataFrame, replica: str, values: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Violations of the identities that tie the per-source and the paired table together."""
    lines = F.array(*[
        F.struct(
            F.lit(v).alias("replica"), F.col("label").alias("p_label"), F.col("neighbors").alias("p_neighbors"),
            F.col(f"{v}_correct").alias("p_correct"),
            *[F.col(f"{v}_{o}").alias(f"p_{o}") for o in OUTCOMES], *[F.col(f"{v}_{o}_rate").alias(f"p_{o}_rate") for o in OUTCOMES],
        ) for v in values
    ])
    long = paired.select("source_id", F.explode(lines).alias("l")).select("source_id", "l.*")
    own = outcomes.withColumnRenamed(replica, "replica")
    joined = own.join(long, ["source_id", "replica"], "full_outer")
    both = F.col("candidates").isNotNull() & F.col("p_neighbors").isNotNull()
    rules = {
        "missing_pair": ~both,
        "label_differs": both & (F.col("label") != F.col("p_label")),
        "neighbors_differ": both & (F.col("candidates") != F.col("p_neighbors")),
        "cohort_differs": both & (F.col("clean_correct") != F.col("p_correct")),
        "count_differs": both & F.greatest(*[F.abs(F.col(o) - F.col(f"p_{o}")) for o in OUTCOMES]).__gt__(0),
        "rate_differs": both & F.greatest(*[F.abs(F.col(f"p_{o}_rate") - F.col(o) / F.col("candidates")) for o in OUTCOMES]).__gt__(1e-12),
        "partition_broken": both & (F.col("t0") + F.col("t1") + F.col("t2") + F.col("t3") != F.col("candidates")),
        "t3_split_broken": both & (F.col("adverse") + F.col("corrective") + F.col("lateral") != F.col("t3")),
    }
    # A rule that NULL leaves undecided counts as broken.
    row = joined.agg(*[F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    out = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in rules])
    return row.select(F.explode(out).alias("l")).select("l.*")


def validation_consistency(outcomes: DataFrame, validation: DataFrame, replica: str) -> DataFrame:
    """R8, validation: violations of what ties a panel to the full validation runs of its replicas, as (replica, check, violations).

    ``validation`` are (``replica``, source_id, scores, prediction, label) of all validation sources. Their ids are 0 to n - 1, each once; a stored
    prediction is the first largest score; every panel source is among them with the panel's prediction and label.
    """
    stored = validation.select(replica, "source_id", F.col("prediction").alias("v_prediction"), F.col("label").alias("v_label"))
    broken = lambda rule: F.count_if(F.coalesce(rule, F.lit(True)))
    whole = validation.groupBy(replica, "source_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(S.predict(F.col("scores")) != F.col("prediction"), F.lit(True))).alias("off")
    ).groupBy(replica).agg(
        F.count_if("off").alias("prediction_disagrees_with_scores"), F.count_if(F.col("n") > 1).alias("repeated_source"),
        (F.max("source_id") + 1 - F.count(F.lit(1))).cast("long").alias("missing_source"),
    )
    # Repeated sources are counted above; one row each meets the panel.
    once = stored.groupBy(replica, "source_id").agg(F.min("v_prediction").alias("v_prediction"), F.min("v_label").alias("v_label"), F.lit(True).alias("there"))
    panel = outcomes.select(replica, "source_id", "clean_prediction", "label").join(once, [replica, "source_id"], "left")
    there = F.col("there").isNotNull()
    tied = panel.groupBy(replica).agg(
        F.count_if(~there).alias("panel_source_missing"), broken(there & (F.col("v_prediction") != F.col("clean_prediction"))).alias("panel_prediction_differs"),
        broken(there & (F.col("v_label") != F.col("label"))).alias("panel_label_differs"),
    )
    names = ["prediction_disagrees_with_scores", "repeated_source", "missing_source", "panel_source_missing", "panel_prediction_differs", "panel_label_differs"]
    lines = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("violations")) for n in names])
    return whole.join(tied, replica, "full_outer").select(replica, F.explode(lines).alias("l")).select(replica, "l.*")


def replica_table(outcomes: DataFrame, replica: str) -> DataFrame:
    """Per replica the level totals, the split of T1, and correct, robust and vulnerable sources."""
    correct = F.col("clean_correct")
    return outcomes.groupBy(replica).agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum("candidates").alias("neighbors"),
        *[F.sum(o).alias(o) for o in OUTCOMES],
        F.sum(F.col("t1") + F.col("t2") + F.col("t3")).alias("score_changed_neighbors"),
        F.try_divide(F.sum("t1"), F.sum(F.col("t1") + F.col("t2") + F.col("t3"))).alias("margin_kept_fraction_of_changes"),
        F.count_if(correct).alias("initially_correct_sources"),
        F.count_if(correct & (F.col("t3") == 0)).alias("robust_correct_sources"),
        F.count_if(correct & (F.col("adverse") > 0)).alias("adverse_sensitive_sources"),
    )


def replica_rows(table: DataFrame, replica: str, values: tuple[str, str] = ("A", "B")) -> DataFrame:
    """The report form, one row per quantity with a column per replica."""
    names = [*OUTCOMES, "initially_correct_sources", "robust_correct_sources"]
    lines = F.array(*[F.struct(F.lit(n).alias("outcome"), F.col(n).alias("v")) for n in names])
    long = table.select(replica, F.explode(lines).alias("l"))
    return long.groupBy(F.col("l.outcome").alias("outcome")).pivot(replica, list(values)).agg(F.max("l.v")).withColumnsRenamed(
        {v: f"replica_{v.lower()}" for v in values}
    )


def cohort_of(paired: DataFrame) -> DataFrame:
    """Rows (cohort, source) for the full panel and the four correctness cohorts."""
    a, b = F.col("A_correct"), F.col("B_correct")
    name = (
        F.when(a & b, "both_correct").when(~a & b, "A_wrong_B_correct").when(a & ~b, "A_correct_B_wrong").otherwise("both_wrong")
    )
    return paired.withColumn("cohort", F.explode(F.array(F.lit("full_panel"), name)))


def cohort_decomposition(paired: DataFrame) -> DataFrame:
    """Class changes and adverse counts of the sources that only B classifies correctly and has
    adverse neighbors of, of all others, and of those both classify correctly, with rates, the B/A
    ratio and the difference in percentage points."""
    special = ~F.col("A_correct") & F.col("B_correct") & (F.col("B_adverse") > 0)
    common = F.col("A_correct") & F.col("B_correct")
    tags = F.filter(
        F.array(F.when(special, F.lit("only_B_vulnerable")).otherwise(F.lit("other")), F.when(common, F.lit("both_correct")), F.lit("all")),
        lambda t: t.isNotNull(),
    )
    return paired.withColumn("cohort", F.explode(tags)).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum("A_t3").alias("A_t3"), F.sum("B_t3").alias("B_t3"),
        F.sum("A_adverse").alias("A_adverse"), F.sum("B_adverse").alias("B_adverse"),
        F.avg("A_adverse_rate").alias("A_mean_adverse_rate"), F.avg("B_adverse_rate").alias("B_mean_adverse_rate"),
        F.try_divide(F.sum("B_t3"), F.sum("A_t3")).alias("t3_ratio_B_over_A"),
        (100.0 * (F.avg("B_adverse_rate") - F.avg("A_adverse_rate"))).alias("adverse_difference_pp"),
    )


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson 95% interval."""
    p = hits / n
    center = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.try_divide(center - spread, scale), F.try_divide(center + spread, scale)


def _deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) - (x - mean), without the cancellation of its parts."""
    return F.when(x == 0, mean).otherwise(x * F.log1p((x - mean) / mean) - (x - mean))


def _stirling(x: Column) -> Column:
    """log x! less Stirling's formula: exact up to 15, then its series, whose next term is below 1e-15."""
    small = F.element_at(F.array(*[F.lit(math.lgamma(k + 1) - (0.5 * math.log(2 * math.pi * k) + k * math.log(k) - k) if k else 0.0) for k in range(16)]), (F.least(x, F.lit(15)) + 1).cast("int"))
    y = 1 / F.greatest(x, F.lit(1.0))
    series = y / 12 - F.pow(y, 3) / 360 + F.pow(y, 5) / 1260 - F.pow(y, 7) / 1680 + F.pow(y, 9) / 1188
    return F.when(x <= 15, small).otherwise(series)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided binomial p of ``b`` against ``c`` discordant pairs, to a relative error of about 1e-10.

    The largest term is taken from Stirling's formula with corrections, the others follow by their ratios (low - j) / (high + j + 1). These
    fall off like exp(-2 j j / n), so after 6 sqrt(n) + 40 terms what is left is below 1e-15 of the sum: 10^9 pairs cost 190,000 steps.
    """
    n, low, high = (b + c).cast("double"), F.least(b, c).cast("double"), F.greatest(b, c).cast("double")
    log_most = F.when(low == 0, -n * F.log(F.lit(2.0))).otherwise(
        _stirling(n) - _stirling(low) - _stirling(high) - _deviance(low, n / 2) - _deviance(high, n / 2) + 0.5 * F.log(n / (2 * math.pi * low * high))
    )
    count = F.least(low, F.ceil(6 * F.sqrt(n)) + 40).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (low - j) / (high + j + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    tail = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step)["sum"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * tail * F.exp(log_most)))


def paired_agreement(rows: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """2x2 table of two flags, agreement, Jaccard, McNemar p and a Wilson interval of the first
    flag's share."""
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"),
        F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"),
    )
    low, high = wilson(F.col("both") + F.col("only_a"), F.col("sources"))
    union = F.col("both") + F.col("only_a") + F.col("only_b")
    return counts.withColumns({
        "agreement": (F.col("both") + F.col("neither")) / F.col("sources"),
        "jaccard": F.try_divide(F.col("both"), union),
        "mcnemar_p": mcnemar_p(F.col("only_a"), F.col("only_b")),
        "wilson_low": low, "wilson_high": high,
    })
