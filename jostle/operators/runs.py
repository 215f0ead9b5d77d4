"""Comparisons between runs of the same sources under different execution conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jostle.functions import scores as S
from jostle.operators.census import classification_metrics
from jostle.plans.ordering import percentiles
from jostle.plans.staging import stage

# Ranges of added bins, the last one without an end; score thresholds.
GAP_RANGES = ((0, 0), (1, 5), (6, 10), (11, 20), (21, 40), (41, 80), (81, None))
THRESHOLDS = (("above_1e_5", 1e-5), ("above_1e_4", 1e-4), ("above_1e_3", 1e-3))


def with_predictions(runs: DataFrame) -> DataFrame:
    """D3 over a run table; a non-finite score fails the job."""
    bad = F.exists("scores", lambda s: s.isNull() | F.isnan(s) | s.isin(float("inf"), float("-inf")))
    prediction = F.when(bad, F.raise_error(F.lit("non-finite scores"))).otherwise(S.predict(F.col("scores")))
    return runs.withColumn("prediction", prediction.cast("long"))


def pair_runs(runs: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Both sides of every wanted condition pair on one row, without a self-join.

    A run row is sent once to each pair it takes part in, and the two sides meet in one
    aggregation on (pair, source).
    """
    ends = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.lit(side).alias("side"), F.lit(c).cast("long").alias("wanted"))
        for i, pair in enumerate(pairs) for side, c in zip("ab", pair)
    ])
    sent = runs.withColumn("end", F.explode(ends)).where(F.col("end.wanted") == F.col("condition"))
    side = lambda name, column: F.max(F.when(F.col("end.side") == name, F.col(column)))
    names = F.create_map(*[F.lit(v) for i, (a, b) in enumerate(pairs) for v in (i, f"{a}-{b}")])
    paired = sent.groupBy(F.col("end.pair").alias("pair"), "source_id", "label").agg(
        side("a", "prediction").alias("a"), side("b", "prediction").alias("b"),
        side("a", "scores").alias("scores_a"), side("b", "scores").alias("scores_b"),
    )
    return paired.withColumn("pair", names[F.col("pair")])


def delta(a: str = "scores_a", b: str = "scores_b") -> Column:
    return S.linf_change(F.col(a), F.col(b)).cast("double")


def score_difference(pairs: DataFrame, keys: list[str], a: str = "scores_a", b: str = "scores_b", **how) -> DataFrame:
    """Distribution of the per-source largest score difference; sources on one side only are ``missing``."""
    rows = stage(pairs.select(*keys, delta(a, b).alias("delta")), "delta")
    counts = rows.groupBy(*keys).agg(
        F.count("delta").alias("samples"),
        F.count_if(F.col("delta").isNull()).alias("missing"),
        F.count_if(F.col("delta") == 0).alias("exact_zero"),
        F.count_if(F.col("delta") != 0).alias("nonzero"),
        F.max("delta").alias("maximum"),
        *[F.count_if(F.col("delta") > limit).alias(name) for name, limit in THRESHOLDS],
    )
    cuts = percentiles(rows, keys, "delta", [("median", 0.5), ("p95", 0.95), ("p99", 0.99)], **how)
    return counts.join(cuts, keys)


def label_contrast(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Changed predictions split into correct-to-wrong, wrong-to-correct and other-wrong, among the
    sources predicted on both sides."""
    changed = F.col("a") != F.col("b")
    return pairs.groupBy(*keys).agg(
        F.count_if(changed).alias("changed_labels"),
        F.avg(F.when(changed, 1.0).when(~changed, 0.0)).alias("changed_fraction"),
        F.count_if(changed & (F.col("a") == F.col("label"))).alias("correct_to_wrong"),
        F.count_if(changed & (F.col("b") == F.col("label"))).alias("wrong_to_correct"),
        F.count_if(changed & (F.col("a") != F.col("label")) & (F.col("b") != F.col("label"))).alias("wrong_to_different_wrong"),
    )


def changed_sources(pairs: DataFrame) -> DataFrame:
    """Every changed source of every pair with its two classes, one row each."""
    return pairs.where(F.col("a") != F.col("b")).select("pair", "source_id", "a", "b")


def condition_contrasts(runs: DataFrame, pairs: Sequence[tuple[int, int]], classes: int, shown: int = 16, **how) -> DataFrame:
    """Accuracy of both conditions, label contrast, score differences and the first changed
    class pairs of every pair of conditions.

    The full list of changed sources is :func:`changed_sources`; the report column shows the first
    ``shown``, found by a per-task top-k.
    """
    from pyspark.sql import Window

    predicted = with_predictions(runs)
    paired = stage(pair_runs(predicted, pairs), "paired")
    _, _, overall = classification_metrics(predicted, ["condition"], classes)
    accuracy = overall.select(F.col("condition").cast("string").alias("condition"), "accuracy")
    first = Window.partitionBy("pair").orderBy("source_id")
    head = (
        changed_sources(paired).withColumn("n", F.row_number().over(first)).where(F.col("n") <= shown)
        .groupBy("pair")
        .agg(F.sort_array(F.collect_list(F.struct("source_id", "a", "b"))).alias("head"))
        .select("pair", F.concat_ws(" ", F.transform("head", lambda h: F.concat(
            h["source_id"].cast("string"), F.lit(":"), h["a"].cast("string"), F.lit(">"), h["b"].cast("string")
        ))).alias("changed_classes"))
    )
    sides = F.split(F.col("pair"), "-")
    joined = (
        label_contrast(paired, ["pair"])
        .join(score_difference(paired, ["pair"], **how), "pair")
        .join(head, "pair", "left")
        .withColumns({"ca": F.get(sides, F.lit(0)), "cb": F.get(sides, F.lit(1))})
    )
    a = accuracy.withColumnsRenamed({"condition": "ca", "accuracy": "accuracy_a"})
    b = accuracy.withColumnsRenamed({"condition": "cb", "accuracy": "accuracy_b"})
    return (
        joined.join(F.broadcast(a), "ca").join(F.broadcast(b), "cb").drop("ca", "cb")
        .withColumn("changed_classes", F.coalesce("changed_classes", F.lit("")))
    )


def gap_range(gap: Column, ranges: Sequence[tuple[int, int | None]] = GAP_RANGES) -> Column:
    """Index of the range that holds the gap (both ends inside, None: no end); NULL outside all."""
    column = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(ranges):
        column = F.when((gap >= lo) if hi is None else gap.between(lo, hi), F.lit(i)).otherwise(column)
    return column


def range_table(spark, ranges: Sequence[tuple[int, int]] = GAP_RANGES) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(i).alias("range"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
        for i, (lo, hi) in enumerate(ranges)
    ])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def gap_range_join(rows: DataFrame, gap: str, ranges: Sequence[tuple[int, int]] = GAP_RANGES) -> DataFrame:
    """Rows with the range they fall in. The ranges are a fixed short list, so the theta join
    becomes a column expression and the rows are not moved."""
    table = F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for lo, hi in ranges])
    placed = rows.withColumn("range", gap_range(F.col(gap), ranges)).where(F.col("range").isNotNull())
    bounds = F.get(table, F.col("range"))
    return placed.withColumns({"lo": bounds["lo"], "hi": bounds["hi"]})


def gap_change_rates(rows: DataFrame, gap: str, changed: str, ranges: Sequence[tuple[int, int]] = GAP_RANGES) -> DataFrame:
    """Sources, changed ones and their share per range; empty ranges give 0 and NULL. Rows whose gap is in no range (NULL or negative)
    make one more row, without bounds."""
    counted = rows.groupBy(F.coalesce(gap_range(F.col(gap), ranges), F.lit(-1)).alias("range")).agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col(changed)).alias("changed")
    )
    # A row for each range and at most one more.
    met = range_table(rows.sparkSession, ranges).join(counted, "range", "full_outer")
    return met.select(
        "lo", "hi",
        F.coalesce("sources", F.lit(0)).cast("long").alias("sources"),
        F.coalesce("changed", F.lit(0)).cast("long").alias("changed"),
        F.try_divide("changed", "sources").alias("changed_fraction"),
    )


def align_runs(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows missing on either side and mismatches per payload column, as one row."""
    left = a.select(*key, F.struct(*columns).alias("__a"))
    right = b.select(*key, F.struct(*columns).alias("__b"))
    joined = left.join(right, key, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return joined.agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("__b").isNull()).alias("only_a"),
        F.count_if(F.col("__a").isNull()).alias("only_b"),
        *[F.count_if(both & ~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}"))).alias(f"{c}_differs") for c in columns],
    )


def alignment_guard(a: DataFrame, b: DataFrame) -> DataFrame:
    """P10: violations per rule between two runs with columns source_id, label, native_horizon,
    padded_horizon and fingerprint."""
    columns = ["label", "native_horizon", "padded_horizon", "fingerprint"]
    left = a.select("source_id", F.struct(*columns).alias("a"))
    right = b.select("source_id", F.struct(*columns).alias("b"))
    joined = left.join(right, "source_id", "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    # What is absent cannot be verified: NULL on one side or both is a violation.
    differs = lambda c: F.coalesce(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(True))
    negative = lambda s: F.col(s).isNotNull() & F.coalesce(F.col(f"{s}.padded_horizon") < F.col(f"{s}.native_horizon"), F.lit(True))
    rules = {
        "missing_source": ~both,
        "label_mismatch": both & differs("label"),
        "horizon_mismatch": both & differs("native_horizon"),
        "input_substituted": both & differs("fingerprint"),
        "negative_padding": negative("a") | negative("b"),
    }
    row = joined.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    lines = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])
    return row.select(F.explode(lines).alias("line")).select("line.*")


def compare_runs(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Per condition the sources in both runs, label disagreements and largest score difference."""
    left = with_predictions(fresh).select("condition", "source_id", F.col("scores").alias("scores_a"), F.col("prediction").alias("a"))
    right = with_predictions(stored).select("condition", "source_id", F.col("scores").alias("scores_b"), F.col("prediction").alias("b"))
    return left.join(right, ["condition", "source_id"]).groupBy("condition").agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("a") != F.col("b")).alias("label_disagreements"),
        F.max(delta()).alias("max_abs_score_difference"),
    )


def parity_gate(pairs: DataFrame, tolerance: float) -> DataFrame:
    """One row per pair; ``pass`` needs every source on both sides, within tolerance and of the same class."""
    within = F.coalesce((delta() <= tolerance) & (F.col("a") == F.col("b")), F.lit(False))
    return pairs.groupBy("pair").agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull() | delta().isNull()).alias("missing"),
        F.max(delta()).alias("max_abs_error"),
        F.count_if(F.col("a") != F.col("b")).alias("class_disagreements"),
        F.count_if(delta() == 0).alias("bit_exact_sources"),
        F.bool_and(within).alias("pass"),
    )


def require_pass(gate: DataFrame) -> None:
    """Stop before the next step unless every row of a gate passed (one boolean reaches the driver)."""
    if not gate.agg(F.coalesce(F.bool_and("pass"), F.lit(False)).alias("ok")).first()["ok"]:
        raise ValueError("parity gate failed")


def order_controls(runs: DataFrame) -> DataFrame:
    """For pairs scored as xy, yx and xx per mode, the effect of order and of position.

    ``runs`` are rows (pair, mode, arrangement, slot, scores) plus arrangement ``single``; slots of
    ``yx`` are mapped back to the source they hold before the arrangements meet.
    """
    member = F.when(F.col("arrangement") == "yx", 1 - F.col("slot")).otherwise(F.col("slot"))
    pick = lambda name: F.max(F.when(F.col("arrangement") == name, F.col("scores")))
    meet = runs.withColumn("member", member).groupBy("pair", "mode", "member").agg(
        pick("xy").alias("xy"), pick("yx").alias("yx"), pick("xx").alias("xx"), pick("single").alias("single")
    )
    order = S.predict(F.col("xy")) != S.predict(F.col("yx"))
    slots = meet.groupBy("pair", "mode").agg(
        F.count_if(order).alias("order_changed_labels"),
        F.max(delta("xy", "yx")).alias("order_score_max_abs"),
        F.max(delta("xy", "single")).alias("versus_single_max_abs"),
        F.max(F.when(F.col("member") == 0, F.col("xx"))).alias("x0"),
        F.max(F.when(F.col("member") == 1, F.col("xx"))).alias("x1"),
    )
    return slots.select(
        "pair", "mode", "order_changed_labels", "order_score_max_abs",
        delta("x0", "x1").alias("position_score_max_abs"), "versus_single_max_abs",
    )


def replay_agreement(canonical: DataFrame, runs: dict[str, DataFrame]) -> DataFrame:
    """How two replays of the class-changing candidates agree with the recorded outcome.

    ``canonical`` and each run are candidate tables keyed by (source_id, cand); a run carries its
    own clean prediction and outcome code. A candidate that a run lacks stays in ``candidates`` and counts as
    disagreement there; ``missing_{run}`` tells how many. The row with a null code is the total.
    """
    (name_a, a), (name_b, b) = runs.items()
    key = ["source_id", "cand"]
    base = canonical.where(F.col("transition_code") != 0).select(
        *key, F.col("transition_code").alias("code"), F.col("candidate_prediction").alias("recorded")
    )
    def pick(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *key, F.col("candidate_prediction").alias(f"{tag}_prediction"), F.col("transition_code").alias(f"{tag}_code"),
            F.col("clean_prediction").alias(f"{tag}_clean"), F.lit(True).alias(f"{tag}_there"),
        )

    joined = base.join(pick(a, "a"), key, "left").join(pick(b, "b"), key, "left")
    return joined.rollup(F.col("code").alias("transition_code")).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("a_there").isNull()).alias(f"missing_{name_a}"),
        F.count_if(F.col("b_there").isNull()).alias(f"missing_{name_b}"),
        F.avg(F.when(F.col("a_prediction") == F.col("b_prediction"), 1.0).otherwise(0.0)).alias("label_agreement"),
        F.count_if(F.col("a_prediction") == F.col("recorded")).alias(f"{name_a}_same_class"),
        F.count_if(F.col("b_prediction") == F.col("recorded")).alias(f"{name_b}_same_class"),
        F.count_if(F.col("a_code") == F.col("code")).alias(f"{name_a}_same_type"),
        F.count_if(F.col("b_code") == F.col("code")).alias(f"{name_b}_same_type"),
        F.count_if(F.col("a_prediction") == F.col("a_clean")).alias(f"{name_a}_returns_to_clean"),
    )


def source_sets(runs: dict[str, DataFrame], code: int = 1) -> DataFrame:
    """H1: sources with at least one candidate of ``code``, with the runs that have them.

    Set equality of all runs means every row has all flags.
    """
    tagged = None
    for name, moves in runs.items():
        part = moves.where(F.col("transition_code") == code).select("source_id", F.lit(name).alias("run")).distinct()
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("source_id").agg(
        *[F.bool_or(F.col("run") == name).alias(f"in_{name}") for name in runs], F.count(F.lit(1)).alias("runs")
    )


def recovered_sets(runs: dict[str, DataFrame], code: int = 1) -> DataFrame:
    """Whether every run finds the same vulnerable sources, and the same first candidate in each, as the first run.

    Rows (run, sources, same_sources, same_witnesses). A set is told by its size and the wide sum of hashes of its members, which
    needs no order and no collecting: one row a run is compared, however many sources there are.
    """
    total = lambda *columns: F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    digests = None
    for place, (name, moves) in enumerate(runs.items()):
        first = moves.where(F.col("transition_code") == code).groupBy("source_id").agg(F.min_by(F.struct("cand", "candidate_prediction"), "cand").alias("w"))
        row = first.agg(F.count(F.lit(1)).alias("sources"), total("source_id").alias("members"), total("source_id", "w.cand", "w.candidate_prediction").alias("witnesses"))
        row = row.select(F.lit(place).alias("place"), F.lit(name).alias("run"), "*")
        digests = row if digests is None else digests.unionByName(row)
    every = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a run
    base = lambda c: F.first(c).over(every)
    return digests.select(
        "run", "sources", ((F.col("sources") == base("sources")) & (F.col("members") == base("members"))).alias("same_sources"),
        ((F.col("sources") == base("sources")) & (F.col("witnesses") == base("witnesses"))).alias("same_witnesses"),
    )
