"""Outcomes, score descriptors, resampling and multiple testing on hand-made inputs."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from jostle.functions import scores as S
from jostle.functions.outcomes import transition_code
from jostle.operators import census as C
from jostle.operators import inference as I
from jostle.operators import replicas as P
from jostle.operators import runs as R
from jostle.operators import scoring as SC


def test_four_outcomes(rows):
    df = rows("label long, clean long, cand long", [(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 3)])
    assert [r[0] for r in df.select(transition_code(F.col("label"), F.col("clean"), F.col("cand"), 5)).collect()] == [0, 1, 2, 3]
    with pytest.raises(PySparkException):
        df.select(transition_code(F.col("label"), F.col("clean"), F.col("cand"), 3)).collect()


def scalar(rows, column, *arrays):
    schema = ", ".join(f"a{i} array<double>" for i in range(len(arrays)))
    return rows(schema, [tuple(list(map(float, a)) for a in arrays)]).select(column.alias("v")).first()["v"]


def test_score_descriptors(rows):
    a, b = F.col("a0"), F.col("a1")
    scores = [0.0, 3.0, 6.0, 0.0]
    assert scalar(rows, S.predict(a), [1, 3, 3]) == 1
    assert scalar(rows, S.top_margin(a), scores) == 3
    assert scalar(rows, S.target_margin(a, F.lit(1)), scores) == -3
    assert scalar(rows, S.runner_up(a), scores) == 1
    assert scalar(rows, S.linf_change(a, b), scores, [0, 5, 0, 0]) == 6
    assert scalar(rows, S.cosine_distance(a, b), [0, 0], [1, 2]) == 0.0
    assert sum(scalar(rows, S.softmax(a), [1, 2, 3])) == pytest.approx(1.0)


def test_trace_metrics(rows):
    metrics = S.trace_metrics(F.col("a0"), F.col("a1"))
    value = {n: scalar(rows, m, [0, 1, 2], [1, 0, 2]) for n, m in metrics.items()}
    assert value["mean_absolute_change"] == pytest.approx(2 / 3)
    assert value["relative_l2_change"] == pytest.approx(math.sqrt(2 / 5))
    assert value["activity_flip_rate"] == pytest.approx(2 / 3)
    assert value["mean_signed_change"] == 0


def test_outcome_totals_has_zero_rows(rows):
    moves = rows("transition_code long, multiplicity long", [(0, 2), (0, 1), (1, 4)])
    got = {r["outcome"]: (r["unique_n"], r["event_weighted_n"]) for r in C.outcome_totals(moves).collect()}
    assert got == {"class_preserved": (2, 3), "adverse": (1, 4), "corrective": (0, 0), "lateral": (0, 0), "class_changed": (1, 4), "total": (3, 7)}


def test_distribution_keeps_empty_outcomes(rows):
    moves = rows("source_id long, transition_code long, v double", [(1, 0, 0.0), (1, 0, 1.0), (2, 0, 4.0), (1, 1, 2.0)])
    got = {r["outcome"]: r for r in C.distribution_by_outcome(moves, "v").collect()}
    assert got["class_preserved"]["pooled_median"] == 1.0 and got["class_preserved"]["equal_source_mean"] == 2.25
    assert (got["class_preserved"]["exact_zero"], got["class_preserved"]["nonzero"]) == (1, 2)
    assert got["lateral"]["candidates"] == 0 and got["lateral"]["pooled_median"] is None


def test_accuracy_weightings(rows):
    summary = rows(
        "clean_correct boolean, unique_candidates long, correct_neighbors long, corrective_unique long, adverse_unique long",
        [(True, 3, 3, 0, 0), (False, 1, 1, 1, 0)],
    )
    r = C.accuracy_decomposition(summary).first()
    assert (r["equal_source_clean_accuracy"], r["unique_candidate_clean_accuracy"]) == (0.5, 0.75)
    assert r["unique_candidate_gain_percentage_points"] == 25.0 and r["corrective_minus_adverse"] == 1


def test_concentration(rows):
    values = rows("source_id long, v long", [(1, 0), (2, 0), (3, 4)])
    r = C.concentration(values, "v", "source_id").first()
    assert r["gini"] == pytest.approx(2 / 3) and r["herfindahl"] == 1.0 and r["effective_number_of_sources"] == 1.0
    empty = C.concentration(values.where("v < 0"), "v", "source_id").first()
    assert tuple(empty) == (0.0, 0.0, 0.0)


def test_classification_metrics_with_an_unpredicted_class(rows):
    df = rows("label long, prediction long", [(0, 0), (0, 1), (1, 1), (2, 1)])
    _, per_class, overall = C.classification_metrics(df, [], 4)
    got = {r["class"]: (r["recall"], r["precision"], r["f1"]) for r in per_class.collect()}
    assert got[2] == (0.0, 0.0, 0.0) and got[0][1] == 1.0
    r = overall.first()
    assert r["accuracy"] == 0.5 and r["balanced_accuracy"] == pytest.approx(0.5) and r["worst_class_recall"] == 0.0


def test_benjamini_hochberg_and_holm(rows):
    tests = rows("family string, id long, p double", [("f", 0, 0.01), ("f", 1, 0.04), ("f", 2, 0.03), ("f", 3, None), ("g", 0, 0.5)])
    q = {(r["family"], r["id"]): r["q_value"] for r in I.bh_adjust(tests, "family", "p", "id").collect()}
    assert q[("f", 0)] == pytest.approx(0.03) and q[("f", 1)] == pytest.approx(0.04) and q[("f", 2)] == pytest.approx(0.04)
    assert q[("f", 3)] is None and q[("g", 0)] == 0.5
    holm = {r["id"]: r["holm_p"] for r in I.holm_adjust(tests.where("family = 'f' and p is not null"), "family", "p", "id").collect()}
    assert holm[0] == pytest.approx(0.03) and holm[2] == pytest.approx(0.06) and holm[1] == pytest.approx(0.06)


def test_bootstrap_of_constant_and_empty_values(rows):
    same = rows("source_id long, v double", [(i, 2.0) for i in range(5)] + [(9, float("nan")), (10, None)])
    r = I.bootstrap_mean_ci(same, "v", 20, 1).first()
    assert (r["n_sources"], r["mean"], r["ci_low"], r["ci_high"]) == (5, 2.0, 2.0, 2.0)
    none = I.bootstrap_mean_ci(same.where("v > 100"), "v", 20, 1).first()
    assert none["n_sources"] == 0 and none["mean"] is None and none["ci_low"] is None


def test_signflip_extremes(rows):
    mirrored = rows("source_id long, v double", [(0, 1.0), (1, -1.0)])
    assert I.signflip_test(mirrored, "v", 200, 3).first()["p_value"] == 1.0
    strong = rows("source_id long, v double", [(i, 1.0 + i / 100) for i in range(12)])
    assert I.signflip_test(strong, "v", 200, 3).first()["p_value"] < 0.05


def test_permutation_within_single_member_labels_changes_nothing(rows):
    df = rows("source_id long, label long, x double, y double", [(i, i, float(i), float(-i)) for i in range(6)])
    assert I.within_label_permutation(df, "x", "y", "label", 50, 1).first()["p_value"] == 1.0


def test_label_constant_rates_give_a_zero_width_interval(rows):
    members = rows("cohort string, source_id long, label long, a double, b double", [("c", i, i % 2, 0.0, 0.25 + 0.5 * (i % 2)) for i in range(8)])
    r = I.paired_stratified_bootstrap(members, {"m": ("a", "b")}, 50, 9).first()
    assert (r["m_difference"], r["m_ci_low"], r["m_ci_high"], r["label_strata"]) == (50.0, 50.0, 50.0, 2)


def test_within_source_spearman_refuses_single_rows(rows):
    moves = rows("source_id long, subset string, r double, y double", [(1, "s", 1.0, 1.0)])
    with pytest.raises(PySparkException):
        I.within_source_spearman(moves, "subset", "r", {"t": F.col("y")}).collect()


def test_label_contrast(rows):
    df = rows("k string, label long, a long, b long", [("x", 0, 0, 1), ("x", 0, 1, 0), ("x", 0, 1, 2), ("x", 1, 1, 1)])
    assert tuple(R.label_contrast(df, ["k"]).first())[1:] == (3, 0.75, 1, 1, 1)


def test_gap_ranges_keep_empty_ones(rows):
    df = rows("gap long, changed boolean", [(0, False), (3, True), (4, False)])
    got = [tuple(r) for r in R.gap_change_rates(df, "gap", "changed").orderBy("lo").collect()]
    assert got[0] == (0, 0, 1, 0, 0.0) and got[1] == (1, 5, 2, 1, 0.5) and got[2] == (6, 10, 0, 0, None) and len(got) == 7


def test_prefix_and_extra_parts_add_up(rows):
    logits = rows("source_id long, horizon long, padded_horizon long, t long, z array<double>", [
        (1, 2, 3, 0, [1.0, 0.0]), (1, 2, 3, 1, [0.0, 1.0]), (1, 2, 3, 2, [0.0, 5.0]),
    ])
    r = SC.prefix_extra_split(logits, "z", 2).first()
    assert r["split_error"] < 1e-12 and r["mass_error"] < 1e-12
    assert (r["prefix_prediction"], r["padded_prediction"]) == (0, 1)


def test_non_finite_scores_fail(rows):
    with pytest.raises(PySparkException):
        R.with_predictions(rows("scores array<double>", [([1.0, float("nan")],)])).collect()


def test_paired_agreement_matches_recorded_tables(rows):
    flags = [(True, True)] * 1 + [(False, False)] * 80 + [(True, False)] * 9 + [(False, True)] * 10
    df = rows("k string, a boolean, b boolean", [("k", *f) for f in flags])
    r = P.paired_agreement(df, ["k"], F.col("a"), F.col("b")).first()
    assert r["agreement"] == pytest.approx(0.81) and r["jaccard"] == pytest.approx(0.05) and r["mcnemar_p"] == pytest.approx(1.0)
    few = rows("k string, a boolean, b boolean", [("k", True, False)] * 3 + [("k", False, True)] + [("k", False, False)] * 63)
    assert P.paired_agreement(few, ["k"], F.col("a"), F.col("b")).first()["mcnemar_p"] == pytest.approx(0.625)
    share = rows("k string, a boolean, b boolean", [("k", i < 6, False) for i in range(73)])
    w = P.paired_agreement(share, ["k"], F.col("a"), F.col("b")).first()
    assert (w["wilson_low"], w["wilson_high"]) == pytest.approx((0.038213750478704914, 0.16794395479937174))
