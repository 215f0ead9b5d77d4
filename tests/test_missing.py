"""Rows missing on one side, NULLs, empty sources, and the draws that many repetitions share."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jostle.operators import census as C
from jostle.operators import inference as I
from jostle.operators import reconcile as K
from jostle.operators import replicas as P
from jostle.operators import runs as R
from jostle.operators import scoring as SC
from jostle.operators import search as Q

PAIR = "pair string, source_id long, label long, a long, b long, scores_a array<double>, scores_b array<double>"


def test_a_source_on_one_side_fails_the_gate_and_is_no_sample(rows):
    pairs = rows(PAIR, [("0-1", 1, 0, 0, 0, [1.0, 0.0], [1.0, 0.0]), ("0-1", 2, 0, 1, None, [0.0, 1.0], None)])
    gate = R.parity_gate(pairs, 0.1)
    r = gate.first()
    assert (r["sources"], r["missing"], r["pass"]) == (2, 1, False)
    with pytest.raises(ValueError):
        R.require_pass(gate)
    d = R.score_difference(pairs, ["pair"]).first()
    assert (d["samples"], d["missing"], d["exact_zero"]) == (1, 1, 1)
    assert R.label_contrast(pairs, ["pair"]).first()["changed_fraction"] == 0.0


def test_unknown_values_are_violations_of_the_alignment(rows):
    schema = "source_id long, label long, native_horizon long, padded_horizon long, fingerprint string"
    a = rows(schema, [(1, 0, 5, 6, "x"), (2, None, 5, 6, "x"), (3, 0, 5, 6, None), (4, 0, 5, None, "x")])
    b = rows(schema, [(1, 0, 5, 6, "x"), (2, 0, 5, 6, "x"), (3, 0, 5, 6, None), (5, 0, 5, 6, "x")])
    got = {r["rule"]: r["violations"] for r in R.alignment_guard(a, b).collect()}
    assert got == {"missing_source": 2, "label_mismatch": 1, "horizon_mismatch": 0, "input_substituted": 1, "negative_padding": 1}


def test_the_last_gap_range_has_no_end(rows):
    df = rows("gap long, changed boolean", [(80, False), (81, True), (2_000_000, False), (None, True)])
    got = [tuple(r) for r in R.gap_change_rates(df, "gap", "changed").orderBy("lo").collect()]
    assert got[-1] == (81, None, 2, 1, 0.5) and got[-2][:3] == (41, 80, 1)
    assert R.gap_range_join(df, "gap").count() == 3


def test_rankings_that_lack_a_candidate_are_not_identical(rows):
    schema = "policy string, source_id long, cand long, rank long, score double"
    full = rows(schema, [("p", 1, c, c + 1, float(c)) for c in range(5)])
    r = Q.rank_agreement(full, full.where("cand <> 4"), k=3).first()
    assert not r["ranking_identical"] and not r["move_scores_equal"] and r["missing"] == 1 and r["first_rank_identical"]
    assert Q.rank_agreement(full, full).first()["ranking_identical"]


@pytest.mark.parametrize("how", [{}, {"group_rows": 0, "ranges": 3}])
def test_undefined_values_are_ranked_alike_both_ways(rows, how):
    df = rows("k long, x double, y double", [(1, 1.0, 2.0), (1, 2.0, None), (1, None, 1.0), (1, 3.0, 1.0), (1, 4.0, 7.0), (1, 5.0, float("nan"))])
    assert tuple(I.spearman(df, ["k"], "x", "y", **how).first()) == (1, 3, pytest.approx(0.5))
    ranks = sorted(((r["x"], r["rank"]) for r in I.average_rank(df, ["k"], "x", **how).collect()), key=str)
    assert ranks == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 4.0), (5.0, 5.0), (None, None)]


def test_undecided_rules_are_broken(rows):
    table = rows("a long", [(1,), (None,)])
    assert K.invariant_suite({"positive": (table, F.col("a") < 1)}).first()["violations"] == 1
    points = "source_id long, cand long, candidate_prediction long, m double"
    fresh = rows(points, [(1, 0, 2, 1.0), (1, 1, 2, None), (1, 2, 2, 1.0)])
    stored = rows(points, [(1, 0, 2, 1.0), (1, 1, 2, 1.0), (1, 3, 2, 1.0)])
    got = {r["cand"]: r["failed"] for r in K.compare_point(fresh, stored, 0.1, ["m"]).collect()}
    assert got == {0: "", 1: "m", 2: "missing_stored", 3: "missing_fresh"}


SCORER = SC.LinearScorer(3, lambda c, f, t: f"(({f} + 1) * {c + 1} * ({t} + 1) % 7)")


def moves_of(rows, **how):
    cells = rows("source_id long, horizon long, t long, f long, n long, cand0 long", [
        (1, 3, 0, 0, 2, 0), (1, 3, 1, 1, 1, 1), (1, 3, 2, 0, 4, 3), (2, 2, 0, 1, 1, 0), (3, 1, 0, 0, 5, 0),
    ])
    known = rows("source_id long, horizon long", [(1, 3), (2, 2), (3, 1), (4, 1)])
    sources = SC.score_sources(cells, SCORER, lambda source, clean: clean, known)
    return SC.score_moves(cells, sources, SCORER, **how), sources


def test_sources_without_events_or_moves_stay(rows):
    moves, sources = moves_of(rows, keep_opposite=True)
    facts = {r["source_id"]: r for r in sources.collect()}
    assert list(facts[4]["scores"]) == [0, 0, 0] and facts[4]["input_count"] == 0 and len(facts) == 4
    summary = {r["source_id"]: r for r in C.source_geometry(moves, sources, 2).collect()}
    assert set(summary) == {1, 2, 3, 4} and summary[1]["unique_candidates"] == 4
    for s in (3, 4):
        assert summary[s]["unique_candidates"] == summary[s]["paired_both_changed"] == 0 and summary[s]["class_change_rate"] is None
    outcomes = {r["source_id"]: r["candidates"] for r in P.replica_outcomes(P.hierarchy(moves), sources).collect()}
    assert outcomes == {1: 4, 2: 1, 3: 0, 4: 0}


def test_pairs_are_counted_without_meeting_again(rows):
    moves, _ = moves_of(rows, keep_scores=False, keep_opposite=True)
    both = {}
    for r in moves.collect():
        both.setdefault((r["source_id"], r["from_bin"], r["feature"]), {})[r["direction"]] = r["candidate_prediction"] != r["clean_prediction"]
    want = sum(len(v) == 2 for v in both.values())
    counted = C.pair_directions(moves)
    assert sum(sum(r[c] for c in C.PAIRED) for r in counted.collect()) == want == 1
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_id" in plan and "from_bin" not in plan.split("Exchange")[1].split("\n")[0]


@pytest.mark.parametrize("partitions", [1, 2, 17])
def test_batches_are_groups_not_partitions(rows, partitions):
    inputs = rows("source_id long, horizon long, padded_horizon long, batch long, ts array<int>, fs array<int>, ns array<long>", [
        (s, 1 + s % 4, 4 + s // 3, s // 3, [0], [0], [s]) for s in range(7)
    ]).repartition(partitions)

    def report():
        def model(batch, lengths):
            return np.array([[batch.shape[0], batch.shape[1], row.sum(), n] for row, n in zip(batch, lengths)], dtype=float)

        return model

    for reverse in (False, True):
        got = {r["source_id"]: list(r["scores"]) for r in SC.score_batches(inputs, report, 1, "padded_horizon", "batch", reverse).collect()}
        assert got == {s: [3.0 if s < 6 else 1.0, 4.0 + s // 3, float(s), 1.0 + s % 4] for s in range(7)}
    alone = {r["source_id"]: list(r["scores"]) for r in SC.score_batches(inputs, report, 1).collect()}
    assert alone == {s: [1.0, 1.0 + s % 4, float(s), 1.0 + s % 4] for s in range(7)}


def test_shared_digests_give_the_signs_and_indices_of_the_definition(rows):
    values = [0.3, -0.1, 0.25, 0.05, -0.02]
    df = rows("source_id long, v double", list(enumerate(values)))
    r = I.signflip_test(df, "v", 100, 5).first()
    md5 = lambda *key: hashlib.md5(":".join(map(str, key)).encode()).hexdigest()
    units = [round(v * 1e12) for v in values]
    hits = 0
    for rep in range(100):
        bits = [int(md5(5, rep // 30, slot)[:8], 16) >> (rep % 30) & 1 for slot in range(5)]
        hits += abs(sum(u if b else -u for u, b in zip(units, bits))) >= abs(sum(units))
    assert r["p_value"] == pytest.approx((1 + hits) / 101)
    means = [np.mean([values[int(md5(6, rep // 2, slot)[16 * (rep % 2): 16 * (rep % 2) + 15], 16) % 5] for slot in range(5)]) for rep in range(100)]
    assert r["ci_low"] == pytest.approx(np.quantile(means, 0.025)) and r["ci_high"] == pytest.approx(np.quantile(means, 0.975))
