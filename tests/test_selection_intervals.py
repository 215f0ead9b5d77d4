"""Selection without ordering, joins with ranges, packed resampling, the stencil, and exact tails of any size."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from jostle.operators import inference as I
from jostle.operators import replicas as P
from jostle.operators import runs as R
from jostle.operators import scoring as SC
from jostle.operators.intervals import interval_join
from jostle.operators.selection import top_k


def first_k(data, k):
    out = []
    for g in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))[:k]
        out += [(*r, n + 1) for n, r in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1, 40, 10**9])
def test_top_k_of_a_hot_group_with_ties(rows, spread):
    r = random.Random(spread)
    data = [("hot" if n % 10 else "cold", float(r.randrange(spread)) / 7, n) for n in range(3000)] + [("few", 1.0, -n) for n in range(20)]
    r.shuffle(data)
    got = top_k(rows("g string, s double, c long", data), ["g"], "s", "c", 500, task_rows=10, spare=5)
    assert sorted(tuple(x) for x in got.collect()) == first_k(data, 500)


def test_only_survivors_are_ordered(rows, spark):
    data = [("hot", float(n * n % 9973), n) for n in range(4000)]
    out = top_k(rows("g string, s double, c long", data), ["g"], "s", "c", 100, task_rows=10, spare=20)
    window = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in window
    # The rows that reach the window: those from the cut on.
    place = sorted((s for _, s, _ in data), reverse=True)[119]
    kept = [s for _, s, _ in data if s >= place]
    assert out.count() == 100 and len(kept) < 130


def test_scores_without_a_place_in_a_histogram(rows):
    data = [("a", None, 1), ("a", float("inf"), 2), ("a", 3.0, 3), ("a", 2.0, 4)]
    got = top_k(rows("g string, s double, c long", data), ["g"], "s", "c", 3, task_rows=1)
    assert [r["c"] for r in got.orderBy("rank").collect()] == [2, 3, 4]
    assert top_k(rows("g string, s double, c long", []), ["g"], "s", "c", 3, task_rows=1).collect() == []


@pytest.mark.parametrize("limit", [None, 0])
def test_interval_join_equals_all_pairs(rows, limit):
    r = random.Random(1)
    values = [(n, float(r.randrange(100))) for n in range(80)] + [(100, None), (101, float("nan")), (102, -5.0), (103, float("inf"))]
    ranges = [(n, *sorted((float(r.randrange(-20, 120)), float(r.randrange(-20, 120))))) for n in range(30)]
    ranges += [(50, None, 10.0), (51, 95.0, None), (52, 40.5, 40.6), (53, 60.0, 50.0), (54, 200.0, 300.0), (55, None, None)]
    got = interval_join(rows("id long, v double", values), "v", rows("rid long, lo double, hi double", ranges), broadcast_bytes=limit, buckets=16)
    inside = lambda v, lo, hi: v is not None and not math.isnan(v) and (lo is None or lo <= v) and (hi is None or v <= hi)
    met = {(i, n) for i, v in values for n, lo, hi in ranges if inside(v, lo, hi)}
    want = met | {(i, None) for i, _ in values if i not in {a for a, _ in met}} | {(None, n) for n, *_ in ranges if n not in {b for _, b in met}}
    found = [(x["id"], x["rid"]) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_interval_join_of_nothing(rows):
    none, some = rows("id long, v double", []), rows("rid long, lo double, hi double", [(1, 0.0, 1.0)])
    assert [tuple(x) for x in interval_join(none, "v", some).collect()] == [(None, None, 1, 0.0, 1.0)]
    assert [x["id"] for x in interval_join(rows("id long, v double", [(1, 5.0)]), "v", some.where("false")).collect()] == [1]
    with pytest.raises(ValueError, match="both sides"):
        interval_join(none, "v", rows("id long, lo double, hi double", []))


VALUES = "source_id long, g string, label long, v double, w double"


def test_packed_and_joined_draws_are_the_same(rows):
    r = random.Random(2)
    data = [(n, "ab"[n % 2], n % 3, r.random(), None if n % 11 == 0 else r.random()) for n in range(60)]
    both = [
        sorted((x["g"], x["rep"], round(x["v"], 9), round(x["w"], 9)) for x in I.bootstrap_means(rows(VALUES, data), ["v", "w"], 25, 3, ["g"], ["label"], pack_rows=limit).collect())
        for limit in (None, 0)
    ]
    assert both[0] == both[1] and len(both[0]) == 50
    p = [I.within_label_permutation(rows(VALUES, data), "v", "w", "label", 40, 5, pack_rows=limit).first()[0] for limit in (None, 0)]
    assert p[0] == p[1] and 0 < p[0] <= 1


def test_a_move_without_a_gradient_is_kept_and_counted(rows):
    moves = rows("source_id long, cand long, from_bin long, to_bin long, feature long", [(1, 0, 3, 4, 0), (1, 1, 3, 2, 0), (1, 2, 4, 3, 0), (1, 3, 9, 8, 0)])
    gradients = rows("source_id long, t long, f long, g array<double>", [(1, 3, 0, [1.0, 2.0]), (1, 4, 0, [4.0, 4.0])])
    out = SC.gradient_moves(moves, gradients)
    assert {r["cand"]: r["gains"] for r in out.collect()} == {0: [3.0, 2.0], 1: None, 2: [-3.0, -2.0], 3: None}
    assert tuple(SC.gradient_coverage(out).first()) == (1, 4, 2)


def exact_p(b, c):
    n, low = b + c, min(b, c)
    return min(1.0, float(2 * Fraction(sum(math.comb(n, k) for k in range(low + 1)), 2**n)))


def test_binomial_tails_of_any_size(rows):
    pairs = [(0, 0), (0, 1), (3, 3), (1, 4), (0, 40), (16, 15), (30, 70), (500, 400), (1000, 1100), (20, 2000)]
    got = {(r["b"], r["c"]): r["p"] for r in rows("b long, c long", pairs).select("b", "c", P.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()}
    for b, c in pairs:
        assert got[b, c] == pytest.approx(exact_p(b, c), rel=1e-9)
    b, c = 499_950_000, 500_050_000
    p = rows("b long, c long", [(b, c)]).select(P.mcnemar_p(F.col("b"), F.col("c"))).first()[0]
    assert p == pytest.approx(math.erfc((c - b - 1) / math.sqrt(2 * (b + c))), rel=1e-4)


def test_gaps_outside_all_ranges_have_a_row(rows):
    out = R.gap_change_rates(rows("gap long, changed boolean", [(-1, True), (None, False), (0, True)]), "gap", "changed")
    assert [tuple(r) for r in out.where("lo is null").collect()] == [(None, None, 2, 1, 0.5)] and out.count() == 8


def test_sets_recovered_by_runs(rows):
    schema = "source_id long, cand long, transition_code int, candidate_prediction int"
    base = [(1, 0, 1, 2), (1, 1, 1, 3), (2, 0, 0, 1), (3, 5, 1, 0)]
    runs = {"a": rows(schema, base), "b": rows(schema, base[::-1]), "c": rows(schema, base[1:]), "d": rows(schema, base[:2]), "e": rows(schema, [])}
    got = {r["run"]: tuple(r)[1:] for r in R.recovered_sets(runs).collect()}
    assert got == {"a": (2, True, True), "b": (2, True, True), "c": (2, True, False), "d": (1, False, False), "e": (0, False, False)}
