"""Queries: move scores, rankings, search policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from jostle.catalog import fixtures as X
from jostle.catalog.inference import MARGIN_RANK_SQL, margin_ranks
from jostle.catalog.neighborhood import rounded
from jostle.catalog.registry import query
from jostle.functions import scores as S
from jostle.operators import events as E
from jostle.operators import scoring as SC
from jostle.operators import search as Q
from jostle.operators.selection import top_k
from jostle.plans.joins import attach
from jostle.plans.staging import stage

K, W = X.CLASSES, X.WIDTH
POLICIES = ("runner_up", "max_directional_gain", "max_predicted_target_margin")


# ---------------------------------------------------------------- gradients and move scores


def gradients(x):
    """Gradient table: per (source, t, f) an array over target classes of w(target) - w(clean).

    The clean class itself gets NULL, so it never wins a maximum.
    """
    places = E.grid(x.bounds, W).select("source_id", "t", "f")
    wide = attach(places, x.sources.select("source_id", "clean_prediction"), ["source_id"], spread=F.struct("t", "f"))
    weights = F.expr(f"array({', '.join(X.weight(c, 'f', 't') for c in range(K))})")
    clean = F.col("clean_prediction").cast("int")
    return wide.withColumn("w", weights).select(
        "source_id", "t", "f", F.transform("w", lambda w, c: F.when(c != clean, w - F.get(F.col("w"), clean))).alias("g")
    )


def target_margins(x):
    clean = F.col("clean_prediction").cast("int")
    return x.sources.select(
        "source_id", F.transform("scores", lambda s, c: F.when(c != clean, s - F.get("scores", clean))).alias("target_margins"),
        S.runner_up(F.col("scores")).alias("rival"),
    )


def gains(x):
    return SC.gradient_moves(x.moves.select("source_id", "cand", "from_bin", "to_bin", "feature", "transition_code"), gradients(x))


def move_scores(x):
    """Staged long table (policy, source_id, cand, score, transition_code) of the correct sources."""
    return x.once("move_scores", lambda: stage(build_move_scores(x), "move_scores"))


def build_move_scores(x):
    correct = x.sources.where("clean_correct").select("source_id")
    base = attach(gains(x), target_margins(x).join(correct, "source_id", "left_semi"), ["source_id"], spread=F.col("cand"))
    both = F.zip_with("gains", "target_margins", lambda g, m: g + m)
    entries = F.array(*[
        F.struct(F.lit(p).alias("policy"), s.alias("score"))
        for p, s in zip(POLICIES, (F.get("gains", F.col("rival")), F.array_max("gains"), F.array_max(both)))
    ])
    return base.select("source_id", "cand", "transition_code", F.explode(entries).alias("e")).select(
        F.col("e.policy").alias("policy"), "source_id", "cand", F.col("e.score").alias("score"), "transition_code"
    )


TARGETS = ", ".join(
    f"CASE WHEN clean_prediction = {c} THEN NULL ELSE {X.w_sql(c, 'feature', 'to_bin')} - {X.w_sql(c, 'feature', 'from_bin')} "
    f"- ({X.w_sql('clean_prediction', 'feature', 'to_bin')} - {X.w_sql('clean_prediction', 'feature', 'from_bin')}) END" for c in range(K)
)
MARGINS = ", ".join(f"CASE WHEN clean_prediction = {c} THEN NULL ELSE clean_scores[{c + 1}] - clean_scores[clean_prediction + 1] END" for c in range(K))
X.define(
    "gains", ("moves",),
    f"""SELECT source_id, cand, transition_code, clean_prediction, label, gains, margins, list_max(gains) AS max_gain,
      list_max(list_transform(list_zip(gains, margins), lambda z: z[1] + z[2])) AS max_target_margin, gains[list_position(margins, list_max(margins))] AS rival_gain
      FROM (SELECT *, [{TARGETS}] AS gains, [{MARGINS}] AS margins FROM moves)""",
)
X.define(
    "move_scores", ("gains",),
    """SELECT unnest(['runner_up', 'max_directional_gain', 'max_predicted_target_margin']) AS policy, source_id, cand,
      unnest([rival_gain, max_gain, max_target_margin]) AS score, transition_code FROM gains WHERE clean_prediction = label""",
)
X.define("ranked", ("move_scores",), "SELECT *, row_number() OVER (PARTITION BY policy, source_id ORDER BY score DESC, cand) AS rank FROM move_scores")


@query("directional_gain", ("gains",), "SELECT source_id, cand, max_gain, max_target_margin FROM gains")
def _(x):
    return SC.directional_gain(gains(x), target_margins(x))


@query("move_scores", ("move_scores",), "SELECT policy, source_id, cand, score FROM move_scores")
def _(x):
    return move_scores(x).select("policy", "source_id", "cand", "score")


@query("policy_rank", ("ranked",), "SELECT policy, source_id, cand, rank FROM ranked")
def _(x):
    return Q.policy_rank(move_scores(x).select("policy", "source_id", "cand", "score")).select("policy", "source_id", "cand", "rank")


@query("prefix_topk", ("ranked",), "SELECT policy, source_id, cand, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 100")
def _(x):
    return Q.prefix_topk(move_scores(x), 100).select("policy", "source_id", "cand", "rank")


@query(
    "prefix_topk_large", ("move_scores",),
    """SELECT policy, place, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY score DESC, place) AS rank
      FROM (SELECT policy, source_id * 1000000 + cand AS place, score FROM move_scores)) WHERE rank <= 2500""",
)
def _(x):
    """The first 2,500 of all moves of a policy: groups of a third of all rows, cut by histograms before they are ordered."""
    rows = move_scores(x).select("policy", (F.col("source_id") * 1_000_000 + F.col("cand")).alias("place"), "score")
    return top_k(rows, ["policy"], "score", "place", 2500)


@query("rank_lookup", ("ranked",), "SELECT policy, source_id, cand, CAST(rank AS INTEGER) AS rank, transition_code FROM ranked WHERE rank <= 10")
def _(x):
    top = Q.prefix_topk(move_scores(x).drop("transition_code"), 10)
    return Q.rank_lookup(top, x.moves).select("policy", "source_id", "cand", "rank", "transition_code")


FIRST_SQL = "SELECT policy, source_id, count(*) AS capacity, min(rank) FILTER (transition_code = 1) AS first_rank FROM ranked GROUP BY 1, 2"


@query("first_hit_rank", ("ranked",), FIRST_SQL)
def _(x):
    return Q.first_hit_rank(move_scores(x))


@query(
    "first_witness", ("moves",),
    "SELECT source_id, cand, candidate_prediction, from_bin, to_bin, feature FROM moves WHERE transition_code = 1 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY cand) = 1",
)
def _(x):
    return Q.first_witness(x.moves)


DISCOVERY_SQL = f"""SELECT policy, CAST(b AS BIGINT) AS budget_per_source, CAST(sum(least(b, capacity)) AS BIGINT) AS total_candidate_queries,
  count(*) FILTER (first_rank <= b) AS actual_discovered_sources, CAST(sum(h) AS BIGINT) AS selected_adverse_candidates FROM (
    SELECT policy, source_id, b, count(*) AS capacity, min(rank) FILTER (transition_code = 1) AS first_rank, count(*) FILTER (transition_code = 1 AND rank <= b) AS h
    FROM ranked, (VALUES {', '.join(f'({b})' for b in Q.BUDGETS)}) v(b) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def discovery(x):
    scored = move_scores(x)
    capacities = scored.groupBy("policy", "source_id").agg(F.count(F.lit(1)).alias("capacity"))
    return Q.discovery_counts(Q.prefix_topk(scored, max(Q.BUDGETS)), capacities)


@query("discovery_counts", ("ranked",), DISCOVERY_SQL)
def _(x):
    return discovery(x)


@query(
    "full_discovery_prefix", ("ranked",),
    f"""SELECT policy, max(prefix) AS posthoc_prefix_per_source, CAST(sum(least(capacity, prefix)) AS BIGINT) AS capped_queries,
      round(sum(least(capacity, prefix)) / sum(capacity), 9) AS fraction_of_exhaustive, count(*) FILTER (capacity < prefix) AS sources_with_shorter_neighborhood
      FROM (SELECT *, max(first_rank) OVER (PARTITION BY policy) AS prefix FROM ({FIRST_SQL})) GROUP BY 1""",
)
def _(x):
    return rounded(Q.full_discovery_prefix(Q.first_hit_rank(move_scores(x))))


@query(
    "witness_check", ("ranked",),
    f"""SELECT count(*) AS recorded, CAST(0 AS BIGINT) AS not_found, count(*) FILTER (source_id % 5 = 0) AS first_rank_differs
      FROM ({FIRST_SQL}) WHERE first_rank IS NOT NULL""",
)
def _(x):
    """Recorded witnesses are the ranks by full ranking, every fifth source falsified.

    Both sides are written one after the other, so the driver never holds the lookup tables of both in one plan."""
    scored = move_scores(x)
    ranked = Q.policy_rank(scored)
    recorded = ranked.where("transition_code = 1").groupBy("policy", "source_id").agg(F.min("rank").alias("first_rank"))
    falsified = recorded.withColumn("first_rank", F.col("first_rank") + F.when(F.pmod(F.col("source_id"), F.lit(5)) == 0, 1).otherwise(0))
    falsified = stage(falsified, "recorded")
    return Q.witness_check(falsified, stage(Q.first_hit_rank(scored), "recomputed"), ["policy", "source_id"], ["first_rank"])


X.define(
    "stored_ranked", ("move_scores",),
    """SELECT *, row_number() OVER (PARTITION BY policy, source_id ORDER BY score DESC, cand) AS rank FROM (
      SELECT policy, source_id, cand, score + CASE WHEN cand % 50 = 0 AND source_id % 2 = 0 THEN 1 ELSE 0 END AS score FROM move_scores)""",
)


def stored_scores(x):
    """A second ranking: every fiftieth candidate of even sources scores one higher."""
    nudge = F.when((F.pmod(F.col("cand"), F.lit(50)) == 0) & (F.pmod(F.col("source_id"), F.lit(2)) == 0), 1).otherwise(0)
    return move_scores(x).select("policy", "source_id", "cand", (F.col("score") + nudge).alias("score"))


@query(
    "rank_agreement", ("ranked", "stored_ranked"),
    """WITH j AS (SELECT a.policy, a.source_id, a.rank AS ra, b.rank AS rb, a.score AS sa, b.score AS sb FROM ranked a JOIN stored_ranked b USING (policy, source_id, cand)),
      r AS (SELECT *, rank() OVER (PARTITION BY policy, source_id ORDER BY sa) + (count(*) OVER (PARTITION BY policy, source_id, sa) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY policy, source_id ORDER BY sb) + (count(*) OVER (PARTITION BY policy, source_id, sb) - 1) / 2 AS ry FROM j)
      SELECT policy, source_id, bool_and(ra = rb) AS ranking_identical, bool_and(sa = sb) AS move_scores_equal, CAST(0 AS BIGINT) AS missing, max(abs(sa - sb)) AS move_score_max_abs_difference,
        count(*) FILTER (ra <= 100 AND rb <= 100) AS top_overlap, bool_or(ra = 1 AND rb = 1) AS first_rank_identical, round(covar_pop(rx, ry) / sqrt(var_pop(rx)) / sqrt(var_pop(ry)), 9) AS move_score_spearman
      FROM r GROUP BY 1, 2""".replace("WITH j AS", "SELECT * FROM (WITH j AS") + ")",
)
def _(x):
    fresh = Q.policy_rank(move_scores(x).select("policy", "source_id", "cand", "score"))
    return rounded(Q.rank_agreement(fresh, Q.policy_rank(stored_scores(x))))


@query(
    "topk_intersection", ("ranked", "stored_ranked"),
    "SELECT policy, source_id, count(*) AS overlap FROM ranked a JOIN stored_ranked b USING (policy, source_id, cand) WHERE a.rank <= 100 AND b.rank <= 100 GROUP BY 1, 2",
)
def _(x):
    return Q.topk_intersection(move_scores(x), stored_scores(x), 100)


# ---------------------------------------------------------------- randomized policies

MULTIPLES = (10, 100, 1000)


def weighted(x):
    correct = x.summary.where("clean_correct")
    counts = correct.select("source_id", F.col("unique_candidates").alias("capacity"), "adverse_unique")
    ranked = margin_ranks(x).select("ranking", "source_id", "rank").join(counts, "source_id")
    return Q.policy_weights(ranked, correct.agg(F.count(F.lit(1)).alias("m")), MULTIPLES)


X.define(
    "weighted", ("rates", "summary"),
    f"""SELECT ranking, policy, m * b AS budget, source_id, rank, capacity, adverse_unique, m, CAST(CASE policy WHEN 'uniform' THEN 1
        WHEN 'lowest_10_percent' THEN CAST(rank <= (m * 10 + 99) // 100 AS INTEGER) WHEN 'lowest_25_percent' THEN CAST(rank <= (m * 25 + 99) // 100 AS INTEGER)
        WHEN 'lowest_50_percent' THEN CAST(rank <= (m * 50 + 99) // 100 AS INTEGER) ELSE 1 + 4 * CAST(rank <= (m * 25 + 99) // 100 AS INTEGER) END AS BIGINT) AS weight
      FROM (SELECT r.*, s.unique_candidates AS capacity, s.adverse_unique, (SELECT count(*) FROM rates) AS m FROM ({MARGIN_RANK_SQL}) r JOIN summary s USING (source_id)),
        (VALUES ('uniform'), ('lowest_10_percent'), ('lowest_25_percent'), ('lowest_50_percent'), ('half_uniform_half_quartile')) p(policy), (VALUES {', '.join(f'({b})' for b in MULTIPLES)}) v(b)""",
)
G = "PARTITION BY ranking, policy, budget"
X.define(
    "levels", ("weighted",),
    f"""SELECT *, CASE WHEN weight > 0 THEN least(budget, c1) ELSE greatest(0, budget - c1) END AS pb, sum(u) OVER ({G}, phase) AS pw,
        sum(capacity) OVER o - capacity AS cb, sum(u) OVER o - u AS wb
      FROM (SELECT *, CASE WHEN weight > 0 THEN 1 ELSE 2 END AS phase, CASE WHEN weight > 0 THEN weight ELSE 1 END AS u, sum(CASE WHEN weight > 0 THEN capacity ELSE 0 END) OVER ({G}) AS c1 FROM weighted)
      WINDOW o AS ({G}, phase ORDER BY capacity / u, source_id ROWS UNBOUNDED PRECEDING)""",
)
X.define(
    "shares", ("levels",),
    f"""SELECT *, CASE WHEN full_ THEN capacity ELSE ((pb - used) * u) // greatest(1, pw - gone) END AS fl, CASE WHEN full_ THEN -1 ELSE ((pb - used) * u) % greatest(1, pw - gone) END AS rem
      FROM (SELECT *, coalesce(sum(capacity) FILTER (full_) OVER ({G}, phase), 0) AS used, coalesce(sum(u) FILTER (full_) OVER ({G}, phase), 0) AS gone
        FROM (SELECT *, capacity * (pw - wb) <= u * (pb - cb) AS full_ FROM levels))""",
)
X.define(
    "allocated", ("shares",),
    f"""SELECT ranking, policy, budget, source_id, rank, capacity, adverse_unique, m, CAST(fl + CASE WHEN row_number() OVER ({G} ORDER BY rem DESC, source_id) <= budget - sum(fl) OVER ({G}) THEN 1 ELSE 0 END AS BIGINT) AS queries,
      budget > c1 AS uniform_overflow FROM shares""",
)


@query("allocate_budget", ("allocated",), "SELECT ranking, policy, budget, source_id, queries, uniform_overflow FROM allocated")
def _(x):
    return Q.allocate_budget(weighted(x), ["ranking", "policy", "budget"]).select("ranking", "policy", "budget", "source_id", "queries", "uniform_overflow")


MISS = """CASE WHEN least(a, q) <= 0 THEN 0e0 WHEN q > n - a THEN 1e0 ELSE 1 - exp(list_sum(list_transform(range(CAST(least(a, q) AS BIGINT)), lambda k: ln(1 - CAST(greatest(a, q) AS DOUBLE) / (n - k))))) END"""
X.define("detected", ("allocated",), f"SELECT *, {MISS} AS p FROM (SELECT *, capacity AS n, adverse_unique AS a, queries AS q FROM allocated)")


@query("detection_probability", ("detected",), "SELECT ranking, policy, budget, source_id, round(p, 9) AS p FROM detected")
def _(x):
    allocated = Q.allocate_budget(weighted(x), ["ranking", "policy", "budget"])
    p = Q.detection_probability(F.col("capacity"), F.col("adverse_unique"), F.col("queries"))
    return allocated.select("ranking", "policy", "budget", "source_id", F.round(p, 9).alias("p"))


TRACKED = 4
SWEEP_SQL = f"""SELECT ranking, policy, budget, round(sum(p), 6) AS expected_detected_sources, round(CASE WHEN bool_or(adverse_unique > 0 AND p <= 0) THEN 0e0
    ELSE exp(sum(CASE WHEN adverse_unique > 0 AND p > 0 THEN ln(p) ELSE 0 END)) END, 9) AS probability_detect_all, bool_or(uniform_overflow) AS uniform_overflow,
    max(rank) FILTER (source_id = {TRACKED}) AS tracked_rank, max(queries) FILTER (source_id = {TRACKED}) AS tracked_queries,
    count(*) FILTER (adverse_unique > 0 AND rank <= (m * 25 + 99) // 100) AS vulnerable_in_lowest_quartile, count(*) FILTER (adverse_unique > 0 AND rank <= (m * 50 + 99) // 100) AS vulnerable_in_lowest_half
  FROM detected GROUP BY 1, 2, 3"""


def sweep(x):
    swept = Q.policy_sweep(weighted(x), TRACKED)
    return swept.withColumns({
        "expected_detected_sources": F.round("expected_detected_sources", 6), "probability_detect_all": F.round("probability_detect_all", 9),
    })


@query("policy_sweep", ("detected",), SWEEP_SQL)
def _(x):
    return sweep(x)


def _table_sql() -> str:
    expected = ", ".join(
        f"max(expected_detected_sources) FILTER (policy = '{p}') AS {p}_expected"
        for p in ("uniform", "lowest_10_percent", "lowest_25_percent", "lowest_50_percent", "half_uniform_half_quartile")
    )
    found = ", ".join(f"max(actual_discovered_sources) FILTER (policy = '{p}') AS {p}_discovered" for p in POLICIES)
    return f"""SELECT e.*, f.* EXCLUDE (budget) FROM (SELECT budget, {expected} FROM ({SWEEP_SQL}) WHERE ranking = 'raw_margin' GROUP BY 1) e
      JOIN (SELECT budget_per_source * (SELECT count(*) FROM rates) AS budget, {found} FROM ({DISCOVERY_SQL}) GROUP BY 1) f USING (budget)"""


@query("search_table", ("detected", "ranked", "rates"), _table_sql())
def _(x):
    size = x.summary.where("clean_correct").agg(F.count(F.lit(1)).alias("m"))
    return Q.search_table(sweep(x), discovery(x), size)
