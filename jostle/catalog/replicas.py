"""Queries: two models on the same sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from jostle.catalog import fixtures as X
from jostle.catalog.neighborhood import rounded
from jostle.catalog.registry import query
from jostle.operators import inference as I
from jostle.operators import replicas as P
from jostle.plans.joins import attach
from jostle.plans.ordering import running
from jostle.plans.staging import stage

REPS, SEED = 20_000, 701
CASE = "CASE WHEN transition_code <> 0 THEN 3 WHEN list_sum(list_transform({d}, lambda v: abs(v))) = 0 THEN 0 WHEN {m} = {c} THEN 1 ELSE 2 END"
LEVEL = CASE.format(d=X.diff_sql("scores", "clean_scores"), m=X.top_margin_sql("scores"), c=X.top_margin_sql("clean_scores"))
X.define(
    "outcomes", ("moves", "moves_b"),
    " UNION ALL ".join(
        f"""SELECT '{r}' AS replica, source_id, any_value(label) AS label, any_value(clean_prediction) AS clean_prediction, any_value(label = clean_prediction) AS clean_correct,
          count(*) AS candidates, {', '.join(f'count(*) FILTER (level = {i}) AS t{i}' for i in range(4))}, count(*) FILTER (transition_code = 1) AS adverse,
          count(*) FILTER (transition_code = 2) AS corrective, count(*) FILTER (transition_code = 3) AS lateral
          FROM (SELECT *, {LEVEL} AS level FROM {table}) GROUP BY source_id""" for r, table in (("A", "moves"), ("B", "moves_b"))
    ),
)
PAIR_COLUMNS = ", ".join(
    f"max({c}) FILTER (replica = '{r}') AS {r}_{n}" for r in "AB" for c, n in [("clean_correct", "correct"), ("candidates", "neighbors"), *[(f'"{o}"', o) for o in P.OUTCOMES]]
)
PAIR_RATES = ", ".join(f"{r}_{o} / {r}_neighbors AS {r}_{o}_rate" for r in "AB" for o in P.OUTCOMES)
X.define("paired", ("outcomes",), f"SELECT *, A_neighbors AS neighbors, {PAIR_RATES} FROM (SELECT source_id, label, {PAIR_COLUMNS} FROM outcomes GROUP BY 1, 2)")


def outcomes(x):
    """Staged outcome table of both replicas, one row per replica and source."""

    def build():
        a = P.replica_outcomes(P.hierarchy(x.scored), x.sources).withColumn("replica", F.lit("A"))
        b = P.replica_outcomes(P.hierarchy(x.scored_b), x.sources_b).withColumn("replica", F.lit("B"))
        return stage(a.unionByName(b), "outcomes")

    return x.once("outcomes", build)


def paired(x):
    return P.pair_replicas(outcomes(x), "replica")


@query("replica_outcomes", ("outcomes",), "SELECT * FROM outcomes")
def _(x):
    return outcomes(x)


@query(
    "pair_replicas", ("paired",),
    f"SELECT * REPLACE ({', '.join(f'round({r}_{o}_rate, 9) AS {r}_{o}_rate' for r in 'AB' for o in P.OUTCOMES)}) FROM paired",
)
def _(x):
    return rounded(paired(x))


@query(
    "replica_consistency", ("outcomes",),
    """SELECT unnest(['missing_pair', 'label_differs', 'neighbors_differ', 'cohort_differs', 'count_differs', 'rate_differs', 'partition_broken', 't3_split_broken']) AS check,
      unnest([CAST(0 AS BIGINT), 0, 0, 0, count(*) FILTER (replica = 'B' AND source_id % 10 = 0), count(*) FILTER (replica = 'B' AND source_id % 10 = 0), 0, 0]) AS violations FROM outcomes""".replace("check,", '"check",'),
)
def _(x):
    """The paired table has every tenth source's B_t0 raised by one."""
    off = F.when(F.pmod(F.col("source_id"), F.lit(10)) == 0, 1).otherwise(0)
    falsified = paired(x).withColumn("B_t0", F.col("B_t0") + off).withColumn("B_t0_rate", F.col("B_t0") / F.col("B_neighbors"))
    return P.replica_consistency(outcomes(x), falsified, "replica")


CHECKS = ["prediction_disagrees_with_scores", "repeated_source", "missing_source", "panel_source_missing", "panel_prediction_differs", "panel_label_differs"]


@query(
    "validation_consistency", ("sources", "outcomes"),
    f"""SELECT * FROM (WITH n AS (SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS place FROM sources),
        p AS (SELECT replica, o.source_id, place FROM outcomes o JOIN n USING (source_id))
      SELECT replica, unnest({CHECKS}) AS "check", unnest([count(*) FILTER (place % 20 = 3 AND place % 9 <> 4), count(*) FILTER (place % 15 = 2 AND place % 9 <> 4), count(*) FILTER (place % 9 = 4 AND place < last), count(*) FILTER (place % 9 = 4),
        count(*) FILTER (place % 20 = 3 AND place % 9 <> 4), CASE WHEN replica = 'B' THEN count(*) FILTER (place % 11 = 5 AND place % 9 <> 4) ELSE 0 END]) AS violations
      FROM (SELECT *, max(place) FILTER (place % 9 <> 4) OVER () AS last FROM p) GROUP BY replica)""",
)
def _(x):
    """Validation runs numbered like the panel; some sources are missing, repeated, or stored with a wrong prediction or label."""
    place = running(x.sources.select("source_id"), [], [F.col("source_id").asc()], out="place").withColumn("place", F.col("place") - 1)
    place = stage(place, "places")
    at = lambda k, r: F.pmod(F.col("place"), F.lit(k)) == r
    runs = x.sources.withColumn("replica", F.lit("A")).unionByName(x.sources_b.withColumn("replica", F.lit("B")), allowMissingColumns=True)
    kept = attach(runs.select("replica", "source_id", "scores", F.col("clean_prediction").alias("prediction"), "label"), place, ["source_id"]).where(~at(9, 4))
    wrong = kept.select(
        "replica", F.col("place").alias("source_id"), "scores", F.when(at(20, 3), F.pmod(F.col("prediction") + 1, F.lit(X.CLASSES))).otherwise(F.col("prediction")).alias("prediction"),
        F.when(at(11, 5) & (F.col("replica") == "B"), F.col("label") + 1).otherwise(F.col("label")).alias("label"), F.explode(F.when(at(15, 2), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    panel = attach(outcomes(x), place, ["source_id"]).drop("source_id").withColumnRenamed("place", "source_id")
    return P.validation_consistency(panel, wrong.drop("copy"), "replica")


@query(
    "replica_table", ("outcomes",),
    f"""SELECT replica, count(*) AS sources, CAST(sum(candidates) AS BIGINT) AS neighbors, {', '.join(f'CAST(sum("{o}") AS BIGINT) AS "{o}"' for o in P.OUTCOMES)},
      CAST(sum(t1 + t2 + t3) AS BIGINT) AS score_changed_neighbors, round(sum(t1) / sum(t1 + t2 + t3), 9) AS margin_kept_fraction_of_changes,
      count(*) FILTER (clean_correct) AS initially_correct_sources, count(*) FILTER (clean_correct AND t3 = 0) AS robust_correct_sources,
      count(*) FILTER (clean_correct AND adverse > 0) AS adverse_sensitive_sources FROM outcomes GROUP BY 1""",
)
def _(x):
    return rounded(P.replica_table(outcomes(x), "replica"))


ROW_NAMES = [*P.OUTCOMES, "initially_correct_sources", "robust_correct_sources"]
ROW_VALUES = [*[f"sum(\"{{}}\") FILTER (replica = '{{r}}')".replace("{}", o) for o in P.OUTCOMES],
              "count(*) FILTER (replica = '{r}' AND clean_correct)", "count(*) FILTER (replica = '{r}' AND clean_correct AND t3 = 0)"]


@query(
    "replica_rows", ("outcomes",),
    f"""SELECT unnest({ROW_NAMES}) AS outcome, {', '.join(
        f"unnest([{', '.join('CAST(' + v.replace('{r}', r) + ' AS BIGINT)' for v in ROW_VALUES)}]) AS replica_{r.lower()}" for r in 'AB')} FROM outcomes""",
)
def _(x):
    return P.replica_rows(P.replica_table(outcomes(x), "replica"), "replica")


COHORT_SQL = """SELECT *, unnest(['full_panel', CASE WHEN A_correct AND B_correct THEN 'both_correct' WHEN B_correct THEN 'A_wrong_B_correct' WHEN A_correct THEN 'A_correct_B_wrong' ELSE 'both_wrong' END]) AS cohort FROM paired"""
X.define("cohorts", ("paired",), COHORT_SQL)


@query("cohort_semi", ("paired",), "SELECT source_id, label, A_t3, B_t3 FROM paired WHERE A_correct AND B_correct")
def _(x):
    ids = outcomes(x).where("clean_correct").groupBy("source_id").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("source_id")
    return paired(x).select("source_id", "label", "A_t3", "B_t3").join(ids, "source_id", "left_semi")


@query("complement_anti", ("paired",), "SELECT source_id, label, A_t3, B_t3 FROM paired WHERE NOT (A_correct AND B_correct)")
def _(x):
    ids = outcomes(x).where("clean_correct").groupBy("source_id").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("source_id")
    return paired(x).select("source_id", "label", "A_t3", "B_t3").join(ids, "source_id", "left_anti")


@query(
    "cohort_decomposition", ("paired",),
    """SELECT cohort, count(*) AS sources, CAST(sum(A_t3) AS BIGINT) AS A_t3, CAST(sum(B_t3) AS BIGINT) AS B_t3, CAST(sum(A_adverse) AS BIGINT) AS A_adverse, CAST(sum(B_adverse) AS BIGINT) AS B_adverse,
      round(avg(A_adverse_rate), 9) AS A_mean_adverse_rate, round(avg(B_adverse_rate), 9) AS B_mean_adverse_rate,
      round(CASE WHEN sum(A_t3) > 0 THEN sum(B_t3) / sum(A_t3) END, 9) AS t3_ratio_B_over_A, round(100e0 * (avg(B_adverse_rate) - avg(A_adverse_rate)), 9) AS adverse_difference_pp
      FROM (SELECT *, unnest(CASE WHEN A_correct AND B_correct THEN ['other', 'both_correct', 'all'] WHEN NOT A_correct AND B_correct AND B_adverse > 0 THEN ['only_B_vulnerable', 'all'] ELSE ['other', 'all'] END) AS cohort FROM paired) GROUP BY 1""",
)
def _(x):
    return rounded(P.cohort_decomposition(paired(x)))


X.define(
    "cohort_slots", ("cohorts",),
    "SELECT cohort, label, source_id, A_t3_rate, B_t3_rate, A_adverse_rate, B_adverse_rate, row_number() OVER (PARTITION BY cohort, label ORDER BY source_id) - 1 AS slot, count(*) OVER (PARTITION BY cohort, label) AS n FROM cohorts",
)


@query(
    "paired_stratified_bootstrap", ("cohort_slots",),
    f"""SELECT cohort, o.sources, o.label_strata, round(o.t3, 9) AS t3_difference, round(o.adverse, 9) AS adverse_difference,
      round(quantile_cont(b.t3, 0.025), 9) AS t3_ci_low, round(quantile_cont(b.t3, 0.975), 9) AS t3_ci_high, round(quantile_cont(b.adverse, 0.025), 9) AS adverse_ci_low, round(quantile_cont(b.adverse, 0.975), 9) AS adverse_ci_high
      FROM (SELECT a.cohort, a.rep, 100e0 * (avg(v.B_t3_rate) - avg(v.A_t3_rate)) AS t3, 100e0 * (avg(v.B_adverse_rate) - avg(v.A_adverse_rate)) AS adverse FROM
          (SELECT cohort, label, rep, {X.index_sql(SEED, 'rep', 'cohort', 'label', 'slot')} % n AS pick FROM cohort_slots, (SELECT unnest(range({REPS})) AS rep)) a
          JOIN cohort_slots v ON v.cohort = a.cohort AND v.label = a.label AND v.slot = a.pick GROUP BY 1, 2) b
      JOIN (SELECT cohort, count(*) AS sources, count(DISTINCT label) AS label_strata, 100e0 * (avg(B_t3_rate) - avg(A_t3_rate)) AS t3, 100e0 * (avg(B_adverse_rate) - avg(A_adverse_rate)) AS adverse FROM cohorts GROUP BY 1) o USING (cohort)
      GROUP BY ALL""",
)
def _(x):
    members = P.cohort_of(paired(x)).select("cohort", "source_id", "label", "A_t3_rate", "B_t3_rate", "A_adverse_rate", "B_adverse_rate")
    pairs = {"t3": ("A_t3_rate", "B_t3_rate"), "adverse": ("A_adverse_rate", "B_adverse_rate")}
    return rounded(I.paired_stratified_bootstrap(members, pairs, REPS, SEED))


Z = "1.959963984540054e0"


def _agreement_sql() -> str:
    low, n = "least(only_a, only_b)", "(only_a + only_b)"
    term = f"exp(-{n} * ln(2e0) + coalesce(list_sum(list_transform(range(k), lambda j: ln(CAST({n} - j AS DOUBLE) / (j + 1)))), 0e0))"
    tail = f"(SELECT sum({term}) FROM (SELECT unnest(range({low} + 1)) AS k))"
    wil = lambda sign: f"(p + {Z}*{Z}/(2*sources) {sign} {Z} * sqrt(p*(1-p)/sources + {Z}*{Z}/(4*sources*sources))) / (1 + {Z}*{Z}/sources)"
    return f"""SELECT cohort, sources, both AS "both", only_a, only_b, neither, round((both + neither) / sources, 9) AS agreement, round(CASE WHEN both + only_a + only_b > 0 THEN both / (both + only_a + only_b) END, 9) AS jaccard,
      round(CASE WHEN {n} = 0 THEN 1e0 ELSE least(1e0, 2 * {tail}) END, 9) AS mcnemar_p, round({wil('-')}, 9) + 0e0 AS wilson_low, round({wil('+')}, 9) AS wilson_high
      FROM (SELECT *, (both + only_a) / sources AS p FROM (SELECT cohort, count(*) AS sources, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b,
        count(*) FILTER (NOT a AND NOT b) AS neither FROM (SELECT cohort, A_t3 > 0 AS a, B_t3 > 0 AS b FROM cohorts) GROUP BY 1))""".replace("both", "in_both").replace('AS "in_both"', 'AS "both"')


@query("paired_agreement", ("cohorts",), _agreement_sql().replace("in_both_correct", "both_correct"))
def _(x):
    rows = P.cohort_of(paired(x))
    out = rounded(P.paired_agreement(rows, ["cohort"], F.col("A_t3") > 0, F.col("B_t3") > 0))
    return out.withColumn("wilson_low", F.col("wilson_low") + 0.0)
