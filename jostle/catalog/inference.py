"""Queries: activation traces, rank statistics, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from jostle.catalog import fixtures as X
from jostle.catalog.neighborhood import LAST, RATE, part_sql, rounded
from jostle.catalog.registry import query
from jostle.functions import scores as S
from jostle.operators import census as C
from jostle.operators import inference as I

W = X.WIDTH
R = "response"
REPS = 10_000  # repetitions of every resampling; a parameter of the operators

X.define("response", ("moves",), f"SELECT *, {X.trace_sql('source_id', 'cand', '6', '2')} AS v FROM moves")
X.define(
    "traces", ("moves",),
    f"""SELECT source_id, cand, transition_code, multiplicity, stage, metric, {X.trace_sql('source_id', 'cand', 'stage', 'metric')} AS value
      FROM moves, (SELECT unnest(range({X.STAGES})) AS stage) s, (SELECT unnest(range({X.METRICS})) AS metric) m""",
)
X.define(
    "patches", ("moves",),
    f"""SELECT *, CASE WHEN ok THEN clean_prediction ELSE candidate_prediction END AS patch_prediction, CASE WHEN ok THEN clean_scores ELSE scores END AS patch_scores
      FROM (SELECT *, stage IN (0, 3, 6) OR (cand + stage) % 5 < 4 AS ok FROM moves, (SELECT unnest(range({X.STAGES})) AS stage) s WHERE transition_code <> 0)""",
)
OUTCOME_VALUES = "(VALUES (0, 'class_preserved'), (1, 'adverse'), (2, 'corrective'), (3, 'lateral')) o(code, outcome)"


@query(
    "distribution_by_outcome", ("response",),
    f"""SELECT outcome, count(v) AS candidates, count(DISTINCT source_id) AS sources, count(*) FILTER (v = 0) AS exact_zero, count(*) FILTER (v > 0) AS nonzero,
      round(quantile_cont(v, 0.25), 9) AS pooled_q1, round(quantile_cont(v, 0.5), 9) AS pooled_median, round(quantile_cont(v, 0.75), 9) AS pooled_q3, round(avg(v), 9) AS pooled_mean,
      (SELECT round(avg(m), 9) FROM (SELECT transition_code, avg(v) AS m FROM response GROUP BY transition_code, source_id) q WHERE q.transition_code = o.code) AS equal_source_mean
      FROM {OUTCOME_VALUES} LEFT JOIN response r ON r.transition_code = o.code GROUP BY o.code, outcome""",
)
def _(x):
    return rounded(C.distribution_by_outcome(x.final_response(x.moves), R))


@query(
    "median_of_medians", ("response",),
    """SELECT round(quantile_cont(m, 0.25), 9) AS within_source_median_q1, round(quantile_cont(m, 0.5), 9) AS within_source_median, round(quantile_cont(m, 0.75), 9) AS within_source_median_q3
      FROM (SELECT quantile_cont(v, 0.5) AS m FROM response WHERE transition_code = 0 GROUP BY source_id)""",
)
def _(x):
    return rounded(C.median_of_medians(x.final_response(x.moves), R))


@query(
    "trace_group_means", ("traces",),
    """SELECT transition_code, stage, metric, round(avg(value), 9) AS mean_unique, round(sum(value * multiplicity) / sum(multiplicity), 9) AS mean_event_weighted
      FROM traces GROUP BY 1, 2, 3""",
)
def _(x):
    return rounded(C.trace_group_means(x.traces(x.moves)))


@query(
    "restoration_rates", ("patches",),
    f"""SELECT transition_code, stage, count(*) AS n_unique, CAST(sum(multiplicity) AS BIGINT) AS n_event_weighted,
      round({RATE.format('patch_prediction = clean_prediction')}, 9) AS restored_clean_unique, round(coalesce(sum(multiplicity) FILTER (patch_prediction = clean_prediction), 0) / sum(multiplicity), 9) AS restored_clean_event_weighted,
      round({RATE.format('patch_prediction = label')}, 9) AS restored_true_unique, round(coalesce(sum(multiplicity) FILTER (patch_prediction = label), 0) / sum(multiplicity), 9) AS restored_true_event_weighted,
      round({RATE.format(X.target_margin_sql('patch_scores', 'clean_prediction') + ' > 0')}, 9) AS positive_clean_margin_unique FROM patches GROUP BY 1, 2""",
)
def _(x):
    return rounded(C.restoration_rates(x.patches(x.scored)))


@query(
    "restoration_ranges", ("patches",),
    f"""SELECT transition_code, round(min(c), 9) AS clean_min, round(max(c), 9) AS clean_max, round(min(t), 9) AS true_min, round(max(t), 9) AS true_max FROM (
      SELECT transition_code, stage, avg(c) AS c, avg(t) AS t FROM (SELECT transition_code, stage, source_id, {RATE.format('patch_prediction = clean_prediction')} AS c,
        {RATE.format('patch_prediction = label')} AS t FROM patches WHERE stage IN (1, 2, 4, 5) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""",
)
def _(x):
    return rounded(C.restoration_ranges(x.patches(x.scored), [1, 2, 4, 5]))


@query(
    "positive_controls", ("patches",),
    f"""SELECT stage, CAST(max(list_max(list_transform({X.diff_sql('patch_scores', 'clean_scores')}, lambda v: abs(v)))) AS DOUBLE) AS max_abs_to_clean,
      round({RATE.format('patch_prediction = clean_prediction')}, 9) AS restoration_rate FROM patches WHERE stage IN (0, 3, 6) GROUP BY 1""",
)
def _(x):
    return rounded(C.positive_controls(x.patches(x.scored), [0, 3, 6]))


# ---------------------------------------------------------------- ranks

X.define(
    "rates", ("summary",),
    "SELECT source_id, label, clean_margin, horizon, adverse_unique, adverse_unique / unique_candidates AS adverse_rate FROM summary WHERE clean_correct",
)


def rates(x):
    return x.summary.where("clean_correct").select(
        "source_id", "label", "clean_margin", "horizon", "adverse_unique",
        F.try_divide("adverse_unique", "unique_candidates").alias("adverse_rate"),
    )


@query(
    "average_rank", ("rates",),
    "SELECT source_id, rank() OVER (ORDER BY adverse_rate) + (count(*) OVER (PARTITION BY adverse_rate) - 1) / 2 AS rank FROM rates",
)
def _(x):
    return I.average_rank(rates(x), [], "adverse_rate").select("source_id", "rank")


MARGIN_RANK_SQL = """SELECT source_id, ranking, row_number() OVER (PARTITION BY ranking ORDER BY value, source_id) AS rank FROM (
  SELECT source_id, unnest(['raw_margin', 'margin_per_horizon']) AS ranking, unnest([CAST(clean_margin AS DOUBLE), clean_margin / horizon]) AS value FROM rates)"""


def margin_ranks(x):
    values = F.array(
        F.struct(F.lit("raw_margin").alias("ranking"), F.col("clean_margin").cast("double").alias("value")),
        F.struct(F.lit("margin_per_horizon").alias("ranking"), (F.col("clean_margin") / F.col("horizon")).alias("value")),
    )
    rows = rates(x).select("source_id", F.explode(values).alias("v")).select("source_id", "v.ranking", "v.value")
    return I.margin_rank(rows, ["ranking"], "value")


@query("margin_rank", ("rates",), f"SELECT source_id, ranking, rank, rank <= (SELECT (count(*) + 3) // 4 FROM rates) AS lowest_quartile FROM ({MARGIN_RANK_SQL})")
def _(x):
    ranks = margin_ranks(x)
    size = rates(x).agg(F.call_function("div", F.count(F.lit(1)) + 3, F.lit(4)).alias("quarter"))
    return ranks.join(F.broadcast(size)).select("source_id", "ranking", "rank", (F.col("rank") <= F.col("quarter")).alias("lowest_quartile"))


@query(
    "cumulative_share", ("rates",),
    """SELECT source_id, adverse_unique, row_number() OVER o AS rank, round(sum(adverse_unique) OVER o / sum(adverse_unique) OVER (), 9) AS share
      FROM rates WHERE adverse_unique > 0 WINDOW o AS (ORDER BY adverse_unique DESC, source_id ROWS UNBOUNDED PRECEDING)""",
)
def _(x):
    return rounded(I.cumulative_share(rates(x), "adverse_unique"))


# ---------------------------------------------------------------- correlations


def ranks_sql(table: str, keys: str, x: str, y: str) -> str:
    by = lambda *c: ("PARTITION BY " + ", ".join(k for k in (keys, *c) if k)) if keys or c else ""
    return f"""SELECT *, rank() OVER ({by()} ORDER BY {x}) + (count(*) OVER ({by(x)}) - 1) / 2 AS rx,
      rank() OVER ({by()} ORDER BY {y}) + (count(*) OVER ({by(y)}) - 1) / 2 AS ry FROM {table}"""


RHO = "CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / sqrt(var_pop(rx)) / sqrt(var_pop(ry)) END"


@query("spearman", ("rates",), f"SELECT count(*) AS n, round({RHO}, 9) AS rho FROM ({ranks_sql('rates', '', 'clean_margin', 'adverse_rate')})")
def _(x):
    return rounded(I.spearman(rates(x), [], "clean_margin", "adverse_rate"))


X.define(
    "u2_rows", ("moves",),
    f"""SELECT source_id, subset, r AS x, target, CAST(y AS DOUBLE) AS y FROM (
      SELECT *, unnest(['score_l2', 'absolute_margin', 'signed_margin']) AS target, unnest([l2, abs(signed), signed]) AS y FROM (
        SELECT *, unnest(CASE WHEN r > 0 AND transition_code = 0 THEN ['all_neighbors', 'nonzero_internal_response', 'preserved_nonzero_response']
            WHEN r > 0 THEN ['all_neighbors', 'nonzero_internal_response'] ELSE ['all_neighbors'] END) AS subset
        FROM (SELECT source_id, transition_code, {X.trace_sql('source_id', 'cand', '6', '2')} AS r,
          list_sum(list_transform({X.diff_sql('scores', 'clean_scores')}, lambda v: v * v)) AS l2,
          {X.target_margin_sql('scores', 'label')} - {X.target_margin_sql('clean_scores', 'label')} AS signed FROM moves)))""",
)
X.define("u2_ranks", ("u2_rows",), ranks_sql("u2_rows", "subset, target, source_id", "x", "y"))


@query(
    "within_source_spearman", ("u2_ranks",),
    f"""SELECT subset, target, count(*) AS sources, round(quantile_cont(rho, 0.5), 9) AS median_rho FROM (
      SELECT subset, target, source_id, {RHO} AS rho FROM u2_ranks GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def _(x):
    rows = C.subset_masks(x.final_response(x.scored), R)
    s, c, label = F.col("scores"), F.col("clean_scores"), F.col("label").cast("int")
    signed = S.target_margin(s, label, X.CLASSES) - S.target_margin(c, label, X.CLASSES)
    # The squared L2 change orders moves exactly as the L2 change does and stays an integer.
    squares = S.squared_change(s, c, X.CLASSES)
    targets = {"score_l2": squares, "absolute_margin": F.abs(signed), "signed_margin": signed}
    return rounded(I.within_source_spearman(rows, "subset", R, targets))


# ---------------------------------------------------------------- resampling


def boot_sql(table: str, keys: str, value: str, seed: str, reps: int, order: str = "source_id") -> str:
    """Bootstrap means per (keys, rep) of ``value`` in ``table``; the seed is a SQL expression."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    on = " AND ".join([f"a.{c.strip()} = b.{c.strip()}" for c in keys.split(",")] if keys else []) or "true"
    cols = ", ".join(f"a.{c.strip()}" for c in keys.split(",")) + ", " if keys else ""
    indexed = f"(SELECT *, row_number() OVER ({part} ORDER BY {order}) - 1 AS slot, count(*) OVER ({part}) AS n FROM {table})"
    return f"""SELECT {cols}a.rep, avg(b.{value}) AS m FROM (SELECT {k}rep, {X.index_sql(seed, 'rep', 'slot')} % n AS pick FROM {indexed}, (SELECT unnest(range({reps})) AS rep)) a
      JOIN {indexed} b ON {on} AND b.slot = a.pick GROUP BY {cols}a.rep"""


BOOT_SEED, FLIP_SEED, PERM_SEED, STRATA_SEED, FAMILY_SEED, RESTORED_SEED = 101, 211, 307, 401, 503, 601


@query(
    "bootstrap_mean_ci", ("rates",),
    f"""SELECT n AS n_sources, round(mean, 9) AS mean, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high FROM
      (SELECT count(*) AS n, avg(adverse_rate) AS mean FROM rates), (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM ({boot_sql('rates', '', 'adverse_rate', str(BOOT_SEED), REPS)}))""",
)
def _(x):
    return rounded(I.bootstrap_mean_ci(rates(x).select("source_id", "adverse_rate"), "adverse_rate", REPS, BOOT_SEED))


def flip_sql(table: str, keys: str, value: str, seed: str, reps: int) -> str:
    """Sign-flip p-values per keys, compared in units of 1e-12."""
    part = f"PARTITION BY {keys}"
    return f"""SELECT {keys}, (1 + count(*) FILTER (abs(s) >= abs(o))) / ({reps} + 1e0) AS p_value FROM (
      SELECT {keys}, rep, sum(CASE WHEN {X.sign_sql(seed, 'rep', 'slot')} = 0 THEN -u ELSE u END) AS s, max(o) AS o FROM (
        SELECT *, row_number() OVER ({part} ORDER BY source_id) - 1 AS slot, sum(u) OVER ({part}) AS o FROM (SELECT *, CAST(round({value} * 1e12) AS BIGINT) AS u FROM {table})),
      (SELECT unnest(range({reps})) AS rep) GROUP BY {keys}, rep) GROUP BY {keys}"""


X.define(
    "direction_contrast", ("moves",),
    f"""SELECT 'all' AS test, source_id, {RATE.format('transition_code <> 0')} FILTER (direction = -1) - {RATE.format('transition_code <> 0')} FILTER (direction = 1) AS contrast FROM moves GROUP BY source_id""",
)


@query(
    "signflip_test", ("direction_contrast",),
    f"""SELECT n AS n_sources, round(mean, 9) AS mean, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, round(p_value, 9) AS p_value FROM
      (SELECT count(*) AS n, avg(contrast) AS mean FROM direction_contrast),
      (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM ({boot_sql('direction_contrast', '', 'contrast', str(FLIP_SEED + 1), REPS)})),
      ({flip_sql('direction_contrast', 'test', 'contrast', str(FLIP_SEED), REPS)})""",
)
def _(x):
    changed = F.when(F.col("transition_code") != 0, 1.0).otherwise(0.0)
    side = lambda d: F.avg(F.when(F.col("direction") == d, changed))
    contrasts = x.moves.groupBy("source_id").agg((side(-1) - side(1)).alias("contrast"))
    return rounded(I.signflip_test(contrasts, "contrast", REPS, FLIP_SEED))


X.define(
    "label_slots", ("rates",),
    "SELECT *, row_number() OVER (PARTITION BY label ORDER BY source_id) - 1 AS slot, count(*) OVER (PARTITION BY label) AS n FROM rates",
)


@query(
    "stratified_bootstrap", ("label_slots",),
    f"""SELECT (SELECT round(avg(adverse_rate), 9) FROM rates) AS mean, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high FROM (
      SELECT rep, avg(b.adverse_rate) AS m FROM (SELECT label, rep, {X.index_sql(STRATA_SEED, 'rep', 'label', 'slot')} % n AS pick FROM label_slots, (SELECT unnest(range({REPS})) AS rep)) a
      JOIN label_slots b ON a.label = b.label AND b.slot = a.pick GROUP BY rep)""",
)
def _(x):
    return rounded(I.stratified_bootstrap(rates(x), "adverse_rate", "label", REPS, STRATA_SEED))


X.define(
    "perm_ranks", ("rates",),
    f"""SELECT *, row_number() OVER (PARTITION BY label ORDER BY source_id) - 1 AS slot, CAST(2 * rx AS BIGINT) AS ix, CAST(2 * ry AS BIGINT) AS iy
      FROM ({ranks_sql('rates', '', 'clean_margin', 'adverse_rate')})""",
)
PERM_SQL = f"""SELECT (1 + count(*) FILTER (s <= o)) / ({REPS} + 1e0) AS p_value FROM (
  SELECT rep, sum(b.iy * c.ix) AS s FROM (SELECT rep, label, slot, row_number() OVER (PARTITION BY rep, label ORDER BY {X.rng_sql(PERM_SEED, 'rep', 'label', 'slot')}, slot) - 1 AS target
    FROM perm_ranks, (SELECT unnest(range({REPS})) AS rep)) a JOIN perm_ranks b ON a.label = b.label AND a.slot = b.slot JOIN perm_ranks c ON a.label = c.label AND a.target = c.slot GROUP BY rep),
  (SELECT sum(ix * iy) AS o FROM perm_ranks)"""


@query("within_label_permutation", ("perm_ranks",), f"SELECT round(p_value, 9) AS p_value FROM ({PERM_SQL})")
def _(x):
    return rounded(I.within_label_permutation(rates(x), "clean_margin", "adverse_rate", "label", REPS, PERM_SEED))


@query(
    "margin_association", ("perm_ranks",),
    f"SELECT n, round(rho, 9) AS rho, round(p_value, 9) AS p_value FROM (SELECT count(*) AS n, {RHO} AS rho FROM perm_ranks), ({PERM_SQL})",
)
def _(x):
    return rounded(I.margin_association(x.summary, REPS, PERM_SEED))


# ---------------------------------------------------------------- contrast families


def _contrast_cte() -> str:
    parts = []
    mean = lambda table, value, code, s: f"avg({value}) FILTER (transition_code = {code} AND stage = {s})"
    for code, name in I.CODES.items():
        if code:
            for s in range(X.STAGES):
                parts.append(("traces", "transition_vs_preserved", f"{name}:{s}", f"{mean('', 'value', code, s)} - {mean('', 'value', 0, s)}", "WHERE metric = 2"))
            for b, (a, l) in I.BLOCKS.items():
                hit = "CASE WHEN patch_prediction = clean_prediction THEN 1e0 ELSE 0e0 END"
                parts.append(("patches", "global_vs_local_patch", f"{name}:{b}", f"{mean('', hit, code, a)} - {mean('', hit, code, l)}", ""))
        for b, (a, l) in I.BLOCKS.items():
            parts.append(("traces", "global_vs_local_trace", f"{name}:{b}", f"{mean('', 'value', code, a)} - {mean('', 'value', code, l)}", "WHERE metric = 2"))
    rate = lambda cond: f"{RATE.format('transition_code <> 0')} FILTER ({cond})"
    t, q = part_sql("from_bin", LAST, 3), part_sql("feature", str(W), 4)
    for test, a, b in (
        ("previous_minus_next", "direction = -1", "direction = 1"), ("late_minus_early", f"{t} = 2", f"{t} = 0"), ("high_minus_low", f"{q} = 3", f"{q} = 0"),
    ):
        parts.append(("moves", "geometry", test, f"{rate(a)} - {rate(b)}", ""))
    selects = [
        f"SELECT '{family}' AS family, '{test}' AS test, source_id, {value} AS contrast FROM {table} {where} GROUP BY source_id"
        for table, family, test, value, where in parts
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(selects) + ") WHERE contrast IS NOT NULL"


X.define("contrasts", ("traces", "patches"), _contrast_cte())


def contrasts(x):
    geometry = C.source_geometry(x.scored_pairs, x.sources, W)
    return I.source_contrasts(x.traces(x.moves, (2,)), x.patches(x.scored), geometry, X.STAGES, 2)


@query("source_contrasts", ("contrasts",), "SELECT family, test, source_id, round(contrast, 9) AS contrast FROM contrasts")
def _(x):
    return rounded(contrasts(x))


def test_seed():
    """Each test draws from its own stream: the seed depends on family and test name."""
    from jostle.functions.rng import draw

    return F.pmod(draw(FAMILY_SEED, F.col("family"), F.col("test")), F.lit(1_000_000_000))


SEED_SQL = f"({X.rng_sql(FAMILY_SEED, 'family', 'test')} % 1000000000)"
X.define("family_p", ("contrasts",), flip_sql("contrasts", "family, test", "contrast", SEED_SQL, REPS))
X.define("family_boot", ("contrasts",), boot_sql("contrasts", "family, test", "contrast", f"{SEED_SQL} + 1", REPS))
X.define(
    "family_tests", ("family_p", "family_boot"),
    """SELECT p.*, o.n_sources, o.mean, c.ci_low, c.ci_high FROM family_p p
      JOIN (SELECT family, test, count(*) AS n_sources, avg(contrast) AS mean FROM contrasts GROUP BY 1, 2) o USING (family, test)
      JOIN (SELECT family, test, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM family_boot GROUP BY 1, 2) c USING (family, test)""",
)
BH_SQL = """least(1e0, min(p_value * m / rank) OVER (PARTITION BY family ORDER BY rank DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "contrast_family", ("family_tests",),
    f"""SELECT family, test, n_sources, round(mean, 9) AS mean, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(p_value, 9) AS p_value, round({BH_SQL}, 9) AS q_value
      FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value, test) AS rank, count(*) OVER (PARTITION BY family) AS m FROM family_tests)""",
)
def _(x):
    return rounded(I.contrast_family(contrasts(x), REPS, test_seed()))


X.define(
    "restored", ("patches",),
    f"""SELECT transition_code, stage, source_id, {RATE.format('patch_prediction = clean_prediction')} AS restored_clean FROM patches GROUP BY 1, 2, 3""",
)


@query(
    "restoration_intervals", ("restored",),
    f"""SELECT o.*, c.ci_low, c.ci_high FROM (SELECT transition_code, stage, count(*) AS n_sources, round(avg(restored_clean), 9) AS mean FROM restored GROUP BY 1, 2) o
      JOIN (SELECT transition_code, stage, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high
        FROM ({boot_sql('restored', 'transition_code, stage', 'restored_clean', f'{RESTORED_SEED} + 10 * transition_code + stage', REPS)}) GROUP BY 1, 2) c USING (transition_code, stage)""",
)
def _(x):
    """Bootstrap interval of the equal-source restoration rate per outcome and stage."""
    rows = I.restoration_contrasts(x.patches(x.scored))
    seed = F.lit(RESTORED_SEED) + 10 * F.col("transition_code") + F.col("stage")
    return rounded(I.bootstrap_mean_ci(rows, "restored_clean", REPS, seed, ["transition_code", "stage"]))


# ---------------------------------------------------------------- multiple testing

X.define(
    "bin_tests", ("moves",),
    f"""SELECT 'label ' || CAST(label AS VARCHAR) AS family, feature AS test, CASE WHEN feature = {W - 1} THEN NULL ELSE
      (1 + count(*) FILTER (transition_code <> 0)) / (1 + count(*)) END AS p_value FROM moves GROUP BY label, feature""",
)


def bin_tests(x):
    """A table of pseudo p-values per (label, feature); the last feature has none."""
    changed = F.count_if(F.col("transition_code") != 0)
    rows = x.moves.groupBy("label", F.col("feature").alias("test")).agg(((1 + changed) / (1 + F.count(F.lit(1)))).alias("p"))
    return rows.select(
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("family"), "test",
        F.when(F.col("test") != W - 1, F.col("p")).alias("p_value"),
    )


@query(
    "bh_adjust", ("bin_tests",),
    f"""SELECT family, test, round(p_value, 9) AS p_value, round(CASE WHEN p_value IS NOT NULL THEN {BH_SQL} END, 9) AS q_value FROM (
      SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value NULLS LAST, test) AS rank, count(p_value) OVER (PARTITION BY family) AS m FROM bin_tests)""",
)
def _(x):
    return rounded(I.bh_adjust(bin_tests(x), "family", "p_value", "test"))


@query(
    "holm_adjust", ("bin_tests",),
    """SELECT family, test, round(p_value, 9) AS p_value, round(least(1e0, max(p_value * (m - rank + 1)) OVER (PARTITION BY family ORDER BY rank ROWS UNBOUNDED PRECEDING)), 9) AS holm_p FROM (
      SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value, test) AS rank, count(*) OVER (PARTITION BY family) AS m FROM bin_tests WHERE p_value IS NOT NULL)""",
)
def _(x):
    return rounded(I.holm_adjust(bin_tests(x).where("p_value IS NOT NULL"), "family", "p_value", "test"))
