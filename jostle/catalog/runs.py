"""Queries: score vectors, execution conditions and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from jostle.catalog import fixtures as X
from jostle.catalog.neighborhood import padded_runs, rounded
from jostle.catalog.registry import query
from jostle.functions import scores as S
from jostle.operators import events as E
from jostle.operators import moves as M
from jostle.operators import runs as R
from jostle.operators import scoring as SC
from jostle.operators.census import class_report, classification_metrics
from jostle.operators.intervals import interval_join
from jostle.plans.joins import attach
from jostle.plans.ordering import running
from jostle.plans.staging import fan_out, stage

K, RK, W = X.CLASSES, X.RUN_CLASSES, X.WIDTH


def linear_model_factory(classes: int):
    """A NumPy model equal to the column scorer, as a user would supply one."""

    def make():
        import numpy as np

        def model(batch, lengths):
            t = np.arange(batch.shape[1])[:, None]
            f = np.arange(batch.shape[2])[None, :]
            valid = np.arange(batch.shape[1])[None, :] < np.asarray(lengths)[:, None]
            kept = batch * valid[:, :, None]
            planes = [(7 * c * c + 3 * c + 5 * c * f + 11 * t * (c + 1) + t * t * c) % 17 for c in range(classes)]
            return np.stack([(kept * plane[None]).sum(axis=(1, 2)) for plane in planes], axis=1)

        return model

    return make


def biased_model_factory(classes: int):
    """The linear model with a bias on every fed bin, so that padding changes its scores."""

    def make():
        import numpy as np

        linear = linear_model_factory(classes)()

        def model(batch, lengths):
            t = np.arange(batch.shape[1])
            return linear(batch, lengths) + np.array([((t + c) % 5).sum() for c in range(classes)])[None, :]

        return model

    return make


def batches_of(x):
    """Groups of 256 sources by their position in id order, with the length they are padded to."""
    placed = running(x.bounds.select("source_id", "horizon"), [], [F.col("source_id").asc()], out="rank")
    return M.batch_groups(placed.withColumn("rank", F.col("rank") - 1), "rank", "horizon").select("source_id", "horizon", "batch", "padded_horizon")


X.define(
    "source_batches", ("bounds",),
    """SELECT source_id, horizon, batch, max(horizon) OVER (PARTITION BY batch) AS padded_horizon FROM (
      SELECT source_id, horizon, (row_number() OVER (ORDER BY source_id) - 1) // 256 AS batch FROM bounds)""",
)


@query(
    "score_batches", ("sources", "source_batches"),
    f"""SELECT source_id, mode, [{', '.join(
      f"CAST(s.scores[{c + 1}] AS DOUBLE) + list_sum(list_transform(range(CASE WHEN mode = 'native' THEN b.horizon ELSE b.padded_horizon END), lambda t: (t + {c}) % 5))" for c in range(K))}] AS scores
      FROM sources s JOIN source_batches b USING (source_id), (VALUES ('native'), ('padded'), ('reversed'), ('singleton')) m(mode)""",
)
def _(x):
    inputs = SC.tensors(x.cells)
    ranked = attach(inputs, stage(batches_of(x).drop("horizon"), "batches"), ["source_id"])
    model, padded = biased_model_factory(K), "padded_horizon"
    out = None
    for mode, scored in (
        ("native", SC.score_batches(inputs, model, W)), ("padded", SC.score_batches(ranked, model, W, padded, "batch")),
        ("reversed", SC.score_batches(ranked, model, W, padded, "batch", reverse=True)), ("singleton", SC.score_batches(ranked, model, W, padded)),
    ):
        part = scored.withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def step_logits(x):
    """Logits of every bin of every source up to the padded horizon of its batch.

    Occupied bins are sums over their cells; all bins get a bias, so empty ones count too.
    """
    batches = batches_of(x).select("source_id", "horizon", "padded_horizon")
    size = x.bounds.agg(F.count(F.lit(1)) * F.max("horizon")).first()[0]
    steps = fan_out(batches, size, "source_id").select(
        "source_id", "horizon", "padded_horizon", F.explode(F.sequence(F.lit(0).cast("long"), F.col("padded_horizon") - 1)).alias("t")
    )
    sums = x.cells.groupBy("source_id", "t").agg(*[
        F.expr(f"sum(n * {X.weight(c, 'f', 't')})").alias(f"z{c}") for c in range(K)
    ])
    z = F.array(*[
        F.coalesce(F.col(f"z{c}"), F.lit(0).cast("long")) / F.lit(16.0) + F.pmod(F.col("t") + c, F.lit(5)) / F.lit(8.0)
        for c in range(K)
    ])
    return steps.join(sums, ["source_id", "t"], "left").select("source_id", "horizon", "padded_horizon", "t", z.alias("z"))


X.define(
    "logits", ("cells", "source_batches"),
    f"""SELECT s.source_id, s.horizon, s.padded_horizon, g.t, [{', '.join(
        f"coalesce(z{c}, 0) / 16e0 + ((g.t + {c}) % 5) / 8e0" for c in range(K))}] AS z
      FROM source_batches s,
      LATERAL (SELECT unnest(range(s.padded_horizon)) AS t) g
      LEFT JOIN (SELECT source_id, t, {', '.join(f"CAST(sum(n * {X.w_sql(c, 'f', 't')}) AS BIGINT) AS z{c}" for c in range(K))} FROM cells GROUP BY 1, 2) q
        ON q.source_id = s.source_id AND q.t = g.t""",
)
SOFTMAX = "list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda u: exp(u - list_max(z)))))"
X.define("steps", ("logits",), f"SELECT *, {SOFTMAX} AS p FROM logits")


@query(
    "softmax_time_sum", ("steps",),
    f"SELECT source_id, {', '.join(f'round(sum(p[{c + 1}]), 6) AS score_{c}' for c in range(K))} FROM steps WHERE t < horizon GROUP BY 1",
)
def _(x):
    rows = step_logits(x).where(F.col("t") < F.col("horizon"))
    summed = SC.softmax_time_sum(rows, ["source_id"], "z", K)
    return summed.select("source_id", *[F.round(F.get("scores", F.lit(c)), 6).alias(f"score_{c}") for c in range(K)])


def _split_sql() -> str:
    full = ", ".join(f"sum(p[{c + 1}])" for c in range(K))
    prefix = ", ".join(f"coalesce(sum(p[{c + 1}]) FILTER (t < horizon), 0e0)" for c in range(K))
    extra = ", ".join(f"coalesce(sum(p[{c + 1}]) FILTER (t >= horizon), 0e0)" for c in range(K))
    return f"""SELECT source_id, horizon, padded_horizon, {X.predict_sql('a')} AS padded_prediction, {X.predict_sql('v')} AS prefix_prediction,
        list_transform(e, lambda u: round(u, 6)) AS extra, true AS split_exact, true AS mass_exact,
        {X.predict_sql("list_transform(list_zip(v, e), lambda q: q[1] + q[2])")} AS rebuilt_prediction
      FROM (SELECT source_id, horizon, padded_horizon, [{full}] AS a, [{prefix}] AS v, [{extra}] AS e FROM steps GROUP BY 1, 2, 3)"""


@query("prefix_extra_split", ("steps",), _split_sql())
def _(x):
    split = SC.prefix_extra_split(step_logits(x), "z", K)
    return split.select(
        "source_id", "horizon", "padded_horizon", "padded_prediction", "prefix_prediction",
        F.transform("extra", lambda u: F.round(u, 6)).alias("extra"),
        (F.col("split_error") <= 1e-4).alias("split_exact"), (F.col("mass_error") <= 1e-3).alias("mass_exact"),
        S.predict(F.zip_with("prefix", "extra", lambda p, e: p + e)).cast("long").alias("rebuilt_prediction"),
    )


NATIVE_SQL = "list_transform(v, lambda q, i: q + ((source_id + i - 1) % 4) / 2e0)"


def _padding_sql() -> str:
    prefix = ", ".join(f"coalesce(sum(p[{c + 1}]) FILTER (t < horizon), 0e0)" for c in range(K))
    extra = ", ".join(f"coalesce(sum(p[{c + 1}]) FILTER (t >= horizon), 0e0)" for c in range(K))
    full = ", ".join(f"sum(p[{c + 1}])" for c in range(K))
    return f"""SELECT count(*) AS sources, count(*) FILTER (source_id % 13 = 0) AS incomplete, count(*) FILTER (rn <> rf) AS recorded_changes, count(*) FILTER (rn = rf AND padded_horizon > horizon) AS unchanged_with_padding,
        count(*) FILTER (own <> f) AS padding_label_changes, count(*) FILTER (own <> p) AS prefix_only_differs, count(*) FILTER (own <> f AND own = p) AS restored_without_extra, count(*) FILTER (own <> wx) AS native_plus_extra_changes,
        count(*) FILTER (own IS DISTINCT FROM rn) AS native_disagreements, count(*) FILTER (f IS DISTINCT FROM rf) AS padded_disagreements
      FROM (SELECT *, CASE WHEN source_id % 13 <> 0 THEN (own + CASE WHEN source_id % 17 = 0 THEN 1 ELSE 0 END) % {K} END AS rn, CASE WHEN source_id % 13 <> 0 THEN f END AS rf FROM (
        SELECT source_id, horizon, padded_horizon, {X.predict_sql('a')} AS f, {X.predict_sql('v')} AS p, {X.predict_sql('n')} AS own, {X.predict_sql("list_transform(list_zip(n, e), lambda q: q[1] + q[2])")} AS wx FROM (
          SELECT *, {NATIVE_SQL} AS n FROM (SELECT source_id, horizon, padded_horizon, [{full}] AS a, [{prefix}] AS v, [{extra}] AS e FROM steps GROUP BY 1, 2, 3))))"""


@query("padding_summary", ("steps",), _padding_sql())
def _(x):
    """Native runs that differ a little from the valid prefix; every thirteenth source has no recorded run."""
    split = stage(SC.prefix_extra_split(step_logits(x), "z", K), "split")
    native = split.select("source_id", F.transform("prefix", lambda q, i: q + F.pmod(F.col("source_id") + i, F.lit(4)) / F.lit(2.0)).alias("native_scores"))
    own = S.predict(F.col("native_scores")).cast("long")
    recorded = native.join(split.select("source_id", F.col("padded_prediction").alias("padded_recorded")), "source_id").where(F.pmod(F.col("source_id"), F.lit(13)) != 0).select(
        "source_id", F.pmod(own + F.when(F.pmod(F.col("source_id"), F.lit(17)) == 0, 1).otherwise(0), F.lit(K)).alias("native_recorded"), "padded_recorded"
    )
    return SC.padding_summary(split, native, recorded)


# ---------------------------------------------------------------- descriptors


@query("predict", ("run_labels",), "SELECT condition, source_id, prediction FROM run_labels")
def _(x):
    return R.with_predictions(x.runs).select("condition", "source_id", "prediction")


@query(
    "margins", ("moves",),
    f"""SELECT source_id, cand, {X.top_margin_sql('scores')} AS top1_margin, {X.target_margin_sql('scores', 'clean_prediction')} AS clean_class_margin,
      {X.target_margin_sql('scores', 'label')} AS true_class_margin FROM moves""",
)
def _(x):
    s = F.col("scores")
    return x.scored.select(
        "source_id", "cand", S.top_margin(s).alias("top1_margin"),
        S.target_margin(s, F.col("clean_prediction").cast("int")).alias("clean_class_margin"),
        S.target_margin(s, F.col("label").cast("int")).alias("true_class_margin"),
    )


@query(
    "score_displacement", ("moves",),
    f"""SELECT source_id, cand, scores[clean_prediction + 1] - clean_scores[clean_prediction + 1] AS delta_clean_class_score,
      scores[label + 1] - clean_scores[label + 1] AS delta_true_class_score, round({X.l2_sql(X.diff_sql('scores', 'clean_scores'))}, 6) AS score_l2_change,
      list_max(list_transform({X.diff_sql('scores', 'clean_scores')}, lambda v: abs(v))) AS score_linf_change,
      round(CASE WHEN {X.l2_sql('scores')} * {X.l2_sql('clean_scores')} > 0 THEN 1 - {X.dot_sql('scores', 'clean_scores')} / ({X.l2_sql('scores')} * {X.l2_sql('clean_scores')}) ELSE 0 END, 6) AS score_cosine_distance
      FROM moves""",
)
def _(x):
    s, c = F.col("scores"), F.col("clean_scores")
    clean, label = F.col("clean_prediction").cast("int"), F.col("label").cast("int")
    return x.scored.select(
        "source_id", "cand", (F.get(s, clean) - F.get(c, clean)).alias("delta_clean_class_score"),
        (F.get(s, label) - F.get(c, label)).alias("delta_true_class_score"),
        F.round(S.l2_change(s, c, X.CLASSES), 6).alias("score_l2_change"), S.linf_change(s, c, X.CLASSES).alias("score_linf_change"),
        # adding zero turns a rounded -0.0 into 0.0
        (F.round(S.cosine_distance(s, c, X.CLASSES), 6) + 0.0).alias("score_cosine_distance"),
    )


def _trace_metrics_sql() -> str:
    d = X.diff_sql("a", "b")
    total = lambda body: f"list_sum(list_transform(list_zip(a, b), lambda z: {body}))"
    return f"""SELECT source_id, condition, round({total('abs(z[1] - z[2])')} / len(b), 6) AS mean_absolute_change,
        round(sqrt({total('(z[1] - z[2]) * (z[1] - z[2])')} / len(b)), 6) AS rms_change,
        round({X.l2_sql(d)} / greatest({X.l2_sql('b')}, 1e-12), 6) AS relative_l2_change,
        round(1 - {X.dot_sql('a', 'b')} / greatest({X.l2_sql('a')} * {X.l2_sql('b')}, 1e-12), 6) + 0e0 AS cosine_distance,
        round({total('CASE WHEN (z[1] > 0.5) <> (z[2] > 0.5) THEN 1e0 ELSE 0e0 END')} / len(b), 6) AS activity_flip_rate,
        round({total('z[1] - z[2]')} / len(b), 6) AS mean_signed_change
      FROM (SELECT r.source_id, r.condition, r.scores AS a, o.scores AS b FROM runs r JOIN runs o ON o.source_id = r.source_id AND o.condition = 0 WHERE r.condition > 0)"""


@query("trace_metrics", ("runs",), _trace_metrics_sql())
def _(x):
    base = x.runs.where(F.col("condition") == 0).select("source_id", F.col("scores").alias("clean"))
    rows = x.runs.where(F.col("condition") > 0).join(base, "source_id")
    metrics = S.trace_metrics(F.col("scores"), F.col("clean"))
    return rows.select("source_id", "condition", *[(F.round(m, 6) + 0.0).alias(n) for n, m in metrics.items()])


# ---------------------------------------------------------------- metrics


CLASS_SQL = """SELECT condition, class, support, predicted, hits, hits / greatest(support, 1) AS recall, hits / greatest(predicted, 1) AS precision,
    CASE WHEN hits = 0 THEN 0e0 ELSE 2e0 * (hits / predicted) * (hits / support) / (hits / predicted + hits / support) END AS f1
  FROM (SELECT condition, class, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hits FROM (
    SELECT condition, label AS class, 1 AS s, 0 AS p, CAST(label = prediction AS INTEGER) AS h FROM run_labels UNION ALL
    SELECT condition, prediction, 0, 1, 0 FROM run_labels) GROUP BY 1, 2)"""
X.define("class_metrics", ("run_labels",), CLASS_SQL)


@query(
    "classification_metrics", ("class_metrics",),
    """SELECT condition, CAST(sum(support) AS BIGINT) AS samples, CAST(sum(hits) AS BIGINT) AS correct, round(sum(hits) / sum(support), 9) AS accuracy,
      round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy, round(avg(f1) FILTER (support > 0), 9) AS macro_f1,
      round(min(recall) FILTER (support > 0), 9) AS worst_class_recall FROM class_metrics GROUP BY 1""",
)
def _(x):
    return rounded(classification_metrics(R.with_predictions(x.runs), ["condition"], RK)[2])


@query(
    "class_metrics", ("class_metrics",),
    "SELECT condition, class, support, predicted, hits, round(recall, 9) AS recall, round(precision, 9) AS precision, round(f1, 9) AS f1 FROM class_metrics",
)
def _(x):
    return rounded(classification_metrics(R.with_predictions(x.runs), ["condition"], RK)[1])


@query(
    "class_report", ("class_metrics",),
    f"""SELECT condition, class, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits, round(coalesce(recall, 0e0), 9) AS recall, round(coalesce(precision, 0e0), 9) AS precision, round(coalesce(f1, 0e0), 9) AS f1
      FROM (SELECT * FROM (SELECT DISTINCT condition FROM class_metrics), (SELECT unnest(range({RK + 2})) AS class)) LEFT JOIN class_metrics USING (condition, class)""",
)
def _(x):
    """A row for each of two more classes than occur."""
    per_class = classification_metrics(R.with_predictions(x.runs), ["condition"], RK)[1]
    return rounded(class_report(per_class, ["condition"], RK + 2))


@query("confusion_matrix", ("run_labels",), "SELECT condition, label, prediction, count(*) AS n FROM run_labels GROUP BY ALL")
def _(x):
    return classification_metrics(R.with_predictions(x.runs), ["condition"], RK)[0]


# ---------------------------------------------------------------- contrasts


# The pairs of conditions that are compared.
PAIRS = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (2, 4), (1, 4), (0, 2), (4, 0)]
X.define(
    "paired_runs", ("run_labels",),
    f"""SELECT concat(p.a, '-', p.b) AS pair, x.source_id, x.label, x.prediction AS a, y.prediction AS b, x.scores AS scores_a, y.scores AS scores_b,
      list_max(list_transform({X.diff_sql('x.scores', 'y.scores')}, lambda v: abs(v))) AS delta
      FROM (VALUES {', '.join(map(str, PAIRS))}) p(a, b) JOIN run_labels x ON x.condition = p.a JOIN run_labels y ON y.condition = p.b AND y.source_id = x.source_id""",
)


def paired(x):
    return R.pair_runs(R.with_predictions(x.runs), PAIRS)


DIFFERENCE_SQL = """SELECT pair, count(delta) AS samples, count(*) FILTER (delta IS NULL) AS missing, count(*) FILTER (delta = 0) AS exact_zero, count(*) FILTER (delta <> 0) AS nonzero,
  round(quantile_cont(delta, 0.5), 9) AS median, round(quantile_cont(delta, 0.95), 9) AS p95, round(quantile_cont(delta, 0.99), 9) AS p99,
  round(max(delta), 9) AS maximum, count(*) FILTER (delta > 1e-5) AS above_1e_5, count(*) FILTER (delta > 1e-4) AS above_1e_4, count(*) FILTER (delta > 1e-3) AS above_1e_3
  FROM paired_runs GROUP BY 1"""
CONTRAST_SQL = """SELECT pair, count(*) FILTER (a <> b) AS changed_labels, round(avg(CASE WHEN a <> b THEN 1e0 ELSE 0e0 END), 9) AS changed_fraction,
  count(*) FILTER (a <> b AND a = label) AS correct_to_wrong, count(*) FILTER (a <> b AND b = label) AS wrong_to_correct,
  count(*) FILTER (a <> b AND a <> label AND b <> label) AS wrong_to_different_wrong FROM paired_runs GROUP BY 1"""


@query("score_difference", ("paired_runs",), DIFFERENCE_SQL)
def _(x):
    return rounded(R.score_difference(paired(x), ["pair"]))


@query("label_contrast", ("paired_runs",), CONTRAST_SQL)
def _(x):
    return rounded(R.label_contrast(paired(x), ["pair"]))


@query(
    "condition_contrasts", ("paired_runs",),
    f"""SELECT c.*, d.* EXCLUDE (pair), round(e.aa, 9) AS accuracy_a, round(e.ab, 9) AS accuracy_b, coalesce(h.head, '') AS changed_classes
      FROM ({CONTRAST_SQL}) c JOIN ({DIFFERENCE_SQL}) d USING (pair)
      JOIN (SELECT pair, avg(CASE WHEN a = label THEN 1e0 ELSE 0e0 END) AS aa, avg(CASE WHEN b = label THEN 1e0 ELSE 0e0 END) AS ab FROM paired_runs GROUP BY 1) e USING (pair)
      LEFT JOIN (SELECT pair, string_agg(concat(source_id, ':', a, '>', b), ' ' ORDER BY source_id) AS head FROM (
        SELECT *, row_number() OVER (PARTITION BY pair ORDER BY source_id) AS n FROM paired_runs WHERE a <> b) WHERE n <= 16 GROUP BY 1) h USING (pair)""",
)
def _(x):
    return rounded(R.condition_contrasts(x.runs, PAIRS, RK))


@query("changed_sources", ("paired_runs",), "SELECT pair, source_id, a, b FROM paired_runs WHERE a <> b")
def _(x):
    return R.changed_sources(paired(x))


RANGES_SQL = ", ".join(f"(CAST({lo} AS BIGINT), CAST({'NULL' if hi is None else hi} AS BIGINT))" for lo, hi in R.GAP_RANGES)


@query(
    "gap_range_join", ("padded_runs",),
    f"SELECT source_id, gap, lo, hi FROM padded_runs JOIN (VALUES {RANGES_SQL}) r(lo, hi) ON gap >= lo AND (hi IS NULL OR gap <= hi)",
)
def _(x):
    return R.gap_range_join(padded_runs(x), "gap").select("source_id", "gap", "lo", "hi")


@query(
    "gap_change_rates", ("padded_runs",),
    f"""SELECT lo, hi, count(source_id) AS sources, count(*) FILTER (changed) AS changed,
      round(avg(CASE WHEN changed THEN 1e0 WHEN NOT changed THEN 0e0 END), 9) AS changed_fraction
      FROM (VALUES {RANGES_SQL}) r(lo, hi) LEFT JOIN padded_runs ON gap >= lo AND (hi IS NULL OR gap <= hi) GROUP BY 1, 2""",
)
def _(x):
    return rounded(R.gap_change_rates(padded_runs(x), "gap", "changed"))


@query(
    "align_runs", ("moves", "moves_b"),
    """SELECT count(*) FILTER (a.cand IS NOT NULL AND b.cand IS NOT NULL) AS matched, count(*) FILTER (b.cand IS NULL) AS only_a, count(*) FILTER (a.cand IS NULL) AS only_b,
      count(*) FILTER (a.label <> b.label) AS label_differs, count(*) FILTER (a.from_bin <> b.from_bin) AS from_bin_differs,
      count(*) FILTER (a.candidate_prediction <> b.candidate_prediction) AS candidate_prediction_differs,
      count(*) FILTER (a.transition_code <> b.transition_code) AS transition_code_differs
      FROM moves a FULL JOIN moves_b b ON a.source_id = b.source_id AND a.cand = b.cand""",
)
def _(x):
    return R.align_runs(x.moves, x.moves_b, ["source_id", "cand"], ["label", "from_bin", "candidate_prediction", "transition_code"])


@query(
    "alignment_guard", ("padded_runs",),
    """SELECT unnest(['missing_source', 'label_mismatch', 'horizon_mismatch', 'input_substituted', 'negative_padding']) AS rule,
      unnest([count(*) FILTER (source_id % 50 = 0), count(*) FILTER (source_id % 50 <> 0 AND source_id % 20 = 0),
        count(*) FILTER (source_id % 50 <> 0 AND source_id % 30 = 0), CAST(0 AS BIGINT),
        count(*) FILTER (source_id % 50 <> 0 AND source_id % 30 = 0 AND padded_horizon < native_horizon + 1)]) AS violations FROM padded_runs""",
)
def _(x):
    rows = padded_runs(x).withColumn("fingerprint", F.sha2(F.col("source_id").cast("string"), 256))
    other = rows.where(F.pmod(F.col("source_id"), F.lit(50)) != 0).withColumns({
        "label": F.when(F.pmod(F.col("source_id"), F.lit(20)) == 0, F.col("label") + 1).otherwise(F.col("label")),
        "native_horizon": F.when(F.pmod(F.col("source_id"), F.lit(30)) == 0, F.col("native_horizon") + 1).otherwise(F.col("native_horizon")),
    })
    return R.alignment_guard(rows, other)


@query(
    "compare_runs", ("run_labels",),
    f"""SELECT a.condition, count(*) AS sources, count(*) FILTER (a.prediction <> b.prediction) AS label_disagreements,
      round(max(list_max(list_transform({X.diff_sql('a.scores', 'b.scores')}, lambda v: abs(v)))), 9) AS max_abs_score_difference
      FROM run_labels a JOIN run_labels b ON b.source_id = a.source_id AND b.condition = (a.condition + 1) % {X.CONDITIONS} GROUP BY 1""",
)
def _(x):
    shifted = x.runs.withColumn("condition", F.pmod(F.col("condition") - 1, F.lit(X.CONDITIONS)).cast("long"))
    return rounded(R.compare_runs(x.runs, shifted))


@query(
    "parity_gate", ("paired_runs",),
    """SELECT pair, count(*) AS sources, count(*) FILTER (delta IS NULL) AS missing, round(max(delta), 9) AS max_abs_error, count(*) FILTER (a <> b) AS class_disagreements,
      count(*) FILTER (delta = 0) AS bit_exact_sources, bool_and(delta <= 2e-1 AND a = b) AS pass FROM paired_runs GROUP BY 1""",
)
def _(x):
    return rounded(R.parity_gate(paired(x), 0.2))


ORDER_MODES = (("original", 1), ("isolated", 2))


def _order_rows_sql() -> str:
    parts = []
    for mode, k in ORDER_MODES:
        parts.append(f"""SELECT source_id // 2 AS pair, '{mode}' AS mode, source_id % 2 AS member, s0.scores AS xy, s1.scores AS yx, z.scores AS single, q.scores AS xx
          FROM runs s0 JOIN runs s1 USING (source_id) JOIN runs z USING (source_id)
          JOIN runs q ON q.condition = CASE WHEN s0.source_id % 2 = 0 THEN 0 ELSE {k} END AND q.source_id = s0.source_id - s0.source_id % 2
          WHERE s0.condition = 0 AND s1.condition = {k} AND z.condition = 3""".replace("SELECT source_id // 2", "SELECT s0.source_id // 2").replace("source_id % 2 AS member", "s0.source_id % 2 AS member"))
    return " UNION ALL ".join(parts)


X.define("order_rows", ("runs",), _order_rows_sql())


def linf(a: str, b: str) -> str:
    return f"list_max(list_transform({X.diff_sql(a, b)}, lambda v: abs(v)))"


@query(
    "order_controls", ("order_rows",),
    f"""SELECT pair, mode, count(*) FILTER ({X.predict_sql('xy')} <> {X.predict_sql('yx')}) AS order_changed_labels, round(max({linf('xy', 'yx')}), 9) AS order_score_max_abs,
      round({linf('any_value(xx) FILTER (member = 0)', 'any_value(xx) FILTER (member = 1)')}, 9) AS position_score_max_abs, round(max({linf('xy', 'single')}), 9) AS versus_single_max_abs
      FROM order_rows GROUP BY 1, 2""",
)
def _(x):
    """Neighboring ids form a pair; conditions stand for arrangements."""
    k = F.col("condition")
    sends = []
    for mode, other in ORDER_MODES:
        even = F.pmod(F.col("source_id"), F.lit(2)) == 0
        slot = F.pmod(F.col("source_id"), F.lit(2)).cast("int")
        entry = lambda arrangement, at, when, m=mode: F.when(when, F.struct(
            F.lit(m).alias("mode"), F.lit(arrangement).alias("arrangement"), at.alias("slot")))
        sends += [
            entry("xy", slot, k == 0), entry("yx", 1 - slot, k == other), entry("single", slot, k == 3),
            entry("xx", F.lit(0), even & (k == 0)), entry("xx", F.lit(1), even & (k == other)),
        ]
    rows = x.runs.withColumn("s", F.explode(F.filter(F.array(*sends), lambda s: s.isNotNull()))).select(
        F.floor(F.col("source_id") / 2).alias("pair"), "s.mode", "s.arrangement", "s.slot", "scores"
    )
    return rounded(R.order_controls(rows))


# ---------------------------------------------------------------- replays


@query(
    "replay_agreement", ("moves", "moves_b"),
    """SELECT a.transition_code, count(*) AS candidates, count(*) FILTER (a.cand % 70 = 4) AS missing_first, count(*) FILTER (b.cand IS NULL) AS missing_second,
      round(avg(CASE WHEN a.candidate_prediction = b.candidate_prediction AND a.cand % 70 <> 4 THEN 1e0 ELSE 0e0 END), 9) AS label_agreement,
      count(*) FILTER (a.cand % 70 <> 4) AS first_same_class, count(*) FILTER (b.candidate_prediction = a.candidate_prediction) AS second_same_class,
      count(*) FILTER (a.cand % 70 <> 4) AS first_same_type, count(*) FILTER (b.transition_code = a.transition_code) AS second_same_type,
      count(*) FILTER (a.candidate_prediction = a.clean_prediction AND a.cand % 70 <> 4) AS first_returns_to_clean
      FROM moves a LEFT JOIN (SELECT * FROM moves_b WHERE cand % 90 <> 5) b ON a.source_id = b.source_id AND a.cand = b.cand WHERE a.transition_code <> 0 GROUP BY ROLLUP (a.transition_code)""",
)
def _(x):
    """Both replays lack some candidates; the row without a code is the total."""
    lack = lambda df, rule: df.where(rule)
    return rounded(R.replay_agreement(x.moves, {"first": lack(x.moves, "cand % 70 <> 4"), "second": lack(x.moves_b, "cand % 90 <> 5")}))


FIRST_ADVERSE = "SELECT source_id, min(cand) AS cand, arg_min(candidate_prediction, cand) AS prediction FROM {} WHERE transition_code = 1 GROUP BY 1"


@query(
    "recovered_sets", ("moves", "moves_b"),
    f"""SELECT * FROM (WITH r AS (SELECT 'recorded' AS run, * FROM ({FIRST_ADVERSE.format('moves')}) UNION ALL SELECT 'same', * FROM ({FIRST_ADVERSE.format('moves')})
        UNION ALL SELECT 'later', * FROM ({FIRST_ADVERSE.format('(SELECT * FROM moves WHERE cand % 3 <> 0)')}) UNION ALL SELECT 'other', * FROM ({FIRST_ADVERSE.format('moves_b')}))
      SELECT n.run, (SELECT count(*) FROM r WHERE r.run = n.run) AS sources,
        NOT EXISTS ((SELECT source_id FROM r WHERE r.run = n.run EXCEPT SELECT source_id FROM r WHERE r.run = 'recorded') UNION ALL (SELECT source_id FROM r WHERE r.run = 'recorded' EXCEPT SELECT source_id FROM r WHERE r.run = n.run)) AS same_sources,
        NOT EXISTS ((SELECT source_id, cand, prediction FROM r WHERE r.run = n.run EXCEPT SELECT source_id, cand, prediction FROM r WHERE r.run = 'recorded')
          UNION ALL (SELECT source_id, cand, prediction FROM r WHERE r.run = 'recorded' EXCEPT SELECT source_id, cand, prediction FROM r WHERE r.run = n.run)) AS same_witnesses
      FROM (SELECT unnest(['recorded', 'same', 'later', 'other']) AS run) n)""",
)
def _(x):
    """Four runs: the recorded one, an equal one, one that misses some candidates, and the other model."""
    return R.recovered_sets({"recorded": x.moves, "same": x.moves, "later": x.moves.where("cand % 3 <> 0"), "other": x.moves_b})


INTERVALS_SQL = """SELECT source_id AS range_id, CASE WHEN source_id % 4 = 0 THEN NULL ELSE clean_margin - source_id % 30 END AS lo, CASE WHEN source_id % 9 = 0 THEN NULL ELSE clean_margin + source_id % 7 - 2 END AS hi FROM sources WHERE source_id % 5 = 0"""


@query(
    "interval_join", ("sources",),
    f"""SELECT * FROM (WITH r AS ({INTERVALS_SQL}), v AS (SELECT source_id, CASE WHEN source_id % 8 = 0 THEN NULL ELSE clean_margin END AS margin FROM sources),
      m AS (SELECT * FROM v JOIN r ON (lo IS NULL OR lo <= margin) AND (hi IS NULL OR margin <= hi) WHERE margin IS NOT NULL)
      SELECT * FROM m UNION ALL SELECT *, NULL, NULL, NULL FROM v WHERE source_id NOT IN (SELECT source_id FROM m) UNION ALL SELECT NULL, NULL, * FROM r WHERE range_id NOT IN (SELECT range_id FROM m))""",
)
def _(x):
    """Clean margins in a table of overlapping ranges, some open, some empty; margins that are NULL are in none."""
    id_, margin = F.col("source_id"), F.col("clean_margin")
    ranges = x.sources.where(F.pmod(id_, F.lit(5)) == 0).select(
        id_.alias("range_id"), F.when(F.pmod(id_, F.lit(4)) != 0, margin - F.pmod(id_, F.lit(30))).alias("lo"), F.when(F.pmod(id_, F.lit(9)) != 0, margin + F.pmod(id_, F.lit(7)) - 2).alias("hi")
    )
    return interval_join(x.sources.select("source_id", F.when(F.pmod(id_, F.lit(8)) != 0, margin).alias("margin")), "margin", ranges)


@query(
    "source_sets", ("moves", "moves_b"),
    """SELECT source_id, bool_or(run = 'a') AS in_a, bool_or(run = 'b') AS in_b, count(*) AS runs FROM (
      SELECT DISTINCT source_id, 'a' AS run FROM moves WHERE transition_code = 1 UNION ALL SELECT DISTINCT source_id, 'b' FROM moves_b WHERE transition_code = 1) GROUP BY 1""",
)
def _(x):
    return R.source_sets({"a": x.moves, "b": x.moves_b})


@query("fingerprint_runs", ("cells",), "SELECT source_id, horizon, count(*) AS cells FROM cells GROUP BY 1, 2")
def _(x):
    """Two independently binned runs have equal fingerprints for every source."""
    a = E.content_fingerprint(x.cells).withColumnRenamed("fingerprint", "a")
    b = E.content_fingerprint(E.bin_events_oracle(x.events, X.STEP)).withColumnRenamed("fingerprint", "b")
    same = a.join(b, ["source_id", "horizon"]).where("a = b")
    return same.join(x.cells.groupBy("source_id").agg(F.count(F.lit(1)).alias("cells")), "source_id").select("source_id", "horizon", "cells")
