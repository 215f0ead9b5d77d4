"""Queries: binning, enumeration, outcomes, source summaries (N, P, J1-J2, A1-A7, A19, S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jostle.catalog import fixtures as X
from jostle.catalog.registry import query
from jostle.functions import outcomes as O
from jostle.functions import scores as S
from jostle.operators import census as C
from jostle.operators import events as E
from jostle.operators import moves as M
from jostle.plans.joins import attach
from jostle.plans.ordering import running
from jostle.plans.staging import stage

D, W, K = X.STEP, X.WIDTH, X.CLASSES


# ---------------------------------------------------------------- events


@query("bin_events", ("cells",), "SELECT source_id, horizon, t, f, n FROM cells")
def _(x):
    return E.bin_events(x.events, x.bounds, D)


@query("bin_events_oracle", ("cells",), "SELECT source_id, horizon, t, f, n FROM cells")
def _(x):
    return E.bin_events_oracle(x.events, D)


USER_STEP = 6 * 3_600_000_000
EVENT_TYPES = ["click", "error", "login", "purchase", "view"]


@query(
    "bin_user_events", (),
    f"""WITH ev AS (SELECT user_id AS source_id, epoch_us(ts) AS us, event_type,
          dense_rank() OVER (ORDER BY event_type) - 1 AS unit FROM events),
      b AS (SELECT source_id, min(us) AS a, greatest(1, (max(us) - min(us) + {USER_STEP} - 1) // {USER_STEP}) AS horizon FROM ev GROUP BY 1)
      SELECT source_id, horizon, least((us - a) // {USER_STEP}, horizon - 1) AS t, unit AS f, count(*) AS n
      FROM ev JOIN b USING (source_id) GROUP BY ALL""",
)
def _(x):
    rows = x.table("events")
    # Five event types in the data model: the dictionary is tiny and derived from the table.
    kinds = rows.select("event_type").distinct()
    order = running(kinds, [], [F.col("event_type").asc()], out="place").select(
        "event_type", (F.col("place") - 1).alias("unit")
    )
    events = attach(rows, order, ["event_type"]).select(
        F.col("user_id").alias("source_id"), E.micros(F.col("ts")).alias("us"), "unit"
    )
    bounds = stage(E.event_bounds(events, USER_STEP), "bounds")
    return E.bin_events(events, bounds, USER_STEP)


@query(
    "densify", ("cells",),
    f"""SELECT b.source_id, b.horizon, g.t, f.f, coalesce(c.n, 0) AS n
      FROM (SELECT DISTINCT source_id, horizon FROM cells) b, LATERAL (SELECT unnest(range(b.horizon)) AS t) g,
      (SELECT unnest(range({W})) AS f) f LEFT JOIN cells c ON c.source_id = b.source_id AND c.t = g.t AND c.f = f.f""",
)
def _(x):
    return E.densify(x.cells, x.bounds, W)


@query(
    "validate_counts", (),
    """SELECT name, count(*) AS rows, count(*) FILTER (v IS NULL) AS missing, CAST(0 AS BIGINT) AS not_finite,
      count(*) FILTER (v < 0) AS negative, count(*) FILTER (v <> floor(v)) AS not_integral, count(*) FILTER (v > 65535) AS too_large
      FROM (SELECT unnest(['quantity', 'discount', 'price']) AS name, unnest([l_quantity, l_discount, l_extendedprice]) AS v FROM lineitem)
      GROUP BY name""",
)
def _(x):
    columns = F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(column).alias("v"))
        for name, column in (("quantity", "l_quantity"), ("discount", "l_discount"), ("price", "l_extendedprice"))
    ])
    rows = x.table("lineitem").select(F.explode(columns).alias("c")).select("c.name", "c.v")
    return E.validate_counts(rows, "v", ["name"])


@query(
    "validate_events", (),
    """SELECT source_id, count(*) AS events, count(*) FILTER (us IS NULL) AS missing_time,
      count(*) FILTER (unit < 0 OR unit >= 6) AS unit_out_of_range, count(*) FILTER (us < p) AS decreasing
      FROM (SELECT *, lag(us) OVER (PARTITION BY source_id ORDER BY seq, part, us) AS p FROM (
        SELECT l_suppkey AS source_id, epoch_us(l_shipdate) AS us, l_linenumber - 1 AS unit, l_orderkey * 8 + l_linenumber AS seq, l_partkey AS part FROM lineitem))
      GROUP BY source_id""",
)
def _(x):
    # Line numbers repeat within a few orders of the given table: part and time order these events.
    rows = x.table("lineitem").select(
        F.col("l_suppkey").alias("source_id"), E.micros(F.col("l_shipdate")).alias("us"),
        (F.col("l_linenumber") - 1).alias("unit"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("part"),
    )
    return E.validate_events(rows, 6, "seq", ties=("part", "us"))


def _fingerprint_sql() -> str:
    return f"""SELECT source_id, horizon, sha256(concat_ws('|', CAST(horizon AS VARCHAR), string_agg(digest, '|' ORDER BY block))) AS fingerprint
      FROM (SELECT source_id, horizon, t // {E.BLOCK_BINS} AS block,
              sha256(string_agg(concat_ws(',', t, f, n), '|' ORDER BY t, f)) AS digest FROM cells GROUP BY source_id, horizon, t // {E.BLOCK_BINS}) GROUP BY source_id, horizon"""


@query("content_fingerprint", ("cells",), _fingerprint_sql())
def _(x):
    return E.content_fingerprint(x.cells)


# ---------------------------------------------------------------- moves


@query(
    "enumerate_moves", ("plain_moves",),
    "SELECT source_id, cand, from_bin, to_bin, feature, CAST(direction AS INTEGER) AS direction, multiplicity, horizon FROM plain_moves",
)
def _(x):
    return M.enumerate_moves(x.cells)


@query(
    "neighborhood_cardinality", ("plain_moves",),
    """SELECT c.source_id, nonzero, first_bin, last_bin, 2 * nonzero - first_bin - last_bin AS candidates, m.candidates AS enumerated
      FROM (SELECT source_id, count(*) AS nonzero, count(*) FILTER (t = 0) AS first_bin, count(*) FILTER (t = horizon - 1) AS last_bin FROM cells GROUP BY 1) c
      JOIN (SELECT source_id, count(*) AS candidates FROM plain_moves GROUP BY 1) m USING (source_id)""",
)
def _(x):
    counted = M.enumerate_moves(x.cells).groupBy("source_id").agg(F.count(F.lit(1)).alias("enumerated"))
    return M.neighborhood_cardinality(x.cells).join(counted, "source_id")


@query(
    "apply_move", ("moves",),
    """SELECT m.source_id, m.cand, e.t, m.feature AS f, coalesce(c.n, 0) AS before, coalesce(c.n, 0) + e.delta AS after
      FROM moves m, LATERAL (SELECT m.from_bin AS t, CAST(-1 AS BIGINT) AS delta UNION ALL SELECT m.to_bin, CAST(1 AS BIGINT)) e
      LEFT JOIN cells c ON c.source_id = m.source_id AND c.t = e.t AND c.f = m.feature""",
)
def _(x):
    return M.apply_move(x.moves, x.cells)


@query(
    "normalized_coords", ("plain_moves",),
    f"""SELECT source_id, cand, round(from_bin / greatest(1, horizon - 1), 6) AS time_normalized,
      round(feature / {W - 1}, 6) AS feature_normalized FROM plain_moves""",
)
def _(x):
    return M.enumerate_moves(x.cells).select(
        "source_id", "cand",
        F.round(O.time_normalized(F.col("from_bin"), F.col("horizon")), 6).alias("time_normalized"),
        F.round(O.feature_normalized(F.col("feature"), W), 6).alias("feature_normalized"),
    )


def part_sql(column: str, size: str, parts: int) -> str:
    return f"least(({column} * {parts}) // {size}, {parts - 1})"


LAST = "greatest(1, horizon - 1)"


@query(
    "bin_coords", ("plain_moves",),
    f"""SELECT source_id, cand, {part_sql('from_bin', LAST, 3)} AS time_tertile, {part_sql('feature', str(W), 4)} AS feature_quartile,
      {part_sql('from_bin', LAST, 20)} AS time_bin, {part_sql('feature', str(W), 14)} AS feature_bin FROM plain_moves""",
)
def _(x):
    return C.bin_coords(M.enumerate_moves(x.cells), W)


@query(
    "classify_transition", ("moves",),
    "SELECT source_id, cand, label, clean_prediction, candidate_prediction, transition_code FROM moves",
)
def _(x):
    return x.moves.select("source_id", "cand", "label", "clean_prediction", "candidate_prediction", "transition_code")


@query(
    "subset_masks", ("moves",),
    f"""SELECT subset, transition_code, count(*) AS candidates, count(DISTINCT source_id) AS sources FROM (
      SELECT *, unnest(CASE WHEN r > 0 AND transition_code = 0 THEN ['all_neighbors', 'nonzero_internal_response', 'preserved_nonzero_response']
        WHEN r > 0 THEN ['all_neighbors', 'nonzero_internal_response'] ELSE ['all_neighbors'] END) AS subset
      FROM (SELECT *, {X.trace_sql('source_id', 'cand', '6', '2')} AS r FROM moves)) GROUP BY ALL""",
)
def _(x):
    return C.subset_masks(x.final_response(x.moves), "response").groupBy("subset", "transition_code").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_distinct("source_id").alias("sources")
    )


@query("clean_correct_cohort", ("sources",), "SELECT source_id, label, clean_prediction, horizon FROM sources WHERE clean_correct")
def _(x):
    return x.sources.where("clean_correct").select("source_id", "label", "clean_prediction", "horizon")


# ---------------------------------------------------------------- batches, panels


BATCHES = """WITH o AS (SELECT vec_id AS source_id, vec_id % 7 + 64 AS horizon FROM embeddings)
  SELECT source_id, horizon, source_id // 256 AS batch, max(horizon) OVER (PARTITION BY source_id // 256) AS padded_horizon,
    max(horizon) OVER (PARTITION BY source_id // 256) - horizon AS gap FROM o"""


@query("batch_groups", (), BATCHES)
def _(x):
    rows = x.table("embeddings").select(
        F.col("vec_id").alias("source_id"), (F.pmod(F.col("vec_id"), F.lit(7)) + 64).alias("horizon")
    )
    return M.batch_groups(rows, "source_id", "horizon")


PANEL_SEED = 809


@query(
    "select_panel", ("sources",),
    f"""SELECT source_id, label, pick FROM (
      SELECT source_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY {X.rng_sql(PANEL_SEED, 'source_id')}, source_id) AS INTEGER) AS pick FROM sources)
      WHERE pick <= 2 + label % 2""",
)
def _(x):
    labels = x.sources.select("label").distinct()
    quotas = labels.withColumn("quota", F.pmod(F.col("label"), F.lit(2)) + 2)
    return M.select_panel(x.sources, "label", quotas, PANEL_SEED, 3).select("source_id", "label", "pick")


def padded_runs(x):
    """Per source: label, native and padded prediction of the first two conditions, batch and gap."""
    runs = x.runs.where(F.col("condition") <= 1).withColumn("prediction", S.predict(F.col("scores")).cast("long"))
    wide = runs.groupBy("source_id", "label", "native_horizon").agg(
        F.max(F.when(F.col("condition") == 0, F.col("prediction"))).alias("native"),
        F.max(F.when(F.col("condition") == 1, F.col("prediction"))).alias("padded"),
    )
    return M.batch_groups(wide, "source_id", "native_horizon").withColumn("changed", F.col("native") != F.col("padded"))


X.define(
    "padded_runs", ("run_labels", "batches"),
    """SELECT b.*, b.padded_horizon - b.native_horizon AS gap, a.prediction AS native, p.prediction AS padded, a.prediction <> p.prediction AS changed
      FROM batches b JOIN run_labels a ON a.source_id = b.source_id AND a.condition = 0
      JOIN run_labels p ON p.source_id = b.source_id AND p.condition = 1""",
)
CONTROLS_SQL = """SELECT source_id, 'changed' AS role FROM padded_runs WHERE changed UNION
  SELECT e.source_id, 'control' AS role FROM
    (SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS place, count(*) OVER () AS m FROM padded_runs WHERE NOT changed AND gap > 0) e
  WHERE e.place IN (SELECT i * (m - 1) // greatest(1, least(64, m) - 1) FROM
    (SELECT unnest(range(least(64, m))) AS i, m FROM (SELECT count(*) AS m FROM padded_runs WHERE NOT changed AND gap > 0)))"""


@query("select_controls", ("padded_runs",), CONTROLS_SQL)
def _(x):
    return M.select_controls(padded_runs(x), "changed", "gap")


@query("union_distinct", ("padded_runs",), f"SELECT DISTINCT source_id FROM ({CONTROLS_SQL})")
def _(x):
    rows = padded_runs(x)
    chosen = M.select_controls(rows, "changed", "gap")
    return rows.where("changed").select("source_id").union(chosen.select("source_id")).distinct()


PAIRS_SQL = """SELECT f.batch, f.x_source, coalesce(min(r.source_id) FILTER (r.source_id > f.x_source), min(r.source_id)) AS y_source,
    max(r.padded_horizon) AS padded_horizon
  FROM (SELECT batch, min(source_id) AS x_source FROM padded_runs WHERE changed GROUP BY 1 ORDER BY 1 LIMIT 3) f
  JOIN padded_runs r USING (batch) GROUP BY ALL"""


@query("select_pairs", ("padded_runs",), PAIRS_SQL)
def _(x):
    return M.select_pairs(padded_runs(x), "changed", "batch")


# ---------------------------------------------------------------- joins and aggregates


@query(
    "attach_source", ("plain_moves", "sources"),
    "SELECT source_id, cand, label, clean_prediction, s.horizon FROM plain_moves m JOIN sources s USING (source_id)",
)
def _(x):
    lookup = x.sources.select("source_id", "label", "clean_prediction", "horizon")
    return attach(M.enumerate_moves(x.cells).select("source_id", "cand"), lookup, ["source_id"])


X.define(
    "pair_counts", ("moves",),
    """SELECT source_id, count(*) FILTER (p = 0 AND q = 0) AS paired_neither_changed, count(*) FILTER (p = 0 AND q = 1) AS paired_next_only_changed,
      count(*) FILTER (p = 1 AND q = 0) AS paired_previous_only_changed, count(*) FILTER (p = 1 AND q = 1) AS paired_both_changed,
      (count(*) FILTER (p = 1 AND q = 0) - count(*) FILTER (p = 0 AND q = 1)) / greatest(1, count(*) FILTER (p IS NOT NULL)) AS paired_direction_discordance
      FROM (SELECT a.source_id, CASE WHEN b.source_id IS NULL THEN NULL ELSE CAST(a.transition_code <> 0 AS INTEGER) END AS p, CAST(b.transition_code <> 0 AS INTEGER) AS q
        FROM (SELECT * FROM moves WHERE direction = -1) a LEFT JOIN (SELECT * FROM moves WHERE direction = 1) b USING (source_id, from_bin, feature)) GROUP BY 1""",
)


@query(
    "pair_directions", ("pair_counts",),
    "SELECT * REPLACE (round(paired_direction_discordance, 9) AS paired_direction_discordance) FROM pair_counts",
)
def _(x):
    return C.pair_directions(x.paired_moves).withColumn(
        "paired_direction_discordance", F.round("paired_direction_discordance", 9)
    )


def totals_sql() -> str:
    lines = []
    for name, cond in (
        ("class_preserved", "transition_code = 0"), ("adverse", "transition_code = 1"), ("corrective", "transition_code = 2"),
        ("lateral", "transition_code = 3"), ("class_changed", "transition_code <> 0"), ("total", "true"),
    ):
        lines.append(
            f"SELECT '{name}' AS outcome, count(*) FILTER ({cond}) AS unique_n, CAST(coalesce(sum(multiplicity) FILTER ({cond}), 0) AS BIGINT) AS event_weighted_n, "
            f"round(100e0 * count(*) FILTER ({cond}) / count(*), 9) AS unique_percent, "
            f"round(100e0 * coalesce(sum(multiplicity) FILTER ({cond}), 0) / sum(multiplicity), 9) AS event_weighted_percent FROM moves"
        )
    return " UNION ALL ".join(lines)


@query("outcome_totals", ("moves",), totals_sql())
def _(x):
    return C.outcome_totals(x.moves)


RATE = "avg(CASE WHEN {} THEN 1e0 ELSE 0e0 END)"


def _geometry_sql() -> str:
    codes = ((1, "adverse"), (2, "corrective"), (3, "lateral"))
    items = ["count(*) AS unique_candidates", "CAST(sum(multiplicity) AS BIGINT) AS event_weighted_candidates",
             f"round({RATE.format('transition_code <> 0')}, 9) AS class_change_rate"]
    items += [f"round({RATE.format(f'transition_code = {c}')}, 9) AS {n}_rate" for c, n in codes]
    items += ["count(*) FILTER (transition_code <> 0) AS class_changed_unique"]
    items += [f"count(*) FILTER (transition_code = {c}) AS {n}_unique" for c, n in codes]
    items += [f"min({X.target_margin_sql('scores', 'clean_prediction')}) AS minimum_clean_class_margin",
              f"min({X.target_margin_sql('scores', 'label')}) AS minimum_true_class_margin",
              "count(DISTINCT candidate_prediction) AS distinct_candidate_classes"]
    for v, n in ((-1, "previous"), (1, "next")):
        items += [f"count(*) FILTER (direction = {v}) AS {n}_candidates",
                  f"round({RATE.format('transition_code <> 0')} FILTER (direction = {v}), 9) AS {n}_class_change_rate",
                  f"round({RATE.format('transition_code = 1')} FILTER (direction = {v}), 9) AS {n}_adverse_rate"]
    items += [f"round({RATE.format('transition_code <> 0')} FILTER (direction = -1) - {RATE.format('transition_code <> 0')} FILTER (direction = 1), 9) AS previous_minus_next_class_change_rate"]
    items += [f"round({RATE.format('transition_code <> 0')} FILTER ({part_sql('from_bin', LAST, 3)} = {i}), 9) AS time_tertile_{i + 1}_class_change_rate" for i in range(3)]
    items += [f"round({RATE.format('transition_code <> 0')} FILTER ({part_sql('feature', str(W), 4)} = {i}), 9) AS feature_quartile_{i + 1}_class_change_rate" for i in range(4)]
    return f"""SELECT s.audit_rank, s.source_id, s.label, s.clean_prediction, s.clean_correct, s.clean_margin, s.horizon, s.input_count, g.* EXCLUDE (source_id),
        p.* EXCLUDE (source_id) REPLACE (round(p.paired_direction_discordance, 9) AS paired_direction_discordance)
      FROM (SELECT *, row_number() OVER (ORDER BY source_id) - 1 AS audit_rank FROM sources) s
      JOIN (SELECT source_id, {', '.join(items)} FROM moves GROUP BY source_id) g ON g.source_id = s.source_id
      JOIN pair_counts p ON p.source_id = s.source_id"""


@query("source_geometry", ("moves", "pair_counts"), _geometry_sql())
def _(x):
    ranked = running(x.sources, [], [F.col("source_id").asc()], out="audit_rank").withColumn("audit_rank", F.col("audit_rank") - 1)
    wide = C.source_geometry(x.scored_pairs, ranked, W)
    return wide.select(*[
        F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in wide.dtypes
    ])


@query(
    "class_transition_matrix", ("moves",),
    "SELECT clean_prediction, candidate_prediction, count(*) AS unique_n, CAST(sum(multiplicity) AS BIGINT) AS event_weighted_n FROM moves GROUP BY ALL",
)
def _(x):
    return C.class_transition_matrix(x.moves)


@query(
    "transition_grid", ("moves",),
    f"""SELECT CAST(CASE WHEN direction > 0 THEN 1 ELSE 0 END AS BIGINT) AS direction_id, {part_sql('from_bin', LAST, 20)} AS time_bin,
      {part_sql('feature', str(W), 14)} AS feature_bin, transition_code, count(*) AS unique_n, CAST(sum(multiplicity) AS BIGINT) AS event_weighted_n FROM moves GROUP BY ALL""",
)
def _(x):
    return C.transition_grid(x.moves, W)


X.define(
    "summary", ("moves", "sources"),
    """SELECT s.*, m.* EXCLUDE (source_id) FROM (SELECT source_id, label, clean_prediction, clean_correct, clean_margin, horizon, input_count FROM sources) s
      JOIN (SELECT source_id, count(*) AS unique_candidates, CAST(sum(multiplicity) AS BIGINT) AS event_weighted_candidates,
        count(*) FILTER (transition_code = 1) AS adverse_unique, count(*) FILTER (transition_code = 2) AS corrective_unique,
        count(*) FILTER (transition_code = 3) AS lateral_unique, count(*) FILTER (transition_code <> 0) AS class_changed_unique,
        count(*) FILTER (candidate_prediction = label) AS correct_neighbors FROM moves GROUP BY 1) m USING (source_id)""",
)


@query(
    "accuracy_decomposition", ("summary",),
    """SELECT round(avg(CASE WHEN clean_correct THEN 1e0 ELSE 0e0 END), 9) AS equal_source_clean_accuracy,
      round(avg(correct_neighbors / unique_candidates), 9) AS equal_source_neighbor_accuracy,
      round(sum(CASE WHEN clean_correct THEN unique_candidates ELSE 0 END) / sum(unique_candidates), 9) AS unique_candidate_clean_accuracy,
      round(sum(correct_neighbors) / sum(unique_candidates), 9) AS unique_candidate_neighbor_accuracy,
      CAST(sum(corrective_unique - adverse_unique) AS BIGINT) AS corrective_minus_adverse,
      round(100e0 * (sum(correct_neighbors) / sum(unique_candidates) - sum(CASE WHEN clean_correct THEN unique_candidates ELSE 0 END) / sum(unique_candidates)), 9) AS unique_candidate_gain_percentage_points
      FROM summary""",
)
def _(x):
    return rounded(C.accuracy_decomposition(x.summary))


def rounded(df, digits: int = 9):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


@query(
    "panel_incidence", ("summary",),
    """SELECT count(*) FILTER (clean_correct) AS clean_correct_sources, count(*) FILTER (clean_correct AND adverse_unique > 0) AS adverse_sensitive_sources,
      count(*) FILTER (class_changed_unique > 0) AS any_change_sources, count(*) FILTER (corrective_unique > 0) AS corrective_sources,
      count(*) FILTER (lateral_unique > 0) AS lateral_sources,
      round(count(*) FILTER (clean_correct AND adverse_unique > 0) / count(*) FILTER (clean_correct), 9) AS adverse_source_incidence,
      round(avg(class_changed_unique / unique_candidates), 9) AS mean_source_class_change_rate,
      round(avg(adverse_unique / unique_candidates) FILTER (clean_correct), 9) AS mean_adverse_rate FROM summary""",
)
def _(x):
    return rounded(C.panel_incidence(x.summary))


X.define(
    "summary_adverse", ("summary",),
    "SELECT adverse_unique AS v, row_number() OVER (ORDER BY adverse_unique, source_id) AS r, count(*) OVER () AS n FROM summary WHERE clean_correct",
)


@query(
    "concentration", ("summary_adverse",),
    """SELECT round(2e0 * sum(r * v) / (max(n) * sum(v)) - (max(n) + 1) / max(n), 9) AS gini,
        round(sum(CAST(v AS DOUBLE) * v) / (CAST(sum(v) AS DOUBLE) * sum(v)), 9) AS herfindahl,
        round(1e0 / (sum(CAST(v AS DOUBLE) * v) / (CAST(sum(v) AS DOUBLE) * sum(v))), 9) AS effective_number_of_sources FROM summary_adverse""",
)
def _(x):
    return rounded(C.concentration(x.summary.where("clean_correct"), "adverse_unique", "source_id"))
