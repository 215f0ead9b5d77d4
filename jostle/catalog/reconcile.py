"""Queries: reconciliation, checks, hashing, text scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from jostle.catalog import fixtures as X
from jostle.catalog.registry import query
from jostle.functions.hashing import canonical_hash
from jostle.functions.ints import div
from jostle.operators import documents as D
from jostle.operators import events as E
from jostle.operators import reconcile as R
from jostle.operators import texts as T
from jostle.plans.ordering import running

mod = lambda c, k: F.pmod(F.col(c), F.lit(k))
LEAVES = ("label", "unique_candidates", "adverse_unique", "adverse_rate", "clean_correct")


def leaf_table(x):
    return x.summary.select(
        "source_id", "label", "unique_candidates", "adverse_unique",
        F.try_divide("adverse_unique", "unique_candidates").alias("adverse_rate"), "clean_correct",
    )


@query(
    "compare_tree", ("summary",),
    f"""SELECT concat('sources/', source_id, '/', name) AS path, CASE WHEN source_id % 11 = 0 THEN 'unexpected' WHEN name = 'clean_correct' THEN 'value' ELSE 'number' END AS reason
      FROM (SELECT source_id, unnest({list(LEAVES)}) AS name FROM summary)
      WHERE source_id % 11 = 0 OR (source_id % 7 = 0 AND name = 'adverse_unique') OR (source_id % 5 = 0 AND name = 'clean_correct')""",
)
def _(x):
    """Expected leaves lack every eleventh source, and differ in a count or a flag of some others."""
    actual = leaf_table(x)
    expected = actual.where(mod("source_id", 11) != 0).withColumns({
        "adverse_unique": F.col("adverse_unique") + F.when(mod("source_id", 7) == 0, 1).otherwise(0),
        "clean_correct": F.when(mod("source_id", 5) == 0, ~F.col("clean_correct")).otherwise(F.col("clean_correct")),
    })
    return R.compare_tree(R.flatten_rows(actual, "sources", ["source_id"]), R.flatten_rows(expected, "sources", ["source_id"]))


@query(
    "compare_tolerant", ("summary",),
    """SELECT 5 * count(*) AS leaves, count(*) FILTER (source_id % 6 = 0) AS errors, count(*) FILTER (source_id % 4 = 0) AS accepted_differences, round(1e-7, 12) AS max_accepted_difference, 'FAIL' AS status FROM summary""",
)
def _(x):
    """Rates off by 1e-7 pass at the loose tolerance, counts off by 1e-7 fail at the strict one."""
    actual = leaf_table(x).withColumn("unique_candidates", F.col("unique_candidates").cast("double"))
    expected = actual.withColumns({
        "adverse_rate": F.col("adverse_rate") + F.when(mod("source_id", 4) == 0, 1e-7).otherwise(0.0),
        "unique_candidates": F.col("unique_candidates") + F.when(mod("source_id", 6) == 0, 1e-7).otherwise(0.0),
    })
    out = R.compare_tolerant(
        R.flatten_rows(actual, "sources", ["source_id"]), R.flatten_rows(expected, "sources", ["source_id"]), "_rate$"
    )
    return out.withColumn("max_accepted_difference", F.round("max_accepted_difference", 12))


def audit_items(x):
    """One item of the audit document for each source."""
    return x.summary.select(
        F.col("source_id").alias("id"), "label", "clean_correct", "unique_candidates",
        F.try_divide("adverse_unique", "unique_candidates").alias("adverse_rate"),
        F.struct(F.col("adverse_unique").alias("adverse"), F.col("class_changed_unique").alias("changed")).alias("counts"),
        F.array("adverse_unique", "unique_candidates").alias("pair"),
    )


def path_of(*parts):
    return F.concat(*[F.lit(p) if p[0] != "@" else F.col(p[1:]).cast("string") for p in parts])


@query(
    "tolerant_differences", ("summary",),
    """SELECT concat('sources/', source_id, '/', name) AS path, round(CASE WHEN why IS NULL THEN 1e-7 WHEN why = 'number' THEN 1e-7 END, 9) AS absolute_difference,
      CASE name WHEN 'adverse_rate' THEN 1e-6 ELSE 1e-12 END AS absolute_tolerance, why AS reason
      FROM (SELECT source_id, 'adverse_rate' AS name, NULL AS why FROM summary WHERE source_id % 4 = 0 UNION ALL SELECT source_id, 'unique_candidates', 'number' FROM summary WHERE source_id % 6 = 0
        UNION ALL SELECT source_id, 'clean_correct', 'value' FROM summary WHERE source_id % 5 = 0)""",
)
def _(x):
    """Every leaf that is not the same: accepted differences of rates, refused ones of counts and flags."""
    actual = leaf_table(x).withColumn("unique_candidates", F.col("unique_candidates").cast("double"))
    expected = actual.withColumns({
        "adverse_rate": F.col("adverse_rate") + F.when(mod("source_id", 4) == 0, 1e-7).otherwise(0.0),
        "unique_candidates": F.col("unique_candidates") + F.when(mod("source_id", 6) == 0, 1e-7).otherwise(0.0),
        "clean_correct": F.when(mod("source_id", 5) == 0, ~F.col("clean_correct")).otherwise(F.col("clean_correct")),
    })
    out = R.tolerant_differences(R.flatten_rows(actual, "sources", ["source_id"]), R.flatten_rows(expected, "sources", ["source_id"]), "_rate$")
    return out.select("path", F.round("absolute_difference", 9).alias("absolute_difference"), "absolute_tolerance", "reason")


@query(
    "resolve_path", ("summary",),
    """SELECT path, status, CAST(matches AS BIGINT) AS matches, CAST(position AS BIGINT) AS position, kind, text, CAST(number AS DOUBLE) AS number FROM (
      WITH s AS (SELECT *, row_number() OVER (ORDER BY source_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS twins FROM summary)
      SELECT concat('sources[id=', source_id, ',clean_correct=true].unique_candidates') AS path, CASE WHEN clean_correct THEN 'FOUND' ELSE 'MISSING' END AS status, CASE WHEN clean_correct THEN 1 ELSE 0 END AS matches,
        NULL AS position, CASE WHEN clean_correct THEN 'number' END AS kind, CASE WHEN clean_correct THEN CAST(unique_candidates AS VARCHAR) END AS text, CASE WHEN clean_correct THEN unique_candidates END AS number FROM s
      UNION ALL SELECT concat('sources[', place, '].counts.adverse'), 'FOUND', 1, NULL, 'number', CAST(adverse_unique AS VARCHAR), adverse_unique FROM s
      UNION ALL SELECT concat('sources[', place, '].counts.nothing'), 'MISSING', 0, NULL, NULL, NULL, NULL FROM s
      UNION ALL SELECT concat('sources[label=', label, '].id'), CASE WHEN min(twins) = 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END, min(twins), NULL, CASE WHEN min(twins) = 1 THEN 'number' END,
        CASE WHEN min(twins) = 1 THEN CAST(min(source_id) AS VARCHAR) END, CASE WHEN min(twins) = 1 THEN min(source_id) END FROM s GROUP BY label
      UNION ALL SELECT concat('sources[id=', source_id, '].pair'), 'FOUND', 1, NULL, 'list', NULL, 2 FROM s
      UNION ALL SELECT concat('sources[id=', source_id, '].pair'), 'FOUND', 1, p, 'number', CAST(v AS VARCHAR), v FROM (SELECT source_id, unnest([0, 1]) AS p, unnest([adverse_unique, unique_candidates]) AS v FROM s)
      UNION ALL SELECT 'sources', 'FOUND', 1, NULL, 'list', NULL, count(*) FROM s
      UNION ALL SELECT 'sources', 'FOUND', 1, place, 'object', NULL, NULL FROM s
      UNION ALL SELECT unnest(['sources..id', 'sources[id].label', 'sources[0', '']), 'INVALID', 0, NULL, NULL, NULL, NULL)""",
)
def _(x):
    """Selectors, positions, lists and faulty paths of every source, all in one pass."""
    nodes = D.document_nodes(audit_items(x), "sources", ["id"])
    placed = running(x.summary.select("source_id", "label"), [], [F.col("source_id").asc()], out="place").withColumn("at", F.col("place") - 1)
    each = placed.select(F.explode(F.array(
        path_of("sources[id=", "@source_id", ",clean_correct=true].unique_candidates"), path_of("sources[", "@at", "].counts.adverse"),
        path_of("sources[", "@at", "].counts.nothing"), path_of("sources[label=", "@label", "].id"), path_of("sources[id=", "@source_id", "].pair"),
    )).alias("path"))
    fixed = x.spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in ("sources", "sources..id", "sources[id].label", "sources[0", "")])).alias("path"))
    return D.resolve_paths(nodes, each.unionByName(fixed))


@query(
    "check_cells", ("summary",),
    """SELECT concat(kind, '-', source_id) AS id, CASE WHEN kind = 'count' AND source_id % 10 = 0 THEN concat('sources[id=', source_id, '].nowhere') ELSE concat('sources[id=', source_id, '].',
        CASE kind WHEN 'count' THEN 'unique_candidates' WHEN 'percent' THEN 'adverse_rate' WHEN 'bool' THEN 'clean_correct' ELSE 'pair' END) END AS path,
      CASE WHEN why IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, why AS reason,
      CASE WHEN why = 'missing' THEN NULL WHEN kind = 'count' THEN CAST(unique_candidates AS DOUBLE) WHEN kind = 'percent' THEN round(100 * (adverse_unique / unique_candidates), 6) END AS computed,
      CASE WHEN why = 'missing' THEN NULL WHEN kind = 'count' THEN CASE WHEN source_id % 9 = 0 THEN -1e0 ELSE 0e0 END
        WHEN kind = 'percent' THEN round(100 * (adverse_unique / unique_candidates) - (round(100 * (adverse_unique / unique_candidates), 2) + CASE WHEN source_id % 8 = 0 THEN 0.02 ELSE 0 END), 6)
        WHEN kind = 'list' AND source_id % 7 = 0 THEN 1e0 END AS difference,
      CASE kind WHEN 'count' THEN 0e0 WHEN 'percent' THEN 0.005e0 WHEN 'list' THEN 0.5e0 END AS tolerance
      FROM (SELECT *, CASE WHEN kind = 'count' AND source_id % 10 = 0 THEN 'missing' WHEN kind = 'count' AND source_id % 9 = 0 THEN 'value' WHEN kind = 'percent' AND source_id % 8 = 0 THEN 'value'
        WHEN kind = 'list' AND source_id % 6 = 0 THEN 'length' WHEN kind = 'list' AND source_id % 7 = 0 THEN 'value' END AS why
        FROM (SELECT *, unnest(['count', 'percent', 'bool', 'list']) AS kind FROM summary))""",
)
def _(x):
    """Four printed cells per source, some misprinted, some too long and some pointing nowhere."""
    base, path = audit_items(x), lambda name: path_of("sources[id=", "@id", f"].{name}")
    entry = lambda kind, where, how, printed, decimals, scale, items=None: F.struct(
        F.concat(F.lit(f"{kind}-"), F.col("id").cast("string")).alias("id"), where.alias("path"), F.lit(how).alias("kind"), printed.cast("string").alias("printed"),
        (F.lit(None) if items is None else items).cast("array<double>").alias("items"), F.lit(decimals).alias("decimals"), F.lit(scale).alias("scale"),
    )
    items = F.array(F.get("pair", F.lit(0)) + F.when(mod("id", 7) == 0, 1).otherwise(0), F.get("pair", F.lit(1)))
    items = F.when(mod("id", 6) == 0, F.concat(items, F.array(F.lit(0).cast("long")))).otherwise(items)
    cells = base.select(F.explode(F.array(
        entry("count", F.when(mod("id", 10) == 0, path("nowhere")).otherwise(path("unique_candidates")), "number",
              F.col("unique_candidates") + F.when(mod("id", 9) == 0, 1).otherwise(0), 0, 1.0),
        entry("percent", path("adverse_rate"), "number", F.round(100 * F.col("adverse_rate"), 2) + F.when(mod("id", 8) == 0, 0.02).otherwise(0.0), 2, 100.0),
        entry("bool", path("clean_correct"), "bool", F.col("clean_correct"), 0, 1.0),
        entry("list", path("pair"), "list", F.lit(None), 0, 1.0, items),
    )).alias("c")).select("c.*")
    out = D.check_cells(D.document_nodes(base, "sources", ["id"]), cells)
    shown = F.when(~F.startswith("id", F.lit("bool")), F.expr("try_cast(computed as double)"))
    return out.select(
        "id", "path", "status", "reason", F.round(shown, 6).alias("computed"), F.round("difference", 6).alias("difference"), F.round("tolerance", 6).alias("tolerance")
    )


@query(
    "compare_point", ("moves",),
    """SELECT failed, count(*) AS candidates, round(max(d), 6) AS max_difference FROM (SELECT concat_ws(',', CASE WHEN cand % 101 = 0 THEN 'candidate_prediction' END,
      CASE WHEN (source_id + cand) % 97 = 0 THEN 'score_l2_change' END) AS failed, CASE WHEN (source_id + cand) % 97 = 0 THEN 0.01e0 ELSE 0e0 END AS d FROM moves) GROUP BY 1""",
)
def _(x):
    fresh = R.candidate_descriptors(x.scored, X.CLASSES)
    stored = fresh.withColumns({
        "score_l2_change": F.col("score_l2_change") + F.when(F.pmod(F.col("source_id") + F.col("cand"), F.lit(97)) == 0, 0.01).otherwise(0.0),
        "candidate_prediction": F.col("candidate_prediction") + F.when(mod("cand", 101) == 0, 1).otherwise(0),
    })
    judged = R.compare_point(fresh, stored, 1e-4)
    return judged.groupBy("failed").agg(F.count(F.lit(1)).alias("candidates"), F.round(F.max("max_difference"), 6).alias("max_difference"))


FAULTS = {
    "missing_stored": "cand % 90 = 13", "trace_metrics": "cand % 50 = 3 OR cand % 80 = 9", "missing_patch_scores": "changed AND cand % 60 = 11",
    "patch_scores": "changed AND cand % 60 <> 11 AND (cand % 40 = 7 OR cand % 70 = 5)", "patch_predictions": "changed AND cand % 60 <> 11 AND cand % 30 = 4",
    "positive_controls": "changed AND cand % 60 <> 11 AND cand % 70 = 5",
}


def _points_sql() -> str:
    names = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in FAULTS.items() if name != "missing_stored")
    there = "cand % 90 <> 13"
    return f"""SELECT failed, count(*) AS candidates, round(max(scores), 6) AS max_score_difference, round(max(traces), 6) AS max_trace_difference, round(max(patches), 6) AS max_patch_difference, round(max(controls), 6) AS max_control_difference
      FROM (SELECT CASE WHEN {FAULTS['missing_stored']} THEN 'missing_stored' ELSE concat_ws(',', {names}) END AS failed, CASE WHEN {there} THEN 0e0 END AS scores,
        CASE WHEN {there} THEN CASE WHEN cand % 50 = 3 THEN 0.01e0 ELSE 0e0 END END AS traces,
        CASE WHEN changed AND {there} AND cand % 60 <> 11 THEN CASE WHEN cand % 70 = 5 THEN 2e0 WHEN cand % 40 = 7 THEN 1e0 ELSE 0e0 END END AS patches,
        CASE WHEN changed AND cand % 60 <> 11 THEN CASE WHEN cand % 70 = 5 THEN 2e0 ELSE 0e0 END END AS controls
        FROM (SELECT *, transition_code <> 0 AS changed FROM moves)) GROUP BY 1"""


@query("compare_outputs", ("moves",), _points_sql())
def _(x):
    """Fresh against stored outputs on all grains; traces, replacements and controls are off or absent for some candidates."""
    moves = R.by_candidate(x.kept_scores, x.kept_scores.count())
    points, patches = R.candidate_descriptors(moves, X.CLASSES), x.patches(moves)
    stored_there = mod("cand", 90) != 13
    raised = lambda column, at, amount: F.transform(column, lambda v, i: v + F.when((i == 0) & at, amount).otherwise(0))
    fresh_patches = patches.where(mod("cand", 60) != 11).withColumn("patch_scores", raised("patch_scores", (F.col("stage") == 3) & (mod("cand", 70) == 5), 2))
    fresh = R.output_cells(points, x.traces(moves.select("source_id", "cand")), fresh_patches, controls=(0, 3, 6))
    traces = x.traces(moves.select("source_id", "cand")).where(stored_there & ((mod("cand", 80) != 9) | (F.col("stage") != 6) | (F.col("metric") != 0)))
    fault = (mod("cand", 50) == 3) & (F.col("stage") == 2) & (F.col("metric") == 1)
    traces = traces.withColumn("value", F.col("value") + F.when(fault, 0.01).otherwise(0.0))
    kept = patches.where(stored_there).withColumns({
        "patch_scores": raised("patch_scores", (F.col("stage") == 1) & (mod("cand", 40) == 7), 1),
        "patch_prediction": F.col("patch_prediction") + F.when((F.col("stage") == 5) & (mod("cand", 30) == 4), 1).otherwise(0),
    })
    stored = R.output_cells(points.where(stored_there), traces, kept)
    judged = R.compare_outputs(fresh, stored, 1e-4, 1e-6, together=True)
    worst = [F.round(F.max(c), 6).alias(c) for c in ("max_score_difference", "max_trace_difference", "max_patch_difference", "max_control_difference")]
    return judged.groupBy("failed").agg(F.count(F.lit(1)).alias("candidates"), *worst)


@query(
    "replacement_coverage", ("moves",),
    """SELECT *, missing + unexpected + partial + misshapen = 0 AS complete FROM (SELECT source_id // 10 AS chunk, count(*) FILTER (c) AS requested, count(*) FILTER (k) AS stored, count(*) FILTER (c AND NOT k) AS missing,
      count(*) FILTER (k AND NOT c) AS unexpected, count(*) FILTER (k AND cand % 35 = 4) AS partial, count(*) FILTER (k AND (cand % 45 = 6 OR cand % 55 = 8)) AS misshapen FROM (
        SELECT source_id, cand, transition_code <> 0 AND cand % 100 <> 1 AS c, transition_code <> 0 AND cand % 50 <> 2 AS k FROM moves) WHERE c OR k GROUP BY 1)""",
)
def _(x):
    """Replacements of changed candidates: some not asked for, not stored, without a stage, a class, or a finite value."""
    patches = x.patches(x.scored).withColumn("chunk", div(F.col("source_id"), 10))
    requested = x.moves.where("transition_code <> 0 AND cand % 100 <> 1").withColumn("chunk", div(F.col("source_id"), 10))
    kept = patches.where((mod("cand", 50) != 2) & ((mod("cand", 35) != 4) | (F.col("stage") != 2)))
    scores = F.transform("patch_scores", lambda v: v.cast("double"))
    first = lambda at: F.transform(scores, lambda v, i: F.when((i == 0) & at, float("nan")).otherwise(v))
    cut = F.when((mod("cand", 45) == 6) & (F.col("stage") == 4), F.slice(scores, 1, X.CLASSES - 1)).otherwise(first((mod("cand", 55) == 8) & (F.col("stage") == 1)))
    return R.replacement_coverage(requested, kept.withColumn("patch_scores", cut), "chunk", X.STAGES, X.CLASSES)


@query(
    "coverage_check", ("moves",),
    """SELECT *, missing = 0 AND unexpected = 0 AND invalid = 0 AS complete FROM (SELECT source_id // 10 AS chunk, count(*) FILTER (c) AS requested, count(*) FILTER (k) AS stored, count(*) FILTER (c AND NOT k) AS missing,
      count(*) FILTER (k AND NOT c) AS unexpected, count(*) FILTER (k AND cand % 77 = 0) AS invalid FROM (
        SELECT source_id, cand, transition_code <> 0 AS c, (transition_code <> 0 AND cand % 50 <> 0) OR (transition_code = 0 AND cand % 400 = 3) AS k FROM moves) WHERE c OR k GROUP BY 1)""",
)
def _(x):
    moves = x.scored.withColumn("chunk", div(F.col("source_id"), 10))
    requested = moves.where("transition_code <> 0")
    kept = moves.where("(transition_code <> 0 AND cand % 50 <> 0) OR (transition_code = 0 AND cand % 400 = 3)")
    stored = kept.withColumn("scores", F.when(mod("cand", 77) == 0, F.slice("scores", 1, 3)).otherwise(F.col("scores")))
    return R.coverage_check(requested, stored, "chunk", X.CLASSES)


@query(
    "validate_candidates", ("moves",),
    """SELECT unnest(['missing', 'unexpected', 'coordinates', 'multiplicity', 'not_adjacent', 'direction', 'label', 'clean_prediction', 'index_not_dense']) AS "check",
      unnest([count(*) FILTER (cand % 1000 = 1), CAST(0 AS BIGINT), count(*) FILTER (cand % 1000 = 2), count(*) FILTER (cand % 1000 = 3), count(*) FILTER (cand % 1000 = 2), count(*) FILTER (cand % 1000 = 2), 0, 0,
        count(DISTINCT source_id) FILTER (last > 0)]) AS violations FROM (SELECT *, max(cand) OVER (PARTITION BY source_id) AS last FROM moves)""",
)
def _(x):
    """Stored candidates with some rows dropped, moved too far or with a wrong multiplicity."""
    stored = x.moves.where(mod("cand", 1000) != 1).withColumns({
        "to_bin": F.when(mod("cand", 1000) == 2, F.col("to_bin") + 2 * F.col("direction")).otherwise(F.col("to_bin")),
        "multiplicity": F.when(mod("cand", 1000) == 3, F.col("multiplicity") + 1).otherwise(F.col("multiplicity")),
    })
    return R.validate_candidates(stored, x.cells, x.sources)


@query(
    "rebuild_check", ("cells",),
    """SELECT unnest(['implementations_differ', 'stored_cells_differ', 'labels_differ']) AS "check", unnest([CAST(0 AS BIGINT), 2 * count(*) FILTER (t % 50 = 7), count(DISTINCT source_id) FILTER (source_id % 13 = 0)]) AS violations FROM cells""",
)
def _(x):
    """Two fresh binnings against stored cells with every fiftieth bin's counts raised."""
    expected = x.cells.count()
    a = E.bin_events(x.events, x.bounds, X.STEP, cells=expected)
    stored = x.cells.withColumn("n", F.col("n") + F.when(F.pmod(F.col("t"), F.lit(50)) == 7, 1).otherwise(0))
    wrong = x.sources.withColumn("label", F.when(mod("source_id", 13) == 0, F.col("label") + 1).otherwise(F.col("label")))
    return R.rebuild_check(a, E.bin_events_oracle(x.events, X.STEP, cells=expected), stored, x.sources, wrong)


CHECKS = (
    "candidate_label_range candidate_clean_range candidate_prediction_range candidate_scores_finite candidate_scores_width "
    "candidate_argmax_stored clean_argmax_stored code_range code_preserved code_adverse code_corrective code_lateral move_adjacent move_direction "
    "move_from_range move_to_range move_feature_range move_multiplicity_positive margin_sign cell_count_positive cell_count_storable "
    "cell_time_range cell_feature_range source_horizon_positive source_scores_finite source_scores_width source_label_range "
    "source_argmax_stored source_margin_rederived source_correct_flag trace_missing trace_finite trace_stage_range trace_metric_range "
    "patch_only_changed patch_scores_finite patch_argmax_stored patch_control_exact source_unknown source_input_count source_cardinality "
    "candidate_index_dense patch_coverage trace_coverage"
).split()


@query(
    "invariant_suite", ("patches",),
    f"""SELECT c AS "check", CASE c WHEN 'move_multiplicity_positive' THEN (SELECT count(*) FILTER (cand % 500 = 9) FROM moves) WHEN 'patch_argmax_stored' THEN (SELECT count(*) FILTER (stage = 1 AND cand % 20 = 0) FROM patches)
      WHEN 'source_input_count' THEN (SELECT count(*) FILTER (source_id % 25 = 0) FROM sources) ELSE CAST(0 AS BIGINT) END AS violations FROM (SELECT unnest({CHECKS}) AS c)""",
)
def _(x):
    """The whole suite on a census with three planted faults."""
    moves = x.kept_scores.withColumn("multiplicity", F.when(mod("cand", 500) == 9, 0).otherwise(F.col("multiplicity")))
    sources = x.sources.withColumn("input_count", F.col("input_count") + F.when(mod("source_id", 25) == 0, 1).otherwise(0))
    patches = x.patches(x.kept_scores)
    fault = (F.col("stage") == 1) & (mod("cand", 20) == 0)
    patches = patches.withColumn("patch_prediction", F.when(fault, F.pmod(F.col("patch_prediction") + 1, F.lit(X.CLASSES))).otherwise(F.col("patch_prediction")))
    return R.census_invariants(
        moves, x.cells, sources, x.traces(x.kept_scores.drop("scores", "clean_scores")), patches, X.CLASSES, X.WIDTH, X.STAGES, X.METRICS, (0, 3, 6)
    )


HASH_SQL = """sha256(concat('{"clean_prediction":', clean_prediction, ',"horizon":', horizon, ',"label":', label, ',"source_id":', source_id, '}'))"""
PAYLOAD = ["source_id", "label", "horizon", "clean_prediction"]


@query("canonical_hash", ("sources",), f"SELECT source_id, {HASH_SQL} AS hash FROM sources")
def _(x):
    return x.sources.select("source_id", canonical_hash(PAYLOAD).alias("hash"))


@query(
    "contract_check", ("sources",),
    "SELECT concat('artifact-', source_id) AS artifact, source_id % 10 <> 0 AS contract_ok, source_id % 7 <> 0 AND source_id % 10 <> 0 AS output_ok, source_id % 9 <> 0 AS upstream_ok FROM sources",
)
def _(x):
    """One contract per source; some ids, outputs and upstream digests are stale."""
    artifact = F.concat(F.lit("artifact-"), F.col("source_id").cast("string"))
    honest = x.sources.select(
        artifact.alias("artifact"), *PAYLOAD, canonical_hash(PAYLOAD).alias("hash"),
        F.concat(F.lit("input-"), F.col("source_id").cast("string")).alias("upstream"),
        F.sha2(F.col("input_count").cast("string"), 256).alias("upstream_sha256"),
    )
    contracts = honest.withColumn("contract_id", F.when(mod("source_id", 10) == 0, F.sha2("hash", 256)).otherwise(F.col("hash"))).drop("hash")
    outputs = honest.where(mod("source_id", 7) != 0).select("artifact", F.col("hash").alias("contract_id"))
    files = honest.select(
        F.col("upstream").alias("path"),
        F.when(mod("source_id", 9) == 0, F.sha2("upstream", 256)).otherwise(F.col("upstream_sha256")).alias("sha256"),
    )
    return R.contract_check(contracts, PAYLOAD, outputs, files)


# What a reader of the documents table may want to find before publishing it.
PATTERNS = {
    "mail_address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}",
    "dotted_quad": r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
    "long_number": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "dial_code": r"[+][0-9]{1,3} [(]?[0-9]{2,4}[)]?",
    "web_link": r"https?://[A-Za-z0-9./_-]+",
    "licence_line": r"(?i)(licen[cs]ed under|all rights reserved|copyright)",
    "access_key": r"(?i)(api[_-]?key|secret|token|passw(or)?d) ?[=:]",
    "symbol_run": r"[#*$%&|]{3,}",
}


def _scan_sql() -> str:
    parts = [
        f"SELECT doc_id, '{name}' AS pattern, CAST(len(regexp_extract_all(text, '{regex}')) AS BIGINT) AS matches FROM kept" for name, regex in PATTERNS.items()
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE matches > 0"


X.define("kept", (), "SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")


@query("scan_patterns", ("kept",), _scan_sql())
def _(x):
    exempt = x.table("labels").where("toxic = 1").select("doc_id")
    return T.scan_patterns(x.table("documents"), "doc_id", "text", PATTERNS, exempt)


def _matches_sql() -> str:
    parts = [
        f"SELECT doc_id, line, '{name}' AS pattern, unnest(range(1, len(hits) + 1)) AS occurrence, unnest(hits) AS match FROM (SELECT doc_id, line, regexp_extract_all(text, '{regex}') AS hits FROM lines)" for name, regex in PATTERNS.items()
    ]
    return "SELECT * FROM (WITH lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM kept)) " + " UNION ALL ".join(parts) + ")"


@query("list_matches", ("kept",), _matches_sql())
def _(x):
    exempt = x.table("labels").where("toxic = 1").select("doc_id")
    return T.list_matches(x.table("documents"), "doc_id", "text", PATTERNS, exempt)
