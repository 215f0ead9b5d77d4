"""Checks of one result against another: trees of values, printed cells, candidate outputs, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jostle.functions import scores as S
from jostle.operators.moves import enumerate_moves
from jostle.plans.staging import fan_out


# ---------------------------------------------------------------- trees of values


def flatten_rows(df: DataFrame, root: str, key: Sequence[str]) -> DataFrame:
    """Rows of a keyed table as leaves ``(path, kind, text, number)``; path = root/key.../column.

    Arrays become one leaf per element plus their length, so a changed length is a mismatch.
    """
    leaves = []
    prefix = F.concat_ws("/", F.lit(root), *[F.col(k).cast("string") for k in key])
    for name, kind in df.dtypes:
        if name in key:
            continue
        column, path = F.col(name), F.concat(prefix, F.lit(f"/{name}"))
        if kind.startswith("array"):
            length = F.array(leaf(F.concat(path, F.lit("/length")), "number", F.size(column)))
            leaves.append(F.concat(length, F.transform(column, _element_leaf(path))))
        else:
            leaves.append(F.array(leaf(path, "number" if kind in NUMERIC or kind.startswith("decimal") else kind, column)))
    return df.select(F.explode(F.concat(*leaves)).alias("l")).select("l.*")


def _element_leaf(path: Column):
    return lambda v, i: leaf(F.concat(path, F.lit("/"), i.cast("string")), "number", v)


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def leaf(path: Column, kind: str, value: Column) -> Column:
    number = value.cast("double") if kind == "number" else F.lit(None).cast("double")
    return F.struct(
        path.alias("path"), F.when(value.isNull(), "null").otherwise(F.lit(kind)).alias("kind"),
        value.cast("string").alias("text"), number.alias("number"),
    )


def compare_tree(actual: DataFrame, expected: DataFrame, tolerance: Column | float = 1e-12) -> DataFrame:
    """Every leaf that is missing, unexpected, of another kind or off by more than ``tolerance``
    (which may depend on ``path``)."""
    limit = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    joined = _meet(actual, expected)
    return joined.withColumn("reason", _mismatch(limit)).where(F.col("reason").isNotNull()).select("path", "reason")


def _meet(actual: DataFrame, expected: DataFrame) -> DataFrame:
    left = actual.select("path", F.struct("kind", "text", "number").alias("a"))
    right = expected.select("path", F.struct("kind", "text", "number").alias("e"))
    return left.join(right, "path", "full_outer").withColumn("difference", F.abs(F.col("a.number") - F.col("e.number")))


def _mismatch(limit: Column) -> Column:
    numbers = (F.col("a.kind") == "number") & (F.col("e.kind") == "number")
    return (
        F.when(F.col("a").isNull(), "missing")
        .when(F.col("e").isNull(), "unexpected")
        .when(F.col("a.kind") != F.col("e.kind"), "kind")
        .when(numbers & ((F.col("difference") > limit) | F.isnan("difference") | F.col("difference").isNull()), "number")
        .when(~numbers & ~F.col("a.text").eqNullSafe(F.col("e.text")), "value")
    )


def tolerant_differences(
    actual: DataFrame, expected: DataFrame, loose_pattern: str, loose: float = 1e-6, strict: float = 1e-12
) -> DataFrame:
    """R2, rows: (path, computed, recorded, absolute_difference, absolute_tolerance, reason) for every leaf that is not the same.

    ``reason`` is NULL for a difference within the tolerance of its path.
    """
    limit = F.when(F.col("path").rlike(loose_pattern), F.lit(loose)).otherwise(F.lit(strict))
    judged = _meet(actual, expected).withColumns({"reason": _mismatch(limit), "absolute_tolerance": limit})
    return judged.where(F.col("reason").isNotNull() | (F.col("difference") > 0)).select(
        "path", F.col("a.text").alias("computed"), F.col("e.text").alias("recorded"), F.col("difference").alias("absolute_difference"), "absolute_tolerance", "reason"
    )


def compare_tolerant(
    actual: DataFrame, expected: DataFrame, loose_pattern: str, loose: float = 1e-6, strict: float = 1e-12
) -> DataFrame:
    """R2: path-dependent tolerance; one row with the errors, the accepted nonzero differences, the
    largest of them and PASS or FAIL."""
    limit = F.when(F.col("path").rlike(loose_pattern), F.lit(loose)).otherwise(F.lit(strict))
    judged = _meet(actual, expected).withColumn("reason", _mismatch(limit))
    accepted = F.col("reason").isNull() & (F.col("difference") > 0)
    return judged.agg(
        F.count(F.lit(1)).alias("leaves"),
        F.count_if(F.col("reason").isNotNull()).alias("errors"),
        F.count_if(accepted).alias("accepted_differences"),
        F.coalesce(F.max(F.when(accepted, F.col("difference"))), F.lit(0.0)).alias("max_accepted_difference"),
    ).withColumn("status", F.when(F.col("errors") == 0, "PASS").otherwise("FAIL"))


def resolve_path(leaves: DataFrame, table: str, selector: dict[str, str], column: str) -> DataFrame:
    """The value of ``column`` in the one item of ``table`` that matches every ``key=value``.

    ``leaves`` are rows (table, item, column, value). No match or more than one fails the job.
    """
    scoped = leaves.where(F.col("table") == table)
    tests = [F.bool_or((F.col("column") == k) & (F.col("value") == v)).alias(f"__k{i}") for i, (k, v) in enumerate(selector.items())]
    items = scoped.groupBy("item").agg(F.max(F.when(F.col("column") == column, F.col("value"))).alias("value"), *tests)
    match = F.lit(True)
    for i in range(len(selector)):
        match = match & F.col(f"__k{i}")
    return items.where(match).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value")).select(
        F.when(F.col("n") != 1, F.raise_error(F.concat(F.lit("matches: "), F.col("n").cast("string"))).cast("string")).otherwise(F.col("value")).alias("value")
    )


def check_cells(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Printed cells against computed values by path.

    ``cells`` are (id, path, kind, printed, decimals, scale): counts must be equal, decimals lie within half a
    unit of the last printed digit, strings and booleans be the same. A path with no or several
    values fails.
    """
    found = values.groupBy("path").agg(F.count(F.lit(1)).alias("matches"), F.max("value").alias("value"))
    joined = cells.join(found, "path", "left")
    computed = F.expr("try_cast(value as double)") * F.coalesce(F.col("scale"), F.lit(1.0))
    printed = F.expr("try_cast(printed as double)")
    decimals = F.coalesce(F.col("decimals"), F.lit(0))
    tolerance = 0.5 * F.pow(F.lit(10.0), -decimals) + 1e-9
    exact = (F.round(computed) == printed) & (F.abs(computed - F.round(computed)) < 1e-9)
    ok = (
        F.when(F.col("kind") == "string", F.col("value") == F.col("printed"))
        .when(F.col("kind") == "bool", F.lower("value") == F.lower("printed"))
        .when(decimals > 0, F.abs(computed - printed) <= tolerance)
        .otherwise(exact)
    )
    status = (
        F.when(F.coalesce("matches", F.lit(0)) == 0, "MISSING").when(F.col("matches") > 1, "AMBIGUOUS")
        .when(ok, "PASS").otherwise("FAIL")
    )
    return joined.select("id", "path", status.alias("status"))


# ---------------------------------------------------------------- candidate outputs

SCALARS = (
    "candidate_top1_margin", "candidate_clean_class_margin", "candidate_true_class_margin", "delta_clean_class_score",
    "delta_true_class_score", "score_l2_change", "score_linf_change", "score_cosine_distance",
)


def candidate_descriptors(scored: DataFrame, classes: int | None = None) -> DataFrame:
    """All stored scalar descriptors of a candidate from its score arrays, of ``classes`` scores each where that is known."""
    s, c = F.col("scores"), F.col("clean_scores")
    clean, label = F.col("clean_prediction").cast("int"), F.col("label").cast("int")
    values = (
        S.top_margin(s), S.target_margin(s, clean, classes), S.target_margin(s, label, classes), F.get(s, clean) - F.get(c, clean),
        F.get(s, label) - F.get(c, label), S.l2_change(s, c, classes), S.linf_change(s, c, classes), S.cosine_distance(s, c, classes),
    )
    return scored.select(
        "source_id", "cand", "candidate_prediction", *[v.cast("double").alias(n) for n, v in zip(SCALARS, values)]
    )


def compare_point(fresh: DataFrame, stored: DataFrame, tolerance: float, columns: Sequence[str] = SCALARS) -> DataFrame:
    """Per candidate the list of failed checks and the largest difference. A candidate on one side
    only fails as ``missing_fresh`` or ``missing_stored``; an undefined difference fails its column."""
    pick = lambda df, tag: df.select("source_id", "cand", F.struct("candidate_prediction", *columns).alias(tag))
    joined = pick(fresh, "f").join(pick(stored, "s"), ["source_id", "cand"], "full_outer")
    both = F.col("f").isNotNull() & F.col("s").isNotNull()
    off = {c: F.abs(F.col(f"f.{c}") - F.col(f"s.{c}")) for c in columns}
    failed = F.filter(
        F.array(
            F.when(F.col("f").isNull(), F.lit("missing_fresh")),
            F.when(F.col("s").isNull(), F.lit("missing_stored")),
            F.when(both & undecided_fails(F.col("f.candidate_prediction") != F.col("s.candidate_prediction")), F.lit("candidate_prediction")),
            *[F.when(both & undecided_fails((d > tolerance) | F.isnan(d)), F.lit(c)) for c, d in off.items()],
        ),
        lambda name: name.isNotNull(),
    )
    return joined.select(
        "source_id", "cand", F.array_join(failed, ",").alias("failed"), (F.greatest(*off.values()) if len(off) > 1 else next(iter(off.values()))).alias("max_difference")
    )


# Grains of a stored output, in the order of its cells.
PREDICTION, SCALAR, TRACE, REPLACED, REPLACED_PREDICTION, CONTROL = range(6)


def _cells(grain: int, a: Column, b: Column, value: Column, other: Column | None = None) -> Column:
    """One cell of an output; ``other`` is the value it must have where that is known beside it."""
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(grain).alias("grain"), a.cast("int").alias("a"), b.cast("int").alias("b"), value.cast("double").alias("value"),
        (none if other is None else other.cast("double")).alias("other"),
    )


def output_cells(candidates: DataFrame, traces: DataFrame, patches: DataFrame, columns: Sequence[str] = SCALARS, controls: Sequence[int] = ()) -> DataFrame:
    """All numbers of candidate outputs as rows (source_id, cand, grain, a, b, value, other).

    ``candidates`` carry the prediction and scalar ``columns``, ``traces`` are (stage, metric, value), ``patches`` (stage, patch_scores,
    patch_prediction). At the stages ``controls`` a replacement must give the scores of the source (column clean_scores).
    """
    zero, key = F.lit(0), ["source_id", "cand"]
    own = F.array(_cells(PREDICTION, zero, zero, F.col("candidate_prediction")), *[_cells(SCALAR, zero, F.lit(k), F.col(c)) for k, c in enumerate(columns)])
    scores = F.transform("patch_scores", lambda v, i: _cells(REPLACED, F.col("stage"), i, v))
    parts = [scores, F.array(_cells(REPLACED_PREDICTION, F.col("stage"), zero, F.col("patch_prediction")))]
    if controls:
        held = F.transform("patch_scores", lambda v, i: _cells(CONTROL, F.col("stage"), i, v, F.get("clean_scores", i)))
        parts.append(F.when(F.col("stage").isin(list(controls)), held).otherwise(F.slice(held, 1, 0)))
    rows = candidates.select(*key, F.explode(own).alias("c")).unionByName(
        traces.select(*key, _cells(TRACE, F.col("stage"), F.col("metric"), F.col("value")).alias("c"))
    ).unionByName(patches.select(*key, F.explode(F.concat(*parts)).alias("c")))
    return rows.select(*key, "c.*")


# Candidates of one task: with all their cells they fit its memory.
CANDIDATES_PER_TASK = 20_000


def by_candidate(df: DataFrame, candidates: int) -> DataFrame:
    """Rows (source_id, cand, ...) spread by candidate over as many tasks as ``candidates`` need.

    What is then made of them row by row still lies by candidate, so sides spread alike are compared without a further shuffle
    (``together``), and the rows are shuffled before they are expanded into cells.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-candidates // CANDIDATES_PER_TASK))
    return df.repartition(tasks, "source_id", "cand")


def compare_outputs(
    fresh: DataFrame, stored: DataFrame, score_tolerance: float, trace_tolerance: float, columns: Sequence[str] = SCALARS, together: bool = False
) -> DataFrame:
    """R5 on all grains: per candidate the failed checks and the largest difference of scores, traces, replacements and controls.

    Both sides are :func:`output_cells`, those of ``fresh`` with controls. A trace cell of one side only fails ``trace_metrics``, a stored
    replacement without a fresh one ``missing_patch_scores``; a fresh one that was not stored is held to its controls only. A
    candidate of one side only fails as such and for nothing else. An undefined difference fails, and so does a repeated cell.

    Cells that are made of rows spread by :func:`by_candidate` are grouped where they lie: neither a cell nor a judgement is
    shuffled. Others go through one shuffle on the candidate.
    """
    key, cell = ["source_id", "cand"], ["grain", "a", "b"]
    none = F.lit(None).cast("double")
    left = fresh.select(*key, *cell, F.col("value").alias("f"), F.when(F.col("grain") == CONTROL, F.col("other")).alias("s"), F.lit(1).alias("nf"), F.when(F.col("grain") == CONTROL, 1).otherwise(0).alias("ns"))
    right = stored.where(F.col("grain") != CONTROL).select(*key, *cell, none.alias("f"), F.col("value").alias("s"), F.lit(0).alias("nf"), F.lit(1).alias("ns"))
    cells = left.unionByName(right)
    met = (cells if together else cells.repartition(*[F.col(c) for c in key])).groupBy(*key, *cell).agg(
        F.max("f").alias("f"), F.max("s").alias("s"), F.sum("nf").alias("nf"), F.sum("ns").alias("ns")
    )
    grain, both = F.col("grain"), (F.col("nf") > 0) & (F.col("ns") > 0)
    off = F.when(both, F.abs(F.col("f") - F.col("s")))
    limit = F.when(grain.isin(PREDICTION, REPLACED_PREDICTION), 0.0).when(grain == TRACE, trace_tolerance).otherwise(score_tolerance)
    wrong = both & (undecided_fails((off > limit) | F.isnan(off)) | (F.col("nf") > 1) | (F.col("ns") > 1))
    lone = ~both & (grain == TRACE)
    judged = met.select(*key, grain, "b", off.alias("off"), wrong.alias("wrong"), lone.alias("lone"), F.col("nf").alias("nf"), F.col("ns").alias("ns"))
    is_ = lambda g: F.col("grain") == g
    failed = lambda g: F.bool_or(is_(g) & (F.col("wrong") | F.col("lone")))
    worst = lambda *g: F.max(F.when(F.col("grain").isin(*g), F.col("off")))
    per = judged.groupBy(*key).agg(
        F.bool_or(is_(PREDICTION) & (F.col("nf") > 0)).alias("in_fresh"), F.bool_or(is_(PREDICTION) & (F.col("ns") > 0)).alias("in_stored"),
        failed(PREDICTION).alias("candidate_prediction"), *[F.bool_or(is_(SCALAR) & (F.col("b") == k) & F.col("wrong")).alias(c) for k, c in enumerate(columns)],
        failed(TRACE).alias("trace_metrics"), F.bool_or(is_(REPLACED) & (F.col("nf") == 0)).alias("missing_patch_scores"), failed(REPLACED).alias("patch_scores"),
        failed(REPLACED_PREDICTION).alias("patch_predictions"), failed(CONTROL).alias("positive_controls"),
        worst(SCALAR).alias("max_score_difference"), worst(TRACE).alias("max_trace_difference"), worst(REPLACED).alias("max_patch_difference"), worst(CONTROL).alias("max_control_difference"),
    )
    names = ["candidate_prediction", *columns, "trace_metrics", "missing_patch_scores", "patch_scores", "patch_predictions", "positive_controls"]
    listed = F.array_join(F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]), lambda n: n.isNotNull()), ",")
    shown = F.when(~F.col("in_fresh"), "missing_fresh").when(~F.col("in_stored"), "missing_stored").otherwise(listed)
    return per.select(*key, shown.alias("failed"), "max_score_difference", "max_trace_difference", "max_patch_difference", "max_control_difference")


def replacement_coverage(requested: DataFrame, patches: DataFrame, chunk: str, stages: int, classes: int) -> DataFrame:
    """R7, replacements: per chunk whether the stored ones are exactly the requested candidates, at every stage, in every class.

    ``patches`` are (chunk, source_id, cand, stage, patch_scores). A row becomes a bitmap of the classes it has finite values for, a
    candidate one of the stages it has and one of the stages whose classes are all there; these are compared as bits, so up to 62 of
    each. ``partial`` lacks a stage, ``misshapen`` has one with another number of classes, a value that is not finite, or beyond the last stage.
    """
    if not (0 < stages < 63 and 0 < classes < 63):
        raise ValueError("bitmaps hold up to 62 stages and classes")
    key, one = [chunk, "source_id", "cand"], F.lit(1).cast("long")
    number = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))
    bits = F.aggregate(
        F.transform(F.slice("patch_scores", 1, 62), lambda v, i: F.when(number(v), F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y),
    )
    known = F.col("stage").between(0, stages - 1)
    whole = (F.size("patch_scores") == classes) & (bits == (1 << classes) - 1)
    stage_bit = F.when(known, F.call_function("shiftleft", one, F.col("stage").cast("int"))).otherwise(F.lit(0).cast("long"))
    held = patches.groupBy(*key).agg(
        F.bit_or(stage_bit).alias("present"), F.bit_or(F.when(known & F.coalesce(whole, F.lit(False)), stage_bit).otherwise(F.lit(0).cast("long"))).alias("whole"),
        F.bool_or(~F.coalesce(known, F.lit(False))).alias("beyond"),
    )
    joined = requested.select(*key, F.lit(True).alias("asked")).join(held, key, "full_outer")
    asked, there, every = F.col("asked").isNotNull(), F.col("present").isNotNull(), (1 << stages) - 1
    return joined.groupBy(chunk).agg(
        F.count_if(asked).alias("requested"), F.count_if(there).alias("stored"), F.count_if(asked & ~there).alias("missing"), F.count_if(~asked).alias("unexpected"),
        F.count_if(there & (F.col("present") != every)).alias("partial"), F.count_if(there & ((F.col("whole") != F.col("present")) | F.col("beyond"))).alias("misshapen"),
    ).withColumn("complete", (F.col("missing") + F.col("unexpected") + F.col("partial") + F.col("misshapen")) == 0)


def coverage_check(requested: DataFrame, stored: DataFrame, chunk: str, width: int) -> DataFrame:
    """Per chunk whether the stored outputs are exactly the requested candidates with score arrays
    of the right length and finite values."""
    left = requested.select(chunk, "source_id", "cand", F.lit(1).alias("asked"))
    right = stored.select(chunk, "source_id", "cand", F.col("scores").alias("got"))
    joined = left.join(right, [chunk, "source_id", "cand"], "full_outer")
    finite = ~F.exists("got", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return joined.groupBy(chunk).agg(
        F.count_if(F.col("asked").isNotNull()).alias("requested"),
        F.count_if(F.col("got").isNotNull()).alias("stored"),
        F.count_if(F.col("got").isNull()).alias("missing"),
        F.count_if(F.col("asked").isNull()).alias("unexpected"),
        F.count_if(F.col("got").isNotNull() & ((F.size("got") != width) | ~finite)).alias("invalid"),
    ).withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("invalid") == 0))


def validate_candidates(stored: DataFrame, cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored candidates against a fresh enumeration of their inputs, as violation counts."""
    fresh = enumerate_moves(cells).select(
        "source_id", "cand", F.struct("from_bin", "to_bin", "feature", "multiplicity", "horizon").alias("f")
    )
    columns = ["from_bin", "to_bin", "feature", "multiplicity", "direction", "label", "clean_prediction"]
    kept = stored.select("source_id", "cand", F.struct(*columns).alias("s"))
    joined = fresh.join(kept, ["source_id", "cand"], "full_outer")
    both = F.col("f").isNotNull() & F.col("s").isNotNull()
    rules = {
        "missing": F.col("s").isNull(),
        "unexpected": F.col("f").isNull(),
        "coordinates": both & (
            (F.col("s.from_bin") != F.col("f.from_bin")) | (F.col("s.to_bin") != F.col("f.to_bin")) | (F.col("s.feature") != F.col("f.feature"))
        ),
        "multiplicity": both & (F.col("s.multiplicity") != F.col("f.multiplicity")),
        "not_adjacent": F.col("s").isNotNull() & (F.abs(F.col("s.to_bin") - F.col("s.from_bin")) != 1),
        "direction": F.col("s").isNotNull() & (F.col("s.to_bin") - F.col("s.from_bin") != F.col("s.direction")),
    }
    counted = joined.groupBy("source_id").agg(
        *[F.count_if(undecided_fails(r)).alias(n) for n, r in rules.items()],
        F.min("s.label").alias("l0"), F.max("s.label").alias("l1"), F.min("s.clean_prediction").alias("p0"), F.max("s.clean_prediction").alias("p1"),
        F.count_if(F.col("s").isNotNull()).alias("n"), F.max(F.when(F.col("s").isNotNull(), F.col("cand"))).alias("last"),
    )
    facts = sources.select("source_id", F.col("label").alias("label"), F.col("clean_prediction").alias("clean"))
    per_source = counted.join(facts, "source_id", "left")
    source_rules = {
        "label": ~(F.col("l0").eqNullSafe(F.col("label")) & F.col("l1").eqNullSafe(F.col("label"))),
        "clean_prediction": ~(F.col("p0").eqNullSafe(F.col("clean")) & F.col("p1").eqNullSafe(F.col("clean"))),
        "index_not_dense": F.col("last") != F.col("n") - 1,
    }
    row = per_source.agg(*[F.sum(n).alias(n) for n in rules], *[F.count_if(undecided_fails(r)).alias(n) for n, r in source_rules.items()])
    return as_checks(row, [*rules, *source_rules])


def as_checks(row: DataFrame, names: Sequence[str]) -> DataFrame:
    lines = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("violations")) for n in names])
    return row.select(F.explode(lines).alias("l")).select("l.*")


def rebuild_check(a: DataFrame, b: DataFrame, stored: DataFrame, labels: DataFrame, stored_labels: DataFrame) -> DataFrame:
    """Two binnings and the stored cells are the same bag of rows; labels agree.

    The three bags meet in one aggregation on the cell, instead of pairwise differences. They hardly shrink in it, so
    they are dealt to a number of tasks that grows with the stored cells, and nothing is aggregated before.
    """
    key = ["source_id", "horizon", "t", "f", "n"]
    tagged = None
    for i, df in enumerate((a, b, stored)):
        part = df.select(*key, *[F.lit(1 if i == j else 0).alias(f"in{j}") for j in range(3)])
        tagged = part if tagged is None else tagged.unionByName(part)
    tagged = fan_out(tagged, 3 * stored.count(), *key)
    cells = tagged.groupBy(*key).agg(*[F.sum(f"in{j}").alias(f"in{j}") for j in range(3)])
    row = cells.agg(
        F.count_if(F.col("in0") != F.col("in1")).alias("implementations_differ"),
        F.count_if(F.col("in0") != F.col("in2")).alias("stored_cells_differ"),
    )
    mismatched = (
        labels.select("source_id", F.col("label").alias("x"))
        .join(stored_labels.select("source_id", F.col("label").alias("y")), "source_id", "full_outer")
        .agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("labels_differ"))
    )
    return as_checks(row.join(F.broadcast(mismatched)), ["implementations_differ", "stored_cells_differ", "labels_differ"])


def undecided_fails(rule: Column) -> Column:
    """A violation that is NULL has not been ruled out."""
    return F.coalesce(rule, F.lit(True))


def invariant_suite(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Rows (check, violations) for named predicates that must never hold on their table.

    Each table is scanned once for all checks on it. A rule that NULL leaves undecided counts as broken.
    """
    tables: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for name, (df, violation) in checks.items():
        tables.setdefault(id(df), (df, []))[1].append((name, violation))
    out = None
    for df, rules in tables.values():
        row = df.agg(*[F.count_if(undecided_fails(rule)).alias(name) for name, rule in rules])
        part = as_checks(row, [name for name, _ in rules])
        out = part if out is None else out.unionByName(part)
    return out


def require_clean(checks: DataFrame) -> None:
    """Fail loudly with the number of violated checks and the first 50 of them."""
    broken = checks.where(undecided_fails(F.col("violations") > 0))
    shown = broken.orderBy("check").limit(50).collect()
    if shown:
        raise ValueError(f"{broken.count()} checks broken: " + "; ".join(f"{r['check']}: {r['violations']}" for r in shown))


def contract_check(contracts: DataFrame, payload: Sequence[str], outputs: DataFrame, files: DataFrame) -> DataFrame:
    """Per artifact whether its contract hashes to the stored id, its output carries that id and
    its upstream file still has the digest the contract names.

    ``contracts`` are (artifact, <payload>, contract_id, upstream, upstream_sha256).
    """
    from jostle.functions.hashing import canonical_hash

    hashed = contracts.withColumn("__hash", canonical_hash(payload))
    joined = hashed.join(outputs.select("artifact", F.col("contract_id").alias("__out")), "artifact", "left").join(
        files.select(F.col("path").alias("upstream"), F.col("sha256").alias("__now")), "upstream", "left"
    )
    same = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) == F.col(b))
    return joined.select(
        "artifact", same("__hash", "contract_id").alias("contract_ok"), same("__out", "contract_id").alias("output_ok"),
        same("__now", "upstream_sha256").alias("upstream_ok"),
    )


def census_invariants(
    moves: DataFrame, cells: DataFrame, sources: DataFrame, traces: DataFrame, patches: DataFrame,
    classes: int, width: int, stages: int, metrics: int, exact_stages: Sequence[int],
) -> DataFrame:
    """The constraints a complete census must satisfy, as (check, violations).

    Row-level rules take one scan per table; the rules across rows and tables are aggregates on the
    source or candidate key.
    """
    finite = lambda a: ~F.exists(a, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    in_classes = lambda c: F.col(c).between(0, classes - 1)
    s, cs = F.col("scores"), F.col("clean_scores")
    code, changed = F.col("transition_code"), F.col("candidate_prediction") != F.col("clean_prediction")
    right = F.col("clean_prediction") == F.col("label")
    last = F.col("horizon") - 1
    row_rules = {
        "candidate_label_range": (moves, ~in_classes("label")),
        "candidate_clean_range": (moves, ~in_classes("clean_prediction")),
        "candidate_prediction_range": (moves, ~in_classes("candidate_prediction")),
        "candidate_scores_finite": (moves, ~finite("scores")),
        "candidate_scores_width": (moves, F.size(s) != classes),
        "candidate_argmax_stored": (moves, S.predict(s) != F.col("candidate_prediction")),
        "clean_argmax_stored": (moves, S.predict(cs) != F.col("clean_prediction")),
        "code_range": (moves, ~code.between(0, 3)),
        "code_preserved": (moves, (code == 0) != ~changed),
        "code_adverse": (moves, (code == 1) != (changed & right)),
        "code_corrective": (moves, (code == 2) != (changed & ~right & (F.col("candidate_prediction") == F.col("label")))),
        "code_lateral": (moves, (code == 3) != (changed & ~right & (F.col("candidate_prediction") != F.col("label")))),
        "move_adjacent": (moves, F.abs(F.col("to_bin") - F.col("from_bin")) != 1),
        "move_direction": (moves, F.col("to_bin") - F.col("from_bin") != F.col("direction")),
        "move_from_range": (moves, ~F.col("from_bin").between(0, last)),
        "move_to_range": (moves, ~F.col("to_bin").between(0, last)),
        "move_feature_range": (moves, ~F.col("feature").between(0, width - 1)),
        "move_multiplicity_positive": (moves, F.col("multiplicity") < 1),
        "margin_sign": (moves, (S.target_margin(s, F.col("candidate_prediction").cast("int")) < 0)),
        "cell_count_positive": (cells, F.col("n") < 1),
        "cell_count_storable": (cells, F.col("n") > 65535),
        "cell_time_range": (cells, ~F.col("t").between(0, last)),
        "cell_feature_range": (cells, ~F.col("f").between(0, width - 1)),
        "source_horizon_positive": (sources, F.col("horizon") < 1),
        "source_scores_finite": (sources, ~finite("scores")),
        "source_scores_width": (sources, F.size(s) != classes),
        "source_label_range": (sources, ~in_classes("label")),
        "source_argmax_stored": (sources, S.predict(s) != F.col("clean_prediction")),
        "source_margin_rederived": (sources, S.top_margin(s) != F.col("clean_margin")),
        "source_correct_flag": (sources, F.col("clean_correct") != right),
        "trace_missing": (traces, F.col("value").isNull()),
        "trace_finite": (traces, F.isnan("value") | (F.abs("value") == float("inf"))),
        "trace_stage_range": (traces, ~F.col("stage").between(0, stages - 1)),
        "trace_metric_range": (traces, ~F.col("metric").between(0, metrics - 1)),
        "patch_only_changed": (patches, code == 0),
        "patch_scores_finite": (patches, ~finite("patch_scores")),
        "patch_argmax_stored": (patches, S.predict(F.col("patch_scores")) != F.col("patch_prediction")),
        "patch_control_exact": (
            patches, F.col("stage").isin(list(exact_stages)) & (S.linf_change(F.col("patch_scores"), cs) != 0)
        ),
    }
    rows = invariant_suite(row_rules)
    per_source = (
        cells.groupBy("source_id").agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("nonzero"),
            F.count_if(F.col("t") == 0).alias("first"), F.count_if(F.col("t") == last).alias("final"),
        )
        .join(
            moves.groupBy("source_id").agg(
                F.count(F.lit(1)).alias("candidates"), F.min("cand").alias("low"), F.max("cand").alias("high"),
                F.count_if(code != 0).alias("changed"),
            ), "source_id", "full_outer",
        )
        .join(sources.select("source_id", "input_count", F.lit(1).alias("known")), "source_id", "full_outer")
        .join(patches.groupBy("source_id").agg(F.count(F.lit(1)).alias("patched")), "source_id", "left")
        .join(traces.groupBy("source_id").agg(F.count(F.lit(1)).alias("traced")), "source_id", "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    across = invariant_suite({
        "source_unknown": (per_source, F.col("known").isNull()),
        "source_input_count": (per_source, ~F.col("total").eqNullSafe(F.col("input_count"))),
        "source_cardinality": (per_source, zero("candidates") != 2 * zero("nonzero") - zero("first") - zero("final")),
        "candidate_index_dense": (per_source, (zero("candidates") > 0) & ((F.col("low") != 0) | (F.col("high") != F.col("candidates") - 1))),
        "patch_coverage": (per_source, zero("patched") != stages * zero("changed")),
        "trace_coverage": (per_source, zero("traced") != stages * metrics * zero("candidates")),
    })
    return rows.unionByName(across)
