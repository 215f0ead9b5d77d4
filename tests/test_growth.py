"""Work that must not grow faster than the input, seen in plans and counts."""

import time

from pyspark.sql import functions as F

from jostle.catalog import fixtures as X
from jostle.catalog import load
from jostle.operators import documents as D
from jostle.operators import intervals
from jostle.operators import scoring as SC
from jostle.plans import staging

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_outputs_are_not_shuffled(spark):
    X.forget()
    above = plan_of(load().QUERIES["compare_outputs"](spark, SF)).split("Union")[0]
    assert above.count("Exchange") == 1 and "Exchange hashpartitioning(failed" in above  # only the few kinds of failure


def test_many_paths_into_a_long_list(spark):
    """6,000 selectors of 6,000 items: 36 million pairs, of which 6,000 (and the half that shares a flag) must not be formed one by one."""
    items = spark.range(6000).select(F.col("id"), (F.col("id") % 2 == 0).alias("even"), (F.col("id") * 3).alias("v"))
    paths = items.select(F.explode(F.array(
        F.format_string("rows[even=TRUE,id=%d].v", "id"), F.format_string("rows[%d].v", "id"), F.format_string("rows[id=%d].none", "id"),
    )).alias("path"))
    start = time.monotonic()
    got = D.resolve_paths(D.document_nodes(items, "rows", ["id"]), paths).groupBy("status").agg(F.count(F.lit(1)), F.sum("number")).collect()
    every = 3 * 6000 * 5999 // 2
    assert {r[0]: (r[1], r[2]) for r in got} == {"FOUND": (9000, 3 * 3000 * 2999 + every), "MISSING": (9000, None)}
    assert time.monotonic() - start < 150


def test_gradients_come_by_span(rows):
    """130 bins are 5 rows to shuffle at the ends of spans, not one or three a bin; repeated, absent and null cells as before."""
    cells = [(1, t, 0, [float(t * t), None]) for t in range(130) if t != 70] + [(1, 64, 0, [0.0, None]), (1, 90, 0, None)]
    gradients = rows("source_id long, t long, f long, g array<double>", [c for c in cells if c[1] != 90 or c[3] is None])
    held = {r["span"]: len(r["bins"]) for r in SC.spans(gradients).collect()}
    assert held == {0: 66, 1: 66, 2: 3, -1: 1}
    ends = [(63, 64), (64, 63), (127, 128), (128, 127), (69, 70), (71, 70), (89, 90), (129, 130), (0, 1), (5, 7)]
    moves = rows("source_id long, cand long, from_bin long, to_bin long, feature long", [(1, k, a, b, 0) for k, (a, b) in enumerate(ends)])
    got = {r["cand"]: r["gains"] for r in SC.gradient_moves(moves, gradients).collect()}
    assert {k: g and g[0] for k, g in got.items()} == {0: 127.0, 1: -127.0, 2: 255.0, 3: -255.0, 4: None, 5: None, 6: None, 7: None, 8: 1.0, 9: None}


def test_files_are_read_in_parts_that_a_task_can_sort(spark):
    load().QUERIES["canonical_hash"](spark, SF)
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= 16 * 1024 * 1024


def test_pairs_with_ranges_are_spread(spark, rows, monkeypatch):
    """3,000 values in 100 ranges: one small file of values, but 300,000 pairs, which one task must not make."""
    for where in (intervals, staging):
        monkeypatch.setattr(where, "ROWS_PER_TASK", 10_000)
    values = spark.range(3000).select(F.col("id"), (F.col("id") % 5).cast("double").alias("v")).coalesce(1)
    ranges = spark.range(100).select(F.col("id").alias("r"), F.lit(None).cast("double").alias("lo"), F.lit(9.0).alias("hi")).coalesce(1)
    for size in (None, 0):
        made, staged_ = [], intervals.staged
        monkeypatch.setattr(intervals, "staged", lambda df, name: made.append(name == "met" and df.select(F.spark_partition_id()).distinct().count()) or staged_(df, name))
        out = intervals.interval_join(values, "v", ranges, broadcast_bytes=size)
        monkeypatch.setattr(intervals, "staged", staged_)
        assert out.count() == 300_000 and out.distinct().count() == 300_000 and max(made) > 4


def test_witnesses_meet_after_both_sides_are_written(spark):
    X.forget()
    plan = plan_of(load().QUERIES["witness_check"](spark, SF))
    assert "Window" not in plan and "/recorded-" in plan and "/recomputed-" in plan
