"""Binning, enumeration and application of moves on hand-made inputs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from jostle.operators import events as E
from jostle.operators import moves as M
from jostle.plans.staging import stage

EV = "source_id long, us long, unit long"


def test_event_on_the_final_boundary_stays_in_the_last_bin(rows, table):
    ev = rows(EV, [(1, 0, 0), (1, 5000, 0), (1, 10000, 0)])
    cells = E.bin_events(ev, E.event_bounds(ev, 5000), 5000)
    assert table(cells, "t") == [(1, 2, 0, 0, 1), (1, 2, 1, 0, 2)]


def test_time_is_relative_to_the_first_event(rows, table):
    ev = rows(EV, [(1, 1_000_003, 0), (1, 1_000_003 + 4999, 0), (1, 1_000_003 + 5000, 0), (1, 1_000_003 + 5001, 0)])
    cells = E.bin_events(ev, E.event_bounds(ev, 5000), 5000)
    assert table(cells, "t") == [(1, 2, 0, 0, 2), (1, 2, 1, 0, 2)]


def test_units_are_grouped_into_features(rows, table):
    ev = rows(EV, [(1, 0, u) for u in (0, 4, 5, 699)])
    cells = E.bin_events(ev, E.event_bounds(ev, 5), 5, units_per_feature=5)
    assert table(cells.select("f", "n"), "f") == [(0, 2), (1, 1), (139, 1)]


def test_source_without_events_has_one_empty_bin(rows, table):
    ev = rows(EV, [(1, 0, 0)])
    sources = rows("source_id long", [(1,), (2,)])
    bounds = E.event_bounds(ev, 5, sources)
    assert table(bounds.select("source_id", "horizon"), "source_id") == [(1, 1), (2, 1)]
    dense = E.densify(E.bin_events(ev, bounds, 5), bounds, 2)
    assert table(dense, "source_id", "f") == [(1, 1, 0, 0, 1), (1, 1, 0, 1, 0), (2, 1, 0, 0, 0), (2, 1, 0, 1, 0)]


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "salts": 5}])
def test_both_binnings_agree_on_random_events_with_a_hot_source(spark, how):
    ev = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("source_id"),
        (F.abs(F.xxhash64("id")) % 1_000_000).alias("us"), (F.col("id") % 9).alias("unit"),
    )
    a = E.bin_events(ev, stage(E.event_bounds(ev, 7001), "b"), 7001, **how)
    b = E.bin_events_oracle(ev, 7001, **how)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert a.agg(F.sum("n")).first()[0] == 20000


def test_validate_events_counts_each_violation(rows, table, monkeypatch):
    ev = rows("source_id long, us long, unit long, seq long", [
        (1, 10, 0, 0), (1, 9, 0, 1), (1, 20, 700, 2), (1, None, -1, 3), (2, 5, 1, 0), (2, 5, 2, 1), (2, 4, 2, 2), (2, 9, 2, 3),
    ])
    assert table(E.validate_events(ev, 700, "seq"), "source_id") == [(1, 4, 1, 2, 1), (2, 4, 0, 0, 1)]
    # the same with every event in a block of its own
    assert table(E.validate_events(ev, 700, "seq", block_rows=1), "source_id")[1] == (2, 4, 0, 0, 1)


def test_validate_counts(rows, table):
    values = rows("k string, v double", [("a", 1.0), ("a", -1.0), ("a", 1.5), ("a", 65536.0), ("a", float("nan")), ("a", None), ("a", 65535.0)])
    assert table(E.validate_counts(values, "v", ["k"])) == [("a", 7, 1, 1, 1, 1, 1)]


CELLS = "source_id long, horizon long, t long, f long, n long"


def column_cells(rows):
    return rows(CELLS, [(1, 3, 0, 2, 3), (1, 3, 1, 2, 2)])


def test_enumeration_order_and_multiplicity(rows, table):
    moves = M.enumerate_moves(M.index_cells(column_cells(rows)))
    assert table(moves.select("cand", "from_bin", "to_bin", "multiplicity"), "cand") == [(0, 0, 1, 3), (1, 1, 0, 2), (2, 1, 2, 2)]


def test_indices_are_dense_across_blocks(spark):
    cells = spark.range(5000).select(
        (F.col("id") % 2).alias("source_id"), F.lit(2500).cast("long").alias("horizon"), F.floor(F.col("id") / 2).alias("t"),
        F.lit(0).cast("long").alias("f"), F.lit(1).cast("long").alias("n"),
    )
    moves = M.enumerate_moves(M.index_cells(cells))
    per_source = moves.groupBy("source_id").agg(F.count("*"), F.count_distinct("cand"), F.min("cand"), F.max("cand")).collect()
    assert sorted(tuple(r) for r in per_source) == [(0, 4998, 4998, 0, 4997), (1, 4998, 4998, 0, 4997)]
    steps = moves.select("source_id", "cand", (F.col("from_bin") * 10 + F.col("direction")).alias("key"))
    from pyspark.sql import Window

    order = Window.partitionBy("source_id").orderBy("cand")
    assert steps.withColumn("p", F.lag("key").over(order)).where("p >= key").isEmpty()
    closed = M.neighborhood_cardinality(cells).select("candidates").distinct().collect()
    assert [tuple(r) for r in closed] == [(4998,)]


def test_apply_move_changes_two_cells_and_keeps_the_total(rows, table):
    cells = column_cells(rows)
    moves = M.enumerate_moves(M.index_cells(cells)).where("from_bin = 0")
    moved = M.apply_move(moves, cells)
    assert table(moved.select("t", "before", "after"), "t") == [(0, 3, 2), (1, 2, 3)]


@pytest.mark.parametrize("cell_counts, change", [
    ([(1, 3, 0, 2, 3), (1, 3, 1, 2, 65535)], {}), ([(1, 3, 1, 2, 2)], {}), ([(1, 3, 0, 2, 3)], {"to_bin": 2}),
])
def test_apply_move_rejects_overflow_absent_counts_and_long_moves(rows, cell_counts, change):
    moves = M.enumerate_moves(M.index_cells(column_cells(rows))).where("from_bin = 0").withColumns({c: F.lit(v).cast("long") for c, v in change.items()})
    with pytest.raises(PySparkException):
        M.apply_move(moves, rows(CELLS, cell_counts)).collect()


def test_batch_groups_last_one_short(rows, table):
    df = rows("rank long, horizon long", [(0, 5), (1, 7), (2, 4)])
    assert table(M.batch_groups(df, "rank", "horizon", size=2), "rank") == [(0, 5, 0, 7, 2), (1, 7, 0, 7, 0), (2, 4, 1, 4, 0)]


def test_select_panel_meets_quotas_and_repeats(spark):
    sources = spark.range(300).select(F.col("id").alias("source_id"), (F.col("id") % 3).alias("label"))
    quotas = spark.createDataFrame([(0, 2), (1, 3), (2, 2)], "label long, quota int")
    first = M.select_panel(sources, "label", quotas, 7, 3)
    counts = {r["label"]: r["count"] for r in first.groupBy("label").count().collect()}
    assert counts == {0: 2, 1: 3, 2: 2}
    again = M.select_panel(sources.repartition(13), "label", quotas, 7, 3)
    assert first.select("source_id").exceptAll(again.select("source_id")).isEmpty()
    assert not first.select("source_id").exceptAll(M.select_panel(sources, "label", quotas, 8, 3).select("source_id")).isEmpty()


@pytest.mark.parametrize("how", [{}, {"group_rows": 0, "ranges": 3}])
def test_select_controls_are_evenly_spaced(spark, how):
    df = spark.range(200).select(F.col("id").alias("source_id"), (F.col("id") % 50 == 0).alias("changed"), F.lit(1).alias("gap"))
    chosen = M.select_controls(df, "changed", "gap", k=8, **how)
    controls = sorted(r[0] for r in chosen.where("role = 'control'").collect())
    import numpy as np

    eligible = [i for i in range(200) if i % 50]
    assert controls == [eligible[i] for i in np.unique(np.linspace(0, len(eligible) - 1, 8, dtype=int))]
    assert chosen.where("role = 'changed'").count() == 4


def test_select_pairs_wrap_around(rows, table):
    df = rows("source_id long, batch long, padded_horizon long, changed boolean", [
        (0, 0, 9, False), (1, 0, 9, True), (2, 0, 9, False), (3, 1, 8, False), (4, 1, 8, True),
    ])
    assert table(M.select_pairs(df, "changed", "batch"), "batch") == [(0, 1, 2, 9), (1, 4, 3, 8)]


def test_fingerprints_follow_the_content(rows):
    a = rows(CELLS, [(1, 3, 0, 2, 3), (1, 3, 1, 2, 2), (2, 3, 0, 2, 3)])
    b = rows(CELLS, [(2, 3, 0, 2, 4), (1, 3, 1, 2, 2), (1, 3, 0, 2, 3)])
    get = lambda df: {r["source_id"]: r["fingerprint"] for r in E.content_fingerprint(df).collect()}
    assert get(a)[1] == get(b)[1] and get(a)[2] != get(b)[2]
