"""Positions, ranks and percentiles are the same whether a group fits one task or is cut into ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jostle.operators import inference as I
from jostle.plans.joins import attach
from jostle.plans.ordering import midranks, percentiles, running
from jostle.plans.staging import stage

WAYS = [{}, {"group_rows": 0, "ranges": 5}]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with two thirds of the rows, a value with heavy ties, a unique id."""
    return stage(
        spark.range(3000).select(
            F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("k"),
            F.when(F.col("id") % 2 == 0, 0).otherwise(F.abs(F.xxhash64("id")) % 40).cast("double").alias("v"), F.col("id").alias("i"),
        ), "skewed",
    )


@pytest.mark.parametrize("how", WAYS)
def test_running_positions(skewed, how):
    got = running(skewed, ["k"], [F.col("v").desc(), F.col("i").asc()], out="p", **how).toPandas()
    want = skewed.toPandas().sort_values(["k", "v", "i"], ascending=[True, False, True])
    want["p"] = want.groupby("k").cumcount() + 1
    merged = got.merge(want, on="i")
    assert len(got) == 3000 and (merged["p_x"] == merged["p_y"]).all()


@pytest.mark.parametrize("how", WAYS)
def test_midranks(skewed, how):
    got = {(r["k"], r["v"]): r["rank"] for r in midranks(skewed, ["k"], "v", **how).collect()}
    pdf = skewed.toPandas()
    pdf["r"] = pdf.groupby("k")["v"].rank()
    assert got == {(k, v): r for k, v, r in pdf[["k", "v", "r"]].drop_duplicates().itertuples(index=False)}


@pytest.mark.parametrize("how", WAYS)
def test_percentiles_interpolate_like_numpy(skewed, how):
    got = {r["k"]: (r["a"], r["b"]) for r in percentiles(skewed, ["k"], "v", [("a", 0.25), ("b", 0.975)], **how).collect()}
    pdf = skewed.toPandas()
    for k, group in pdf.groupby("k"):
        assert got[k] == pytest.approx(tuple(np.percentile(group["v"], [25, 97.5])))
    overall = percentiles(skewed, [], "v", [("m", 0.5)], **how).first()["m"]
    assert overall == np.median(pdf["v"])


@pytest.mark.parametrize("broadcast", [None, 0])
def test_attach_keeps_every_row(skewed, spark, broadcast):
    lookup = stage(spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x")), "lookup")
    joined = attach(skewed, lookup, ["k"], spread=F.col("i"), broadcast_bytes=broadcast, salts=4)
    assert joined.count() == 3000 and joined.where("x <> k * 10").isEmpty() and "__salt" not in joined.columns


def test_average_rank_of_ties(rows):
    df = rows("id long, v double", [(0, 3.0), (1, 1.0), (2, 1.0), (3, 5.0)])
    assert {r["id"]: r["rank"] for r in I.average_rank(df, [], "v").collect()} == {0: 3.0, 1: 1.5, 2: 1.5, 3: 4.0}


@pytest.mark.parametrize("how", WAYS)
def test_spearman_matches_pandas_and_is_null_when_undefined(skewed, rows, how):
    df = skewed.withColumn("w", F.pmod(F.col("i") * 7919, F.lit(13)).cast("double"))
    got = {r["k"]: r["rho"] for r in I.spearman(df, ["k"], "v", "w", **how).collect()}
    for k, g in df.toPandas().groupby("k"):
        rank = g[["v", "w"]].rank()
        assert got[k] == pytest.approx(np.corrcoef(rank["v"], rank["w"])[0, 1])
    small = rows("x double, y double", [(1.0, 2.0), (2.0, 3.0)])
    flat = rows("x double, y double", [(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)])
    assert I.spearman(small, [], "x", "y").first()["rho"] is None
    assert I.spearman(flat, [], "x", "y").first()["rho"] is None


def test_partition_count_does_not_change_results(spark, skewed):
    def result(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        values = skewed.groupBy("k").agg(F.avg("v").alias("x")).withColumnRenamed("k", "source_id")
        return [tuple(r) for r in I.signflip_test(values, "x", 50, 5).collect()]

    try:
        assert result(1)[0] == pytest.approx(result(8)[0], rel=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
