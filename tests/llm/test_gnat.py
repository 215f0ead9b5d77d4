"""Hard negatives by the tree against a comparison of all rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from jostle.llm import gnat as G

SCHEMA = "vec_id long, embedding array<double>, label int, row int, leaf string"
OUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, every=5):
    own = []
    for i, v, label, *_ in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for n, (i, v, label) in enumerate(own):
        if i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for m, (j, w, other) in enumerate(own) if m != n]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for score, j, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 80 * score <= 100 * s[0] <= 100 * score][:5]
            out += [(i, j, k + 1, s[1], score, s[0]) for k, s in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **how):
    anchors = F.pmod("vec_id", F.lit(5)) == 0
    out = G.hard_negatives(spark.createDataFrame(rows, SCHEMA), anchors, F.col("label"), **how)
    return sorted(tuple(r[c] for c in OUT) for r in out.collect())


SMALL = {"fanout": 3, "leaf_rows": 8, "chunk_rows": 5, "block_queries": 4}


def clustered(n, dims, seed):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    return [(k, [c + r.gauss(0, 0.1) for c in r.choice(centres)], r.randrange(3), 0, "x") for k in range(n)]


def test_mining_equals_all_rows(spark):
    rows = clustered(160, 6, 1)
    assert mined(spark, rows, **SMALL) == plain(rows) and len(plain(rows)) > 100


def test_odd_rows_copies_and_ties(spark):
    rows = clustered(60, 4, 2)
    rows += [(200 + k, rows[3][1], k % 2, 0, "x") for k in range(30)]  # copies with two labels, more than a chunk
    rows += [rows[0], rows[5], (5, rows[6][1], 1, 0, "x")]  # repeated rows and ids
    rows += [(300, [0.0] * 4, 1, 0, "x"), (301, None, 1, 0, "x"), (302, [1.0, None, 0.0, 0.0], 1, 0, "x"), (305, [float("nan")] * 4, 1, 0, "x")]
    rows += [(306, [float("inf"), 0.0, 0.0, 0.0], 1, 0, "x"), (310, [0.1] * 4, None, 0, "x"), (None, [0.2] * 4, 1, 0, "x")]
    assert mined(spark, rows, **SMALL) == plain(rows)


def test_huge_components_are_exact(spark):
    r = random.Random(4)
    rows = [(k, [r.uniform(0, 2.0**21) for _ in range(3)], r.randrange(2), 0, "x") for k in range(40)]
    assert mined(spark, rows, **SMALL) == plain(rows)


def test_no_rows_one_row_and_lone_labels(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1, 0, "x")]) == [] and mined(spark, [(0, [], 1, 0, "x")]) == []
    rows = [(k, [1.0 + k / 10, 0.5], k, 0, "x") for k in range(12)]  # no positives at all
    assert mined(spark, rows, **SMALL) == []


def test_ranges_rule_leaves_out():
    r = np.random.default_rng(0)
    centres = r.normal(size=(20, 8)) * 2000
    points = np.rint((centres[:, None] + r.normal(size=(20, 100, 8)) * 20).reshape(-1, 8))
    squared = float((points**2).sum(axis=1).max())
    lifted = G.raised(points, squared)
    tree = G.Tree.grown(lifted[::7], 2, 6)
    leaf = tree.descend(lifted, watch=True)
    seen = []
    for q in range(0, 2000, 50):
        scores = points @ points[q]
        low, high = np.quantile(scores, [0.985, 0.999])
        inner, outer = G.annulus(points[q], squared, np.array([low]), np.array([high]))
        open_ = tree.visited(np.append(points[q], 0.0), inner, outer, G.slack(points[q], squared))
        assert set(leaf[(scores >= low) & (scores <= high)]) <= set(open_)
        seen.append(len(open_))
    assert tree.leaves > 15 and np.mean(seen) < tree.leaves / 3
