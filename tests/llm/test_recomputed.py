"""The classifier and the mixture, recomputed plainly."""

import collections
import math
import random
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from jostle.llm import nbsvm, raking


def labelled_texts(n):
    r = random.Random(8)
    words = {1: ["calm", "river", "Tale", "of", "the"], 0: ["BUY", "now", "77", "click", "the"]}
    return [(" ".join(r.choice(words[k % 2 if r.random() < 0.9 else 1 - k % 2]) for _ in range(r.randrange(3, 30))), k % 2) for k in range(n)] + [("", 1), (None, 0)]


def test_class_ratios_are_the_smoothed_log_ratios(spark):
    rows = labelled_texts(60)
    got = nbsvm.class_ratios(spark.createDataFrame(rows, "text string, label int"))
    counts, cache = {0: collections.Counter(), 1: collections.Counter()}, nbsvm._features()
    for text, label in rows:
        counts[label].update(set(nbsvm.indicators(text or "", cache).tolist()))
    norm = {k: nbsvm.SMOOTHING * nbsvm.BUCKETS + sum(c.values()) for k, c in counts.items()}
    for bucket in [*counts[0], *counts[1], *range(0, nbsvm.BUCKETS, 9973)]:
        want = math.log((counts[1][bucket] + nbsvm.SMOOTHING) / norm[1]) - math.log((counts[0][bucket] + nbsvm.SMOOTHING) / norm[0])
        assert abs(got[bucket] - want) < 1e-9


def test_scores_are_the_logistic_of_the_margin(spark):
    rows = labelled_texts(80)
    model = nbsvm.fit(spark.createDataFrame(rows, "text string, label int"))
    cache, texts = nbsvm._features(), [t for t, _ in rows]
    scored = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").select("k", nbsvm.score(F.col("text"), model).alias("s"))
    for r in scored.collect():
        items = nbsvm.indicators(texts[r["k"]] or "", cache).tolist()
        length = math.sqrt(sum(model.weights[0][i] ** 2 for i in items)) or 1e-12
        margin = sum(model.weights[0][i] / length * model.weights[1][i] for i in items) + model.bias
        assert abs(r["s"] - 1 / (1 + math.exp(-(model.slope * margin + model.shift)))) < 1e-9


def objective(w, x, y, costs):
    return 0.5 * float(w @ w) + float((costs * np.maximum(0, 1 - y * (x @ w))).sum())


def test_dual_descent_reaches_the_optimum_of_a_plain_method():
    r = np.random.default_rng(5)
    items = [np.sort(r.choice(40, r.integers(1, 12), replace=False)) for _ in range(80)]
    ratio, y, costs = r.normal(size=40), np.where(r.random(80) < 0.5, 1.0, -1.0), r.uniform(0.2, 2.0, 80)
    x = np.zeros((80, 41))
    for k, at in enumerate(items):
        x[k, at] = ratio[at] / np.sqrt((ratio[at] ** 2).sum())
        x[k, 40] = 1
    w, best = np.zeros(41), np.inf
    for step in range(1, 40_001):  # subgradient steps on the primal
        hit = y * (x @ w) < 1
        w -= (w - (costs * y * hit) @ x) / (step + 50)
        best = min(best, objective(w, x, y, costs))
    assert objective(nbsvm.descend(items, ratio, y, costs), x, y, costs) < 1.02 * best


def plain_targets(have, power, keep):
    goal, full = {}, set()
    while True:
        rest = keep * sum(have.values()) - sum(have[n] for n in full)
        whole = sum(have[n] ** power for n in have if n not in full and have[n])
        goal = {n: have[n] if n in full else (have[n] ** power / whole * rest if have[n] else 0.0) for n in have}
        over = {n for n in have if n not in full and goal[n] > have[n]}
        if not over:
            return goal
        full |= over


def test_mixture_equals_plain_fitting_and_drawing(spark):
    r = random.Random(9)
    rows = [(k, " ".join(r.choice(["sun", "moon", "code", "law"]) for _ in range(r.randrange(0, 40))), r.choice("aab"), r.choice(["en", "en", None])) for k in range(150)]
    out = raking.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    tokens, margins = collections.Counter(), list(raking.POWERS)
    cell_of = {x["doc_id"]: tuple(str(x[m]) if x[m] is not None else "null" for m in margins) for x in out}
    for x in out:
        assert x["words"] == len(x["text"].split())
        tokens[cell_of[x["doc_id"]]] += x["words"]
    have = [collections.Counter() for _ in margins]
    for cell, n in tokens.items():
        for k, name in enumerate(cell):
            have[k][name] += n
    goals = [plain_targets(have[k], raking.POWERS[m], raking.KEEP) for k, m in enumerate(margins)]
    weight = {c: n * raking.KEEP for c, n in tokens.items()}
    for _ in range(raking.SWEEPS):
        worst = 0.0
        for k, goal in enumerate(goals):
            now = collections.Counter()
            for c, v in weight.items():
                now[c[k]] += v
            worst = max([worst, *[abs(goal[n] / now[n] - 1) for n in goal if goal[n] > 0]])
            weight = {c: min(tokens[c], v * (goal[c[k]] / now[c[k]] if now[c[k]] else 0)) for c, v in weight.items()}
        if worst < raking.TOLERANCE:
            break
    drawn = 0
    for x in out:
        cell = cell_of[x["doc_id"]]
        p = weight[cell] / tokens[cell] if tokens[cell] else raking.KEEP
        h = xxhash.xxh64_intdigest(struct.pack("<q", x["doc_id"]), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", raking.SEED), xxhash.xxh64_intdigest(x["text"].encode(), h))
        assert abs(x["probability"] - p) < 1e-9 and x["sampled"] == (h % (1 << 52) / (1 << 52) < x["probability"])
        drawn += x["sampled"]
    assert 0 < drawn < len(out)
