"""Naive Bayes support vectors: a quality classifier over scaled n-gram indicators.

An indicator of an n-gram is scaled by the log ratio of its frequencies in the two classes, then a
linear hinge-loss model is fitted by dual coordinate descent. The ratios count every labelled
training row, by a distributed aggregation over hashed n-grams. The linear model is fitted on a bounded
sample of them (``FIT_ROWS``); scoring reads every row once and needs no shuffle.

The n-grams are words, and one to four consecutive word shapes. A shape keeps letter case, digits,
symbols and final punctuation of a word but not its letters, and whether the word repeats the one before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.llm.common import WordCache, free_name, texts
from jostle.plans.joins import attach
from jostle.plans.staging import stage

BUCKETS = 1 << 18
#: Labelled rows that the hinge-loss fit uses at most, chosen by hash; the ratios use all of them.
FIT_ROWS = 6_000
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 12
THRESHOLD = 0.7

_SHAPE = re.compile(r"[A-ZÀ-ÖØ-Þ]+|[a-zß-öø-ÿ]+|[0-9]+")


def _shape(word: str) -> int:
    """A small code of a word's form: runs of capitals A, small letters a, digits 0; other characters stay."""
    form = _SHAPE.sub(lambda m: "A" if m[0][0].isupper() else "0" if m[0][0].isdigit() else "a", word)
    return zlib.crc32(form.encode()) or 1


def _features() -> WordCache:
    return WordCache(lambda w: (zlib.crc32(w.lower().encode()), _shape(w)))


def indicators(text: str, cache: WordCache) -> np.ndarray:
    """Sorted distinct buckets of the n-grams of a text; empty without words."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    pairs = np.array([cache[w] for w in words], dtype=np.uint64)
    plain, shape = pairs[:, 0], pairs[:, 1].copy()
    shape[1:][plain[1:] == plain[:-1]] ^= np.uint64(0x9E3779B9)  # repeats the word before
    grams = [plain * np.uint64(0x9E3779B97F4A7C15)]
    rolled = shape * np.uint64(0xC2B2AE3D27D4EB4F)
    grams.append(rolled)
    for n in range(1, 4):
        if len(words) <= n:
            break
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + shape[n:]
        grams.append(rolled * np.uint64(0x9E3779B97F4A7C15))
    mixed = np.concatenate(grams)
    return np.unique((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # two rows: class ratio and fitted weight of every bucket
    bias: float
    slope: float  # score = 1 / (1 + exp(-(slope * margin + shift)))
    shift: float


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, class, texts) of a task: at most two rows per bucket, so little is shuffled."""
    counts, cache = np.zeros((2, BUCKETS), np.int64), _features()
    for batch in batches:
        for text, label in zip(texts(batch.column("text"), cache), batch.column("label").to_pylist(), strict=True):
            counts[label, indicators(text, cache)] += 1
    for label in (0, 1):
        at = np.nonzero(counts[label])[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(np.full(len(at), label), pa.int32()), pa.array(counts[label, at], pa.int64())],
            names=["bucket", "label", "n"],
        )


def class_ratios(labelled: DataFrame) -> np.ndarray:
    """Log ratio of the smoothed, normalised counts of every bucket in class 1 against class 0.

    ``labelled``: (text, label int). All its rows are counted; the driver gets at most ``BUCKETS`` rows.
    """
    counts = labelled.select("text", "label").mapInArrow(_counted, "bucket long, label int, n long")
    sums = counts.groupBy("bucket").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("one"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("zero"),
    ).toArrow()
    one, zero = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    at = sums.column("bucket").to_numpy()
    one[at] += sums.column("one").to_numpy()
    zero[at] += sums.column("zero").to_numpy()
    return np.log(one / one.sum()) - np.log(zero / zero.sum())


def descend(rows: list[np.ndarray], ratio: np.ndarray, signs: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) that minimise the L2-regularised hinge loss, by dual coordinate descent.

    Row i has the values ``ratio[rows[i]]`` (scaled to length one) and a constant 1.
    """
    weights, alpha = np.zeros(len(ratio) + 1), np.zeros(len(rows))
    values = []
    for at in rows:
        x = ratio[at]
        values.append(x / max(np.sqrt(x @ x), 1e-12))
    order, random = np.arange(len(rows)), np.random.default_rng(11)
    for _ in range(EPOCHS):
        random.shuffle(order)
        for i in order:
            at, x, y = rows[i], values[i], signs[i]
            gradient = y * (weights[at] @ x + weights[-1]) - 1.0
            norm = 2.0 if len(at) else 1.0
            new = min(max(alpha[i] - gradient / norm, 0.0), costs[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weights[at] += step * x
                weights[-1] += step
                alpha[i] = new
    return weights


def _platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton steps with prior-smoothed targets."""
    ones, zeros = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * theta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of ``labelled`` (text, label 0/1; rows with another or no label are left out).

    With one class only, or no row at all, every text scores that class's share (0.5 without rows).
    """
    pick = F.pmod(F.col("pick"), F.lit(1 << 30)) if "pick" in labelled.columns else F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    rows = labelled.where(F.col("label").isin(0, 1)).select("text", F.col("label").cast("int").alias("label"), pick.alias("pick"))
    rows = stage(rows, "labelled")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(size.values())
    if len(size) < 2:
        return _even(size)
    ratio = class_ratios(rows)
    # A sample by hash: about ``fit_rows``, half of it from each class where there are enough.
    half = fit_rows // 2
    quota = {k: min(size[k], max(half, fit_rows - size[1 - k])) for k in (0, 1)}
    share = F.when(F.col("label") == 1, quota[1] / size[1]).otherwise(quota[0] / size[0])
    sample = rows.where(F.col("pick") < share * (1 << 30)).select("text", "label")
    sample = sample.mapInArrow(_sampled, "label int, items array<int>").toArrow().combine_chunks()
    label = sample.column("label").to_numpy()
    if not {0, 1} <= set(label.tolist()):  # so few rows that the hashes missed a class
        return fit(rows.withColumn("pick", F.lit(0)), fit_rows) if total <= fit_rows * 2 else _even(size)
    items = [np.asarray(x.values) for x in sample.column("items").combine_chunks()]
    signs = np.where(label == 1, 1.0, -1.0)
    # Each row stands for as many labelled rows of its class; the square root keeps a rare class heard.
    weight = np.where(label == 1, size[1] / quota[1], size[0] / quota[0])
    costs = COST * len(label) * np.sqrt(weight) / np.sqrt(weight).sum()
    fold = np.arange(len(label)) % 3
    margin = np.zeros(len(label))
    for k in range(3):  # margins of rows that their model has not seen
        part = [i for i in range(len(items)) if fold[i] != k]
        w = descend([items[i] for i in part], ratio, signs[part], costs[part])
        for i in np.nonzero(fold == k)[0]:
            margin[i] = _margin(items[i], ratio, w[:-1], w[-1])
    slope, shift = _platt(margin, label)
    w = descend(items, ratio, signs, costs)
    return Model(np.stack([ratio, w[:-1]]), float(w[-1]), slope, shift)


def _even(size: dict[int, int]) -> Model:
    """Every text scores the share of class 1."""
    share = (1 + size.get(1, 0)) / (2 + sum(size.values()))
    return Model(np.zeros((2, BUCKETS)), 0.0, 1.0, float(np.log(share / (1 - share))))


def _margin(items: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float) -> float:
    x = ratio[items]
    return float(weights[items] @ x / max(np.sqrt(x @ x), 1e-12) + bias)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _features()
    for batch in batches:
        found = [indicators(text, cache).astype(np.int32) for text in texts(batch.column("text"), cache)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["label", "items"])


def score(text: Column, model: Model) -> Column:
    """The score of a text between 0 and 1; null and empty texts get the score of a text without n-grams."""
    shared = _broadcast((model.weights, model.bias, model.slope, model.shift))

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache, ((ratio, weights), bias, slope, shift) = _features(), shared.value
        for column in batches:
            margins = np.array([_margin(indicators(t, cache), ratio, weights, bias) for t in texts(column, cache)], dtype=float)
            yield pa.array(1 / (1 + np.exp(-np.clip(slope * margins + shift, -500, 500))), pa.float64())

    return scores(text)


def _broadcast(model: tuple):
    """Two numbers per bucket: 4 MB whatever the corpus."""
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id's decimal text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """(text, label, pick) of the documents with a label that may be learnt. A repeated id repeats its rows.

    ``pick`` orders rows for sampling and is no input of the model.
    """
    usable = labels.where(F.col(target).isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    found = attach(docs.select("doc_id", "text"), stage(usable, "labels"), ["doc_id"])
    return found.select("text", "label", F.xxhash64("doc_id", "text").alias("pick"))


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 where the score reaches ``threshold``) added.

    If ``docs`` has columns of these names, the new ones get trailing underscores.
    """
    names = [free_name(docs, n) for n in ("score", "predicted")]
    scored = docs.withColumn(names[0], score(F.col(text), model))
    return scored.withColumn(names[1], F.when(F.col(names[0]) >= threshold, 1).otherwise(0))
