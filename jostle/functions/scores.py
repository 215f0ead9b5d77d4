"""Descriptors of score vectors held as array columns; ``size`` is their length where the caller knows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def predict(scores: Column) -> Column:
    """Class of the largest score; the lowest class id on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def runner_up(scores: Column) -> Column:
    """Second class: the best one other than the prediction, lowest id on ties."""
    top = F.array_position(scores, F.array_max(scores))
    masked = F.transform(scores, lambda x, i: F.when(i + 1 != top, x))
    return (F.array_position(masked, F.array_max(masked)) - 1).cast("int")


def top_margin(scores: Column) -> Column:
    ordered = F.sort_array(scores, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def _items(values: Column, size: int) -> list[Column]:
    """The elements of arrays of a known length as columns: expressions on them are compiled, lambdas are interpreted."""
    return [F.get(values, F.lit(i)) for i in range(size)]


def _sum(values: list[Column], start) -> Column:
    total = F.lit(start)
    for v in values:
        total = total + v
    return total


def _best(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def target_margin(scores: Column, target: Column, size: int | None = None) -> Column:
    """Score of ``target`` minus the best other score."""
    if size is not None:
        return F.get(scores, target) - _best([F.when(target != i, v) for i, v in enumerate(_items(scores, size))])
    others = F.filter(scores, lambda x, i: i != target)
    return F.get(scores, target) - F.array_max(others)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def l2(values: Column, size: int | None = None) -> Column:
    if size is not None:
        return F.sqrt(_sum([v.cast("double") * v.cast("double") for v in _items(values, size)], 0.0))
    return F.sqrt(_total(F.transform(values, lambda x: x.cast("double") * x.cast("double"))))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def squared_change(a: Column, b: Column, size: int | None = None) -> Column:
    """The squared L2 change of integer scores, as an integer."""
    if size is not None:
        return _sum([(x - y) * (x - y) for x, y in zip(_items(a, size), _items(b, size), strict=True)], 0).cast("long")
    return F.aggregate(difference(a, b), F.lit(0).cast("long"), lambda total, d: total + d * d)


def l2_change(a: Column, b: Column, size: int | None = None) -> Column:
    if size is not None:
        changes = [(x - y).cast("double") for x, y in zip(_items(a, size), _items(b, size), strict=True)]
        return F.sqrt(_sum([d * d for d in changes], 0.0))
    return l2(difference(a, b))


def linf_change(a: Column, b: Column, size: int | None = None) -> Column:
    if size is not None:
        return _best([F.abs(x - y) for x, y in zip(_items(a, size), _items(b, size), strict=True)])
    return F.array_max(F.transform(difference(a, b), lambda x: F.abs(x)))


def dot(a: Column, b: Column, size: int | None = None) -> Column:
    if size is not None:
        return _sum([x.cast("double") * y.cast("double") for x, y in zip(_items(a, size), _items(b, size), strict=True)], 0.0)
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column, size: int | None = None) -> Column:
    """1 - cosine; 0 when either vector is zero."""
    norms = l2(a, size) * l2(b, size)
    return F.when(norms > 0, 1.0 - dot(a, b, size) / norms).otherwise(F.lit(0.0))


def trace_metrics(candidate: Column, clean: Column) -> dict[str, Column]:
    """Six change measures between two activation vectors of equal length."""
    delta = difference(candidate, clean)
    size = F.size(clean)
    # Denominator floor and activity threshold.
    floor, active = 1e-12, 0.5
    squares = _total(F.transform(delta, lambda x: x.cast("double") * x.cast("double")))
    flips = _total(
        F.zip_with(candidate, clean, lambda x, y: F.when((x > active) != (y > active), 1.0).otherwise(0.0))
    )
    norms = F.greatest(l2(candidate) * l2(clean), F.lit(floor))
    return {
        "mean_absolute_change": _total(F.transform(delta, lambda x: F.abs(x).cast("double"))) / size,
        "rms_change": F.sqrt(squares / size),
        "relative_l2_change": F.sqrt(squares) / F.greatest(l2(clean), F.lit(floor)),
        "cosine_distance": 1.0 - dot(candidate, clean) / norms,
        "activity_flip_rate": flips / size,
        "mean_signed_change": _total(F.transform(delta, lambda x: x.cast("double"))) / size,
    }


def softmax(values: Column) -> Column:
    peak = F.array_max(values)
    exps = F.transform(values, lambda x: F.exp(x - peak))
    total = _total(exps)
    return F.transform(exps, lambda x: x / total)
