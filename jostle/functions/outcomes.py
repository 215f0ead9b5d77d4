"""Outcome codes and coordinates of a move."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jostle.functions.ints import div

# Outcome codes.
PRESERVED, ADVERSE, CORRECTIVE, LATERAL = 0, 1, 2, 3
OUTCOMES = ((0, "class_preserved"), (1, "adverse"), (2, "corrective"), (3, "lateral"))


def transition_code(label: Column, clean: Column, candidate: Column, classes: int | None = None) -> Column:
    """0 preserved, 1 correct-to-wrong, 2 wrong-to-correct, 3 wrong-to-other-wrong.

    With ``classes`` an id outside ``[0, classes)`` fails the job.
    """
    code = (
        F.when(candidate == clean, F.lit(PRESERVED))
        .when(clean == label, F.lit(ADVERSE))
        .when(candidate == label, F.lit(CORRECTIVE))
        .otherwise(F.lit(LATERAL))
    )
    if classes is None:
        return code
    low, high = F.least(label, clean, candidate), F.greatest(label, clean, candidate)
    return F.when((low < 0) | (high >= classes), F.raise_error(F.lit("class id out of range"))).otherwise(code)


def time_normalized(from_bin: Column, horizon: Column) -> Column:
    return from_bin / F.greatest(F.lit(1), horizon - 1)


def feature_normalized(feature: Column, width: int) -> Column:
    return feature / F.lit(max(1, width - 1))


def time_part(from_bin: Column, horizon: Column, parts: int) -> Column:
    """Equal-width part of the source's own time axis, in integers: ``floor(parts*from/(H-1))``."""
    last = F.greatest(F.lit(1), horizon - 1)
    return F.least(div(from_bin * parts, last), F.lit(parts - 1).cast("long"))


def feature_part(feature: Column, width: int, parts: int) -> Column:
    return F.least(div(feature * parts, width), F.lit(parts - 1).cast("long"))


def outcome_name(code: Column) -> Column:
    column = F.lit(None).cast("string")
    for value, name in OUTCOMES:
        column = F.when(code == value, F.lit(name)).otherwise(column)
    return column
