"""Running values and cuts within one row, by column expressions, at a cost linear in the row but for a square root."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters in a piece that a text is cut into before parts are taken out of it.
PIECE = 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of the associative ``join`` over an array of integers, as an array of longs.

    An array that grows element by element is copied each time; so runs of about a square root of the length are scanned by
    themselves and then moved on by the result of all runs before.
    """
    none = F.array().cast("array<bigint>")

    def grown(run: Column) -> Column:
        step = lambda seen, v: F.concat(seen, F.array(F.when(F.size(seen) == 0, v).otherwise(join(F.element_at(seen, -1), v)).cast("bigint")))
        return F.aggregate(run, none, step)

    def moved(own: Column, k: Column, before: Column) -> Column:
        return F.transform(own, lambda v: F.when(k == 0, v).otherwise(join(F.get(before, k - 1), v)))

    def whole(v: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(v))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.size(v) - 1, wide), lambda at: grown(F.slice(v, at + 1, wide)))
        return let(runs, lambda own: let(grown(F.transform(own, lambda r: F.element_at(r, -1))), lambda before: F.flatten(F.transform(own, lambda r, k: moved(r, k, before)))))

    return let(values.cast("array<bigint>"), lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def pieces(text: Column) -> Column:
    """The text as an array of pieces of ``PIECE`` characters (code points), the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text that :func:`pieces` has cut: only the pieces they lie in are read."""
    first, count = F.floor(start / PIECE).cast("int"), (F.floor((F.greatest(end, start + 1) - 1) / PIECE) - F.floor(start / PIECE) + 1).cast("int")
    own = F.transform(F.slice(cut, first + 1, count), lambda p, k: F.substr(
        p, F.when(k == 0, start - first * PIECE).otherwise(0).cast("int") + 1,
        (F.least(end, (first + k + 1) * F.lit(PIECE)) - F.when(k == 0, start).otherwise((first + k) * PIECE)).cast("int"),
    ))
    return F.when(end > start, F.array_join(own, "")).otherwise("")
