"""Exact integer arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient truncated toward zero."""
    return F.call_function("div", a, lit(b))
