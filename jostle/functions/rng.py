"""Counter-based random numbers: a draw depends only on its own key, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*key: Column | int | str) -> Column:
    """Uniform integer in [0, 2^32) for a key such as (seed, repetition, slot)."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


# One digest holds two indices of 60 bits, or the signs of 30 repetitions.
INDICES, SIGNS = 2, 30


def digest(*key: Column | int | str) -> Column:
    """The hexadecimal MD5 of a key such as (seed, block of repetitions, slot)."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def index_of(size: Column, hexadecimal: Column, part: int) -> Column:
    """Index below ``size`` from part 0 or 1 of a digest: 60 bits, so large sizes are reached evenly."""
    return F.pmod(F.conv(F.substring(hexadecimal, 1 + 16 * part, 15), 16, 10).cast("long"), size)


def sign_bits(hexadecimal: Column) -> Column:
    """32 bits of a digest as a long; bit k set means + for repetition k of the block."""
    return F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("long")
