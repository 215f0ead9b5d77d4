"""Canonical text and digests of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the compact JSON of the columns in name order; NULL fields are kept."""
    ordered = sorted(columns)
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)
