"""Text checks over document tables."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def scan_patterns(texts: DataFrame, identity: str, text: str, patterns: Mapping[str, str], exempt: DataFrame | None = None) -> DataFrame:
    """matches of every pattern in every whole text that is not exempt: (id, pattern, matches).

    The patterns are literals, so all are tested in one scan; exempt ids leave by an anti-join.
    """
    rows = texts if exempt is None else texts.join(exempt, identity, "left_anti")
    counts = F.array(*[
        F.struct(F.lit(name).alias("pattern"), F.regexp_count(F.col(text), F.lit(regex)).cast("long").alias("matches"))
        for name, regex in patterns.items()
    ])
    return rows.select(identity, F.explode(F.filter(counts, lambda c: c["matches"] > 0)).alias("c")).select(identity, "c.*")


def list_matches(texts: DataFrame, identity: str, text: str, patterns: Mapping[str, str], exempt: DataFrame | None = None) -> DataFrame:
    """F1, rows: (id, line, pattern, occurrence, match) for every match within a line; lines and occurrences count from 1.

    A text is cut into lines within its row; only lines with a match leave it. Patterns do not reach across lines. A NULL text has no line.
    """
    rows = texts if exempt is None else texts.join(exempt, identity, "left_anti")
    any_ = lambda line: functools.reduce(lambda x, y: x | y, [line.rlike(regex) for regex in patterns.values()])
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda line, i: F.when(any_(line), F.struct((i + 1).alias("line"), line.alias("text"))))
    cut = rows.select(identity, F.explode(F.filter(lines, lambda v: v.isNotNull())).alias("l"))
    found = F.array(*[
        F.struct(F.lit(name).alias("pattern"), F.regexp_extract_all(F.col("l.text"), F.lit(regex), F.lit(0)).alias("hits")) for name, regex in patterns.items()
    ])
    each = cut.select(identity, F.col("l.line").cast("long").alias("line"), F.explode(found).alias("f"))
    return each.select(identity, "line", "f.pattern", F.posexplode("f.hits").alias("place", "match")).select(
        identity, "line", "pattern", (F.col("place") + 1).cast("long").alias("occurrence"), "match"
    )
