"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells, one per combination of the margins (source, language, topic), with their
tokens. The cells' tokens to keep are scaled to one margin's targets after the other, never above the tokens
that a cell has, until all margins fit. A document's probability is the kept share of its cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jostle.llm import topics as TP
from jostle.llm.common import free_name
from jostle.plans.joins import attach
from jostle.plans.staging import stage

#: Share of all tokens that the mixture keeps.
KEEP = 0.75
#: Target shares are the shares in the corpus to these powers, scaled to one: below 1 lifts small ones.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.5}
SWEEPS = 60
TOLERANCE = 1e-5
#: Up to so many cells the fitting runs on the driver; beyond it, the same steps run as joins.
DRIVER_CELLS = 200_000
SEED = 23
#: Fixed value: stands for null in a margin, so that null is a category of its own.
NULL = "\x00null"


def target_tokens(available: Mapping[str, float], power: float, keep: float) -> dict[str, float]:
    """Tokens to keep of each category: ``keep`` of all, shared by available tokens to the ``power``.

    No category is given more than it has; the excess goes to the others in proportion.
    """
    names = sorted(available)
    have = np.array([available[n] for n in names], float)
    want = np.where(have > 0, np.maximum(have, 1e-300) ** power, 0.0)
    budget, full = keep * have.sum(), np.zeros(len(names), bool)
    goal = np.zeros(len(names))
    while True:
        open_ = ~full
        share = want * open_
        goal = np.where(full, have, share / max(share.sum(), 1e-300) * (budget - have[full].sum()))
        over = open_ & (goal > have)
        if not over.any():
            return dict(zip(names, goal.tolist(), strict=True))
        full |= over


def _rake_driver(cells: DataFrame, margins: Sequence[str], targets: Mapping[str, Mapping[str, float]], keep: float):
    found = cells.select("cell", "tokens", *margins).toArrow().to_pydict()
    tokens = np.array(found["tokens"], float)
    weight, codes, goals = tokens * keep, [], []
    for m in margins:
        names, code = np.unique(np.array(found[m], dtype=object).astype(str), return_inverse=True)
        codes.append(code)
        goals.append(np.array([targets[m][n] for n in names]))
    for _ in range(SWEEPS):
        worst = 0.0
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, weight, len(goal))
            factor = np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)
            worst = max(worst, float(np.abs(factor[goal > 0] - 1).max(initial=0.0)))
            weight = np.minimum(tokens, weight * factor[code])
        if worst < TOLERANCE:
            break
    share = np.divide(weight, tokens, out=np.full(len(tokens), keep), where=tokens > 0)
    rows = [(int(c), float(p)) for c, p in zip(found["cell"], share, strict=True)]
    return cells.sparkSession.createDataFrame(rows, "cell long, probability double")


def _rake_joins(cells: DataFrame, margins: Sequence[str], targets: Mapping[str, Mapping[str, float]], keep: float):
    spark = cells.sparkSession
    current = cells.withColumn("weight", F.col("tokens") * F.lit(keep))
    for _ in range(SWEEPS):
        worst = 0.0
        for m in margins:
            goal = spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()], f"{m} string, goal double")
            now = current.groupBy(m).agg(F.sum("weight").alias("now")).join(goal, m)
            factor = stage(now.select(m, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("factor"), "goal"), "factor")
            worst = max(worst, factor.where("goal > 0").agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            scaled = attach(current, factor.select(m, "factor"), [m], spread=F.col("cell"))
            current = scaled.withColumn("weight", F.least(F.col("tokens").cast("double"), F.col("weight") * F.col("factor"))).drop("factor")
        current = stage(current, "raked")
        if worst < TOLERANCE:
            break
    share = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(keep))
    return current.select("cell", share.alias("probability"))


def rake(
    cells: DataFrame, powers: Mapping[str, float], keep: float = KEEP, driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """(cell, probability) for ``cells`` (cell long, tokens long, one string column per margin in ``powers``).

    ``cells`` is a staged table. The categories of each margin and their targets pass the driver. Where
    margins contradict each other (or the tokens there are), the last sweep's weights are returned: every
    one is within its cell's tokens. Cells without tokens get ``keep``.
    """
    margins = list(powers)
    targets = {}
    for m in margins:
        sums = {r[0]: float(r[1]) for r in cells.groupBy(m).agg(F.sum("tokens")).collect()}
        targets[m] = target_tokens(sums, powers[m], keep)
    way = _rake_driver if cells.count() <= driver_cells else _rake_joins
    return way(cells, margins, targets, keep)


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(*key, F.lit(SEED)), F.lit(1 << 52)) / float(1 << 52)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", powers: Mapping[str, float] = POWERS, keep: float = KEEP,
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """All columns of ``docs`` plus ``topic``, ``words``, ``probability`` and ``sampled``.

    The margins are the keys of ``powers``; ``topic`` is made here, the others are columns of ``docs``. Tokens
    are counted as words. Null is a category of its own in each margin. The draw depends on id and text
    only, so repeated rows share their fate, and a text without words draws like any other. If ``docs``
    has columns of these names, the new ones get trailing underscores.
    """
    names = {n: free_name(docs, n) for n in ("topic", "words", "probability", "sampled", "vector", "cell")}
    margins = list(powers)
    made = docs.withColumn(names["vector"], TP.word_vectors(F.col(text)))
    made = made.withColumn(names["words"], F.col(names["vector"])["words"]).withColumn(names["vector"], F.col(names["vector"])["vector"])
    rows = stage(made, "vectors")
    rows = rows.withColumn(names["topic"], TP.topic(F.col(names["vector"]), TP.centroids(rows, names["vector"])))
    label = {m: F.coalesce(F.col(names["topic"] if m == "topic" else m).cast("string"), F.lit(NULL)) for m in margins}
    rows = rows.withColumn(names["cell"], F.xxhash64(*[label[m] for m in margins]))
    sums = rows.groupBy(F.col(names["cell"]).alias("cell"), *[label[m].alias(m) for m in margins]).agg(F.sum(names["words"]).alias("tokens"))
    cells = stage(sums, "cells")
    chance = stage(rake(cells, powers, keep, driver_cells), "chance")
    chance = chance.select(F.col("cell").alias(names["cell"]), F.col("probability").alias(names["probability"]))
    drawn = attach(rows, chance, [names["cell"]], spread=F.col(doc_id))
    drawn = drawn.withColumn(names["sampled"], uniform(F.col(doc_id), F.col(text)) < F.col(names["probability"]))
    return drawn.select(*docs.columns, *[names[n] for n in ("topic", "words", "probability", "sampled")])
