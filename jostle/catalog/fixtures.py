"""Audit inputs derived from the given tables, for Spark and as SQL common table expressions.

Sources are suppliers, events their line items (unit = line number, time = ship date, weekly bins),
the scorer is an exact integer one with five classes, and runs are sums over the embedding vectors.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jostle.functions.rng import draw
from jostle.operators import census as C
from jostle.operators import events as E
from jostle.operators import moves as M
from jostle.operators import scoring as SC
from jostle.plans.staging import stage

STEP = 604_800_000_000  # one week in microseconds
WIDTH = 7  # features
CLASSES = 5
LABEL_SEED = 17
RUN_CLASSES = 10
CONDITIONS = 5
#: Values of a vector beyond those that the conditions take turns with; every condition adds them.
REST = range(RUN_CLASSES * CONDITIONS, 64)
STAGES = 7
METRICS = 6


def weight(c: int, f: str, t: str) -> str:
    """Integer weight of class ``c`` at feature and bin, as an expression."""
    return f"(({7 * c * c + 3 * c}L + ({f}) * {5 * c} + ({t}) * {11 * (c + 1)} + ({t}) * ({t}) * {c}) % 17)"


def weight_b(c: int, f: str, t: str) -> str:
    return f"({weight(c, f, t)} + ((({t}) * 3 + ({f}) * {c} + {c}) % 4))"


def label_rule(source: Column, clean: Column) -> Column:
    keep = F.pmod(draw(LABEL_SEED, source), F.lit(10)) < 8
    return F.when(keep, clean).otherwise(F.pmod(clean + 1, F.lit(CLASSES)))


SCORER = SC.LinearScorer(CLASSES, weight)
SCORER_B = SC.LinearScorer(CLASSES, weight_b)


class Fixture:
    """Staged inputs of one data folder. Staged tables are written on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._kept: dict[str, DataFrame] = {}

    def once(self, name: str, build) -> DataFrame:
        """A staged table that several queries share."""
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("source_id"),
            E.micros(F.col("l_shipdate")).alias("us"),
            (F.col("l_linenumber").cast("long") - 1).alias("unit"),
        )

    @cached_property
    def bounds(self) -> DataFrame:
        return stage(E.event_bounds(self.events, STEP), "bounds")

    @cached_property
    def cells(self) -> DataFrame:
        return stage(M.index_cells(E.bin_events(self.events, self.bounds, STEP)), "cells")

    @cached_property
    def sources(self) -> DataFrame:
        return SC.stage_sources(self.cells, SCORER, label_rule)

    @property
    def moves(self) -> DataFrame:
        """Candidates with outcome, without score arrays."""
        return SC.score_moves(self.cells, self.sources, SCORER, keep_scores=False)

    @property
    def scored(self) -> DataFrame:
        """Candidates with the score arrays of neighbor and source."""
        return SC.score_moves(self.cells, self.sources, SCORER)

    @cached_property
    def kept_scores(self) -> DataFrame:
        """:attr:`scored` staged, for queries that read it several times."""
        return stage(self.scored, "scored")

    @property
    def paired_moves(self) -> DataFrame:
        """Candidates with the prediction of the other move of their cell."""
        return SC.score_moves(self.cells, self.sources, SCORER, keep_scores=False, keep_opposite=True)

    @property
    def scored_pairs(self) -> DataFrame:
        return SC.score_moves(self.cells, self.sources, SCORER, keep_opposite=True)

    @cached_property
    def sources_b(self) -> DataFrame:
        """The second model on the same inputs; labels come from the first one."""
        scored = SC.score_sources(self.cells, SCORER_B, lambda source, clean: clean).drop("label", "clean_correct")
        labels = self.sources.select("source_id", "label")
        return stage(
            scored.join(labels, "source_id").withColumn("clean_correct", F.col("label") == F.col("clean_prediction")),
            "sources_b",
        )

    @cached_property
    def summary(self) -> DataFrame:
        """One row per source with candidate and outcome counts."""
        facts = self.sources.drop("scores", "nonzero")
        counts = C.source_counts(self.moves)
        names = [c for c in counts.columns if c != "source_id"]
        return stage(facts.join(counts, "source_id", "left").fillna(0, names), "summary")

    @property
    def moves_b(self) -> DataFrame:
        return SC.score_moves(self.cells, self.sources_b, SCORER_B, keep_scores=False)

    @property
    def scored_b(self) -> DataFrame:
        return SC.score_moves(self.cells, self.sources_b, SCORER_B)

    @property
    def runs(self) -> DataFrame:
        """Long table of score vectors: one row per (condition, source)."""
        e = F.col("embedding")
        conditions = []
        for k in range(CONDITIONS):
            values = [
                F.get(e, F.lit(i)).cast("double")
                + F.when(F.col("label") == i, 0.25).otherwise(0.0)
                + (F.lit(0.125) if k else F.lit(0.0)) * F.get(e, F.lit(i + 10 * k)).cast("double")
                + sum((F.lit(0.0625) * F.get(e, F.lit(j)).cast("double") for j in REST if j % RUN_CLASSES == i), F.lit(0.0))
                for i in range(RUN_CLASSES)
            ]
            conditions.append(F.struct(F.lit(k).alias("condition"), F.array(*values).alias("scores")))
        return self.table("embeddings").select(
            F.col("vec_id").alias("source_id"),
            F.col("label").cast("long").alias("label"),
            (F.pmod(F.col("vec_id"), F.lit(7)) + 64).alias("native_horizon"),
            F.explode(F.array(*conditions)).alias("run"),
        ).select(
            "source_id", "label", "native_horizon",
            F.col("run.condition").cast("long").alias("condition"), F.col("run.scores").alias("scores"),
        )

    def traces(self, moves: DataFrame, metrics: tuple[int, ...] = tuple(range(METRICS))) -> DataFrame:
        """Long activation-change table: (source, cand, stage, metric, value)."""
        grid = F.array(*[
            F.struct(F.lit(s).cast("long").alias("stage"), F.lit(m).cast("long").alias("metric"))
            for s in range(STAGES) for m in metrics
        ])
        return moves.withColumn("g", F.explode(grid)).select(
            *[c for c in moves.columns], F.col("g.stage").alias("stage"), F.col("g.metric").alias("metric"),
            trace_value(F.col("source_id"), F.col("cand"), F.col("g.stage"), F.col("g.metric")).alias("value"),
        )

    def final_response(self, moves: DataFrame) -> DataFrame:
        """The last stage's relative change as a column ``response``."""
        return moves.withColumn("response", trace_value(F.col("source_id"), F.col("cand"), F.lit(STAGES - 1), F.lit(2)))

    def patches(self, moves: DataFrame) -> DataFrame:
        """One row per changed candidate and stage with the prediction after replacement."""
        changed = moves.where(F.col("transition_code") != 0)
        rows = changed.withColumn("stage", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(STAGES - 1).cast("long"))))
        restored = F.col("stage").isin(0, 3, 6) | (F.pmod(F.col("cand") + F.col("stage"), F.lit(5)) < 4)
        return rows.withColumn(
            "patch_prediction", F.when(restored, F.col("clean_prediction")).otherwise(F.col("candidate_prediction"))
        ).withColumn(
            "patch_scores", F.when(restored, F.col("clean_scores")).otherwise(F.col("scores"))
        )


def trace_value(source: Column, cand: Column, stage_: Column, metric: Column) -> Column:
    raw = F.pmod(cand * 31 + stage_ * 7 + metric * 3 + source, F.lit(101))
    return F.when(F.pmod(cand, F.lit(9)) == 0, F.lit(0.0)).otherwise(raw / F.lit(101.0))


_FIXTURES: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, folder: str) -> Fixture:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixture(spark, folder)
    return _FIXTURES[key]


def forget() -> None:
    """Drop the handles of staged tables, so the next query builds its own (used by the benchmark)."""
    _FIXTURES.clear()


# ---------------------------------------------------------------- the same inputs as SQL


def w_sql(c: int | str, f: str, t: str) -> str:
    return f"((7*{c}*{c} + 3*{c} + 5*{f}*{c} + 11*{t}*({c}+1) + {t}*{t}*{c}) % 17)"


def wb_sql(c: int | str, f: str, t: str) -> str:
    return f"({w_sql(c, f, t)} + ((3*{t} + {c}*{f} + {c}) % 4))"


def rng_sql(*key) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(map(str, key))})), 1, 8)) AS BIGINT)"


def index_sql(seed, rep, *key) -> str:
    """60 bits for a repetition: two repetitions share a digest."""
    text = f"concat_ws(':', {', '.join(map(str, (seed, f'{rep} // 2', *key)))})"
    return f"CAST(('0x' || substr(md5({text}), 1 + 16 * CAST({rep} % 2 AS INTEGER), 15)) AS BIGINT)"


def sign_sql(seed, rep, *key) -> str:
    """The sign bit of a repetition: thirty repetitions share a digest."""
    text = f"concat_ws(':', {', '.join(map(str, (seed, f'{rep} // 30', *key)))})"
    return f"((CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) >> CAST({rep} % 30 AS INTEGER)) & 1)"


def predict_sql(scores: str) -> str:
    return f"CAST(list_position({scores}, list_max({scores})) - 1 AS BIGINT)"


def target_margin_sql(scores: str, target: str) -> str:
    return (
        f"({scores}[{target}+1] - list_max(list_concat({scores}[1:{target}], {scores}[{target}+2:])))"
    )


def top_margin_sql(scores: str) -> str:
    return f"(list_reverse_sort({scores})[1] - list_reverse_sort({scores})[2])"


def code_sql(label: str, clean: str, cand: str) -> str:
    return (
        f"CAST(CASE WHEN {cand} = {clean} THEN 0 WHEN {clean} = {label} THEN 1 "
        f"WHEN {cand} = {label} THEN 2 ELSE 3 END AS BIGINT)"
    )


def l2_sql(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def diff_sql(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def trace_sql(source: str, cand: str, stage_: str, metric: str) -> str:
    return (
        f"(CASE WHEN {cand} % 9 = 0 THEN 0e0 ELSE "
        f"CAST(({cand}*31 + {stage_}*7 + {metric}*3 + {source}) % 101 AS DOUBLE) / 101e0 END)"
    )


def _clean_select(weight_sql) -> str:
    sums = ", ".join(f"CAST(sum(n*{weight_sql(c, 'f', 't')}) AS BIGINT)" for c in range(CLASSES))
    return (
        f"SELECT source_id, horizon, [{sums}] AS scores, CAST(sum(n) AS BIGINT) AS input_count, "
        "count(*) AS nonzero FROM cells GROUP BY source_id, horizon"
    )


def _moves_select(sources: str, weight_sql) -> str:
    scores = ", ".join(
        f"s.scores[{c + 1}] + {weight_sql(c, 'm.feature', 'm.to_bin')} - {weight_sql(c, 'm.feature', 'm.from_bin')}"
        for c in range(CLASSES)
    )
    return f"""SELECT *, {code_sql('label', 'clean_prediction', 'candidate_prediction')} AS transition_code FROM (
      SELECT *, {predict_sql('scores')} AS candidate_prediction FROM (
        SELECT m.*, s.label, s.clean_prediction, s.scores AS clean_scores, [{scores}] AS scores
        FROM plain_moves m JOIN {sources} s USING (source_id)))"""


def _runs_select() -> str:
    parts = []
    for k in range(CONDITIONS):
        items = ", ".join(
            f"CAST(embedding[{i + 1}] AS DOUBLE) + (CASE WHEN label = {i} THEN 0.25e0 ELSE 0e0 END) + "
            f"{'0.125e0' if k else '0e0'} * CAST(embedding[{i + 10 * k + 1}] AS DOUBLE) + "
            + "(" + " + ".join(["0e0", *[f"0.0625e0 * CAST(embedding[{j + 1}] AS DOUBLE)" for j in REST if j % RUN_CLASSES == i]]) + ")"
            for i in range(RUN_CLASSES)
        )
        parts.append(
            f"SELECT vec_id AS source_id, CAST(label AS BIGINT) AS label, vec_id % 7 + 64 AS native_horizon, "
            f"CAST({k} AS BIGINT) AS condition, [{items}] AS scores FROM embeddings"
        )
    return " UNION ALL ".join(parts)


_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "SELECT l_suppkey AS source_id, epoch_us(l_shipdate) AS us, CAST(l_linenumber - 1 AS BIGINT) AS unit FROM lineitem"),
    "bounds": (("ev",), f"SELECT source_id, min(us) AS first_us, max(us) AS last_us, greatest(1, (max(us) - min(us) + {STEP} - 1) // {STEP}) AS horizon FROM ev GROUP BY source_id"),
    "cells": (("ev", "bounds"), f"SELECT source_id, horizon, least((us - first_us) // {STEP}, horizon - 1) AS t, unit AS f, count(*) AS n FROM ev JOIN bounds USING (source_id) GROUP BY ALL"),
    "plain_moves": (("cells",), """SELECT source_id, horizon, t AS from_bin, t + d AS to_bin, f AS feature, d AS direction, n AS multiplicity,
      row_number() OVER (PARTITION BY source_id ORDER BY t, f, d) - 1 AS cand
      FROM cells, (VALUES (CAST(-1 AS BIGINT)), (CAST(1 AS BIGINT))) v(d) WHERE t + d >= 0 AND t + d < horizon"""),
    "clean": (("cells",), f"SELECT *, {predict_sql('scores')} AS clean_prediction, {top_margin_sql('scores')} AS clean_margin FROM ({_clean_select(w_sql)})"),
    "sources": (("clean",), f"SELECT *, label = clean_prediction AS clean_correct FROM (SELECT *, CASE WHEN {rng_sql(LABEL_SEED, 'source_id')} % 10 < 8 THEN clean_prediction ELSE (clean_prediction + 1) % {CLASSES} END AS label FROM clean)"),
    "moves": (("plain_moves", "sources"), _moves_select("sources", w_sql)),
    "clean_b": (("cells",), f"SELECT *, {predict_sql('scores')} AS clean_prediction, {top_margin_sql('scores')} AS clean_margin FROM ({_clean_select(wb_sql)})"),
    "sources_b": (("clean_b", "sources"), "SELECT b.*, a.label, a.label = b.clean_prediction AS clean_correct FROM clean_b b JOIN sources a USING (source_id)"),
    "moves_b": (("plain_moves", "sources_b"), _moves_select("sources_b", wb_sql)),
    "runs": ((), _runs_select()),
    "run_labels": (("runs",), f"SELECT *, {predict_sql('scores')} AS prediction FROM runs"),
    "batches": ((), """SELECT vec_id AS source_id, CAST(label AS BIGINT) AS label, vec_id % 7 + 64 AS native_horizon, vec_id // 256 AS batch,
      max(vec_id % 7 + 64) OVER (PARTITION BY vec_id // 256) AS padded_horizon FROM embeddings"""),
}


def define(name: str, needs: tuple[str, ...], sql: str) -> None:
    """Add a common table expression."""
    _CTES[name] = (needs, sql)


def with_ctes(needs: tuple[str, ...] | list[str], body: str) -> str:
    """``body`` preceded by the named expressions and what they need, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in _CTES[name][0]:
            visit(need)
        order.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(f"{name} AS MATERIALIZED ({_CTES[name][1]})" for name in order)
    return f"WITH {parts}\n{body}" if parts else body
