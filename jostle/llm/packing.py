"""Packing documents into sequences by cutting-stock column generation.

Documents are cut at multiples of the sequence length only, so a document no longer than a sequence
stays whole. The lengths of the pieces, rounded up to ``grain`` tokens, form a histogram of at most
``length / grain`` classes, however many documents there are. A linear program over patterns (multisets
of classes that fit a sequence) is solved by column generation: the dual prices of the classes go into
a knapsack dynamic program that finds the best new pattern. Patterns are used as often as their rounded-down
value; what remains is packed first-fit decreasing. Each pattern claims an interval of ranks of its
classes, and documents find their sequence by their rank in their class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.llm.common import texts
from jostle.llm.tokens import WordEncoder
from jostle.plans.joins import attach
from jostle.plans.staging import stage

LENGTH = 4096
GRAIN = 8
END_ID = 2
#: Column generation ends within this share of the optimum of the linear program.
GAP = 2e-4
ROUNDS = 2_000
#: Texts whose new words are sought together.
PACK_TEXTS = 250


def token_pieces(text: Column, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> Column:
    """(tokens, crcs): the number of ids of a text with its end id, and the CRC-32 of each cut piece."""
    end = np.array([end_id], "<u4").tobytes()
    result = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))])

    @F.arrow_udf(result)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, size = WordEncoder(tokenizer), 4 * length
        for column in batches:
            counts, sums = [], []
            own = list(texts(column))
            for at_text in range(0, len(own), PACK_TEXTS):
                for packed in encoder.pack(own[at_text : at_text + PACK_TEXTS]):
                    ids = packed + end
                    counts.append(len(ids) // 4)
                    sums.append([zlib.crc32(ids[at : at + size]) for at in range(0, len(ids), size)])
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["tokens", "crcs"]
            )

    return pieces(text)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of ``sizes`` within ``capacity`` of the greatest total price: (price, counts)."""
    useful = np.nonzero(prices > 1e-12)[0]
    useful = useful[np.argsort(sizes[useful])]
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    own, price = sizes[useful], prices[useful]
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        n = np.searchsorted(own, room, side="right")
        if n:
            totals = value[room - own[:n]] + price[:n]
            k = int(np.argmax(totals))
            if totals[k] > value[room]:
                value[room], choice[room] = totals[k], useful[k]
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(value[capacity]), counts


def _apply(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Product without threads of an algebra library, which may stall a driver that shares its cores."""
    return np.einsum("ij,j->i", matrix, vector)


def _pivot(inverse: np.ndarray, direction: np.ndarray, at: int) -> None:
    """Update the inverse in place for a basis whose column ``at`` became the column behind ``direction``."""
    row = inverse[at] / direction[at]
    inverse -= np.outer(direction, row)
    inverse[at] = row


def greedy_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis and its inverse: patterns filled from the largest class down, each used until a
    class runs out; it then takes this class's column, and no later pattern holds the class.
    """
    left, basis, inverse = demand.astype(float), np.eye(len(sizes)), np.eye(len(sizes))
    order = np.argsort(-sizes)
    open_ = np.ones(len(sizes), bool)
    for _ in range(len(sizes)):
        counts, room = np.zeros(len(sizes)), capacity
        for c in order:
            if open_[c] and sizes[c] <= room:
                fits = room // sizes[c]
                # One pattern should not spend a class on itself while larger gaps need it.
                counts[c] = fits if not counts.any() or room - sizes[c] * fits == 0 else 1
                room -= int(counts[c]) * sizes[c]
        uses = np.where(counts > 0, left / np.maximum(counts, 1), np.inf)
        gone = int(np.argmin(uses))
        left = np.maximum(left - uses[gone] * counts, 0.0)
        left[gone], open_[gone] = 0.0, False
        basis[:, gone] = counts
        _pivot(inverse, counts, gone)  # classes that ran out before are not in counts: no change of direction
    return basis, inverse


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional uses: the fewest sequences whose patterns hold ``demand``.

    Revised simplex on the equality form, from the patterns of :func:`greedy_basis`.
    """
    basis, inverse = greedy_basis(sizes, demand, capacity)
    uses = np.maximum(_apply(inverse, demand), 0.0)
    for _ in range(ROUNDS):
        prices = inverse.sum(axis=0)
        best, column = best_pattern(prices, sizes, capacity)
        # prices / best is dual feasible, so uses.sum() / best is a lower bound.
        if best <= 1 + GAP or uses.sum() * (1 - 1 / best) < 0.5:
            break
        direction = _apply(inverse, column)
        ratios = np.where(direction > 1e-9, uses / np.maximum(direction, 1e-9), np.inf)
        leaving = int(np.argmin(ratios))
        step = ratios[leaving]
        if not np.isfinite(step):
            break
        uses = np.maximum(uses - step * direction, 0.0)
        uses[leaving] = step
        basis[:, leaving] = column
        _pivot(inverse, direction, leaving)
    return basis, uses


def plan_sequences(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(class counts of a pattern, number of sequences), which together hold exactly ``demand``."""
    if not len(sizes):
        return []
    basis, uses = solve_patterns(sizes, demand.astype(float), capacity)
    whole = np.floor(uses + 1e-6).astype(np.int64)
    counts = np.rint(basis).astype(np.int64)
    rest = demand - np.einsum("ij,j->i", counts, whole)
    while (rest < 0).any():  # only where floating point rounded a use up
        short = int(np.argmin(rest))
        k = int(np.nonzero((counts[short] > 0) & (whole > 0))[0][0])
        whole[k] -= 1
        rest += counts[:, k]
    plan = [(counts[:, k], int(whole[k])) for k in range(len(whole)) if whole[k]]
    # First-fit decreasing for what rounding left: fewer items than all patterns hold once.
    room, bins = np.empty(0, np.int64), []
    for c in np.argsort(-sizes):
        for _ in range(rest[c]):
            fits = np.nonzero(room >= sizes[c])[0]
            if not len(fits):
                room, fits = np.append(room, capacity), [len(room)]
                bins.append(np.zeros(len(sizes), np.int64))
            bins[fits[0]][c] += 1
            room[fits[0]] -= sizes[c]
    return plan + [(b, 1) for b in bins]


def _claims(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, pieces of the class in each sequence)."""
    taken, sequence, rows = np.zeros(len(sizes), np.int64), 0, []
    for counts, times in plan:
        for c in np.nonzero(counts)[0]:
            held = int(counts[c]) * times
            rows.append((int(sizes[c]), int(taken[c]), int(taken[c]) + held, sequence, int(counts[c])))
            taken[c] += held
        sequence += times
    return rows


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    length: int = LENGTH, grain: int = GRAIN, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows and ids are packed each for itself. An
    empty table gives an empty table. Sequence ids run from 0; offsets within one have no gap.
    """
    if length % grain:
        raise ValueError("grain must divide length")
    found = docs.select(F.col(doc_id).alias("doc_id"), token_pieces(F.col(text), tokenizer, length, end_id).alias("p"))
    # The number holds the task in its upper bits and counts in it; written once, it is the same for every reader.
    rows = stage(found.withColumn("row", F.monotonically_increasing_id()), "tokens")
    pieces = rows.select(
        "row", "doc_id", F.col("p.tokens").alias("doc_tokens"), F.posexplode("p.crcs").alias("at", "ids_crc32")
    ).select(
        "row", "doc_id", (F.col("at") * F.lit(length)).cast("long").alias("start"),
        F.least(F.lit(length), F.col("doc_tokens") - F.col("at") * length).cast("long").alias("length"), "ids_crc32", "doc_tokens",
    )
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    # A block of 4,096 numbers of one task: no group is larger than its pieces.
    pieces = pieces.withColumn("part", F.shiftright("row", 12))
    counts = stage(pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n")), "histogram")
    histogram = sorted((r["class"], r["n"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect())
    sizes, demand = np.array([c for c, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    claims = _claims(sizes, plan_sequences(sizes, demand, length // grain))

    # Rank in the class = rank among the pieces of the class and block + pieces of the class in earlier blocks.
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    inside = Window.partitionBy("class", "part").orderBy("row", "start")
    ranked = attach(pieces.withColumn("inside", F.row_number().over(inside)), offsets, ["class", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside") - 1)
    # At most a few claims per basic pattern and class: bounded by the number of classes.
    claimed = docs.sparkSession.createDataFrame(claims, "class int, first long, last long, base long, each long")
    placed = ranked.join(F.broadcast(claimed), "class").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - first) div each"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"),
    )
