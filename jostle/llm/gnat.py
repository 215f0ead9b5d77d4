"""Exact search of score windows by a multiway hyperplane tree with distance ranges (GNAT), and hard negatives with it.

Vectors are taken as integers, floor(256 x). One further component, sqrt(M - |x|^2) with M the largest squared norm, puts all
stored vectors on one sphere, so a window of inner products with a query is an annulus of Euclidean distances around it
(the query's further component is zero).

The tree is grown on a bounded sample: the split points of a node are far from each other, a vector goes to the nearest one,
and for every pair of split points i, j a node keeps the range of distances from i to the vectors below j. The ranges are
taken over *all* vectors. A query skips child j if, for some i, its annulus and the range cannot meet by the triangle
inequality. Leaves are scanned in exact integers, so nothing is missed and nothing is guessed.

Leaves are cut into chunks and their queries into blocks; a task gets one chunk with one block that visits its leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jostle.plans.staging import stage

#: Vectors that the split points are chosen from, at most; every vector is indexed.
FIT_ROWS = 10_000
#: Split points of a node, levels at most, and vectors that a leaf should hold.
FANOUT, LEVELS, LEAF_ROWS = 12, 3, 1_000
CHUNK_ROWS, BLOCK_QUERIES = 4_000, 1_000
SCALE = 256
#: Sums below this are exact in double precision; above it Python's integers do the scan.
_EXACT = 2.0**53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


# ---------------------------------------------------------------- vectors


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & F.coalesce(~F.exists(vector, bad), F.lit(False))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 x), as doubles (which hold it exactly)."""
    return np.floor(SCALE * values)


def raised(numbers: np.ndarray, squared: float) -> np.ndarray:
    """The vectors with the further component that puts them on the sphere."""
    rest = np.sqrt(np.maximum(squared - np.einsum("ij,ij->i", numbers, numbers), 0))
    return np.concatenate([numbers, rest[:, None]], axis=1)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", points, points)[:, None] - 2 * points @ centres.T + np.einsum("ij,ij->i", centres, centres)[None]
    return np.sqrt(np.maximum(square, 0))


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; beyond 64 bits they are clipped to the ends of that range."""
    bound = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(left.shape[1], 1)
    if bound < _EXACT:
        return np.rint(left @ right.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in right] for x in left]
    return np.array([[min(max(v, _LEAST), _MOST) for v in row] for row in exact], np.int64).reshape(len(left), len(right))


# ---------------------------------------------------------------- tree


class Tree:
    """Split points by node; ``child`` is the number of a node, or -1 - the number of a leaf."""

    def __init__(self, centres: list[np.ndarray], children: list[list[int]], leaves: int):
        self.centres, self.children, self.leaves = centres, children, leaves
        self.low = [np.full((len(c), len(c)), np.inf) for c in centres]
        self.high = [np.full((len(c), len(c)), -np.inf) for c in centres]

    @staticmethod
    def grown(points: np.ndarray, levels: int, fanout: int) -> Tree:
        """Split points far from each other, chosen among ``points``; children with fewer points than ``fanout`` are leaves."""
        centres: list[np.ndarray] = []
        children: list[list[int]] = []
        leaves = 0

        def leaf() -> int:
            nonlocal leaves
            leaves += 1
            return -leaves

        def grow(own: np.ndarray, level: int) -> int:
            if level == levels or len(own) <= fanout:
                return leaf()
            chosen = [0]
            nearest = distances(own, own[:1])[:, 0]
            while len(chosen) < fanout and nearest.max() > 1e-6 * (1 + np.abs(own).max()):
                chosen.append(int(nearest.argmax()))
                nearest = np.minimum(nearest, distances(own, own[chosen[-1:]])[:, 0])
            if len(chosen) == 1:
                return leaf()
            number = len(centres)
            centres.append(own[chosen])
            children.append([])
            at = distances(own, own[chosen]).argmin(axis=1)
            children[number] = [grow(own[at == j], level + 1) for j in range(len(chosen))]
            return number

        grow(points, 0)
        return Tree(centres, children, leaves)

    def descend(self, points: np.ndarray, watch: bool = False) -> np.ndarray:
        """The leaf of every point; with ``watch`` the distance ranges take the points in."""
        leaf = np.zeros(len(points), np.int64)
        todo = [(0 if self.centres else -1, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                leaf[at] = -1 - node
            elif len(at):
                far = distances(points[at], self.centres[node])
                near = far.argmin(axis=1)
                for j, child in enumerate(self.children[node]):
                    mine = near == j
                    if watch and mine.any():
                        self.low[node][:, j] = np.minimum(self.low[node][:, j], far[mine].min(axis=0))
                        self.high[node][:, j] = np.maximum(self.high[node][:, j], far[mine].max(axis=0))
                    todo.append((child, at[mine]))
        return leaf

    def visited(self, point: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> list[int]:
        """Leaves that may hold a vector whose distance lies in one of the annuli ``inner[w] .. outer[w]``."""
        found, todo = [], [0 if self.centres else -1]
        while todo and len(inner):
            node = todo.pop()
            if node < 0:
                found.append(-1 - node)
                continue
            far = distances(point[None], self.centres[node])[0][:, None]
            low, high = self.low[node], self.high[node]
            least = np.maximum(far - high, low - far).max(axis=0) - slack  # bounds on the distance to what is below j
            most = (far + high).min(axis=0) + slack
            filled = np.isfinite(low).all(axis=0)
            meets = filled & ((least[:, None] <= outer[None]) & (most[:, None] >= inner[None])).any(axis=1)
            todo += [self.children[node][j] for j in np.nonzero(meets)[0]]
        return found


class Index:
    """The staged vectors (row, id, label, v, asks, leaf, chunk) with their tree."""

    def __init__(self, rows: DataFrame, tree: Tree, squared: float, chunks: dict[int, int]):
        self.rows, self.tree, self.squared, self.chunks = rows, tree, squared, chunks


def annulus(query: np.ndarray, squared: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances at which the inner product with ``query`` lies in ``low .. high``."""
    base = query @ query + squared
    return np.sqrt(np.maximum(base - 2 * high, 0)), np.sqrt(np.maximum(base - 2 * low, 0))


def slack(query: np.ndarray, squared: float) -> float:
    """A bound on the rounding of distances and scores in double precision."""
    return 1e-6 * (np.sqrt(query @ query) + np.sqrt(squared)) + 1e-6


def _sample(rows: DataFrame, total: int) -> np.ndarray:
    share = min(1.0, 0.9 * FIT_ROWS / max(total, 1))
    picked = rows.where(F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1 << 20)) < share * (1 << 20)).select("v").limit(FIT_ROWS).toArrow()
    points = whole(matrix(picked.column("v")))
    return points[np.lexsort(points.T[:4])] if len(points) else points  # in no order of tasks


def build(rows: DataFrame, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS, chunk_rows: int = CHUNK_ROWS) -> Index | None:
    """Index of ``rows`` (row, id, label, v, asks), staged with one length of ``v``; None without rows."""
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most = 0, 0.0
        for batch in batches:
            numbers = whole(matrix(batch.column("v")))
            n, most = n + len(numbers), max(most, float(np.einsum("ij,ij->i", numbers, numbers).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([most], pa.float64())], names=["n", "most"])

    total, squared = rows.select("v").mapInArrow(norms, "n long, most double").agg(F.sum("n"), F.max("most")).first()
    if not total:
        return None
    levels = 0
    while levels < LEVELS and total > leaf_rows * fanout**levels:
        levels += 1
    tree = Tree.grown(raised(_sample(rows, total), squared), levels, fanout)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Tree(tree.centres, tree.children, tree.leaves)
        filled: dict[int, int] = {}
        for batch in batches:
            if batch.num_rows:
                for leaf, n in zip(*np.unique(mine.descend(raised(whole(matrix(batch.column("v"))), squared), watch=True), return_counts=True), strict=True):
                    filled[int(leaf)] = filled.get(int(leaf), 0) + int(n)
        out = [(-1, leaf, 0, float(n), 0.0) for leaf, n in filled.items()]
        for node, (low, high) in enumerate(zip(mine.low, mine.high, strict=True)):
            out += [(node, int(i), int(j), float(low[i, j]), float(high[i, j])) for i, j in zip(*np.nonzero(np.isfinite(low)), strict=True)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["node", "i", "j", "low", "high"])

    seen = rows.select("v").mapInArrow(ranges, "node int, i int, j int, low double, high double")
    least = F.when(F.col("node") < 0, F.sum("low")).otherwise(F.min("low"))
    # At most fanout rows for each split point reach the driver, whatever the number of vectors.
    chunks: dict[int, int] = {}
    for r in seen.groupBy("node", "i", "j").agg(least.alias("low"), F.max("high").alias("high")).collect():
        if r["node"] < 0:
            chunks[r["i"]] = max(1, -(-int(r["low"]) // chunk_rows))
        else:
            tree.low[r["node"]][r["i"], r["j"]], tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.descend(raised(whole(matrix(batch.column("v"))), squared)) if batch.num_rows else np.zeros(0, np.int64)
            many = np.array([chunks.get(int(x), 1) for x in leaf], np.int64)
            chunk = batch.column("row").to_numpy() * 2_654_435_761 % (1 << 32) % np.maximum(many, 1) if len(leaf) else leaf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32()), pa.array(chunk, pa.int32())], names=[*batch.schema.names, "leaf", "chunk"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return Index(stage(rows.mapInArrow(placed, f"{schema}, leaf int, chunk int"), "gnat"), tree, squared, chunks)


# ---------------------------------------------------------------- search

_ASKS = "row long, label long, v array<double>, low array<long>, high array<long>"


def scan(index: Index, probes: DataFrame, same: bool, k: int, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(row, window, id, score): the ``k`` best rows in each window of every query, from the leaves it visits.

    ``probes`` are (row, label, v, low, high, leaf), one for each leaf to visit, staged; window w holds the scores low[w] to high[w].
    ``same`` asks for rows of the query's label other than itself, else for rows of other labels.
    """
    spark = probes.sparkSession
    visits = {r["leaf"]: r["count"] for r in probes.groupBy("leaf").count().collect()}  # a number for each leaf
    facts = [(leaf, index.chunks.get(leaf, 1), -(-n // block_queries)) for leaf, n in visits.items()]
    sizes = F.broadcast(spark.createDataFrame(facts, "leaf int, chunks int, blocks int")) if facts else None
    schema = "row long, window int, id long, score long"
    if sizes is None:
        return topmost(spark.createDataFrame([], schema), ["row", "window"], k)
    asked = probes.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks", "blocks")
    held = index.rows.select("row", "id", "label", "v", "leaf", "chunk").join(sizes, "leaf")
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("chunks", "blocks")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        rows_, windows, ids_, found = [], [], [], []
        if left.num_rows and right.num_rows:
            ids, numbers = right.column("id").to_numpy(), right.column("row").to_numpy()
            labels = right.column("label").to_numpy()
            table = scores(whole(matrix(left.column("v"))), whole(matrix(right.column("v"))))
            lows, highs = left.column("low").to_pylist(), left.column("high").to_pylist()
            for q, (row, label) in enumerate(zip(left.column("row").to_pylist(), left.column("label").to_pylist(), strict=True)):
                fit = (labels == label) & (numbers != row) if same else labels != label
                fit &= (table[q] >= min(lows[q])) & (table[q] <= max(highs[q]))
                at = np.nonzero(fit)[0]
                at = at[np.lexsort((ids[at], ~table[q][at]))]  # ~x falls as x rises, without overflow
                own = table[q][at]
                for w, (low, high) in enumerate(zip(lows[q], highs[q], strict=True)):
                    for x in at[(own >= low) & (own <= high)][:k].tolist():
                        rows_.append(row), windows.append(w), ids_.append(int(ids[x])), found.append(int(table[q][x]))
        return pa.table([pa.array(rows_, pa.int64()), pa.array(windows, pa.int32()), pa.array(ids_, pa.int64()), pa.array(found, pa.int64())], names=["row", "window", "id", "score"])

    keys = ["leaf", "chunk", "block"]
    near = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, schema)
    return topmost(near, ["row", "window"], k)


def topmost(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best of each query, from ``k`` of every visited chunk."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def probe(index: Index, asks: DataFrame, beside_home: bool = False) -> DataFrame:
    """A row for each leaf that a query of ``asks`` (row, label, v, low, high, leaf) must visit; ``beside_home`` leaves out its own leaf."""
    tree, squared = index.tree, index.squared

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = whole(matrix(batch.column("v")))
            at, leaves = [], []
            for n, (low, high, home) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("low", "high", "leaf")), strict=True)):
                inner, outer = annulus(values[n], squared, np.array(low, float), np.array(high, float))
                open_ = [leaf for leaf in tree.visited(np.append(values[n], 0.0), inner, outer, slack(values[n], squared)) if not (beside_home and leaf == home)]
                at += [n] * len(open_)
                leaves += open_
            chosen = batch.select(["row", "label", "v", "low", "high"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(leaves, pa.int32())], names=[*chosen.schema.names, "leaf"])

    return stage(asks.mapInArrow(routed, f"{_ASKS}, leaf int"), "probes")


def nearest_of_label(index: Index, asks: DataFrame, k: int) -> DataFrame:
    """(row, place, id, score): the ``k`` other rows of its label with the highest scores, for each query.

    The query's own leaf is scanned first; its k-th best score bounds the annulus for all other leaves.
    """
    least, most = F.array(F.lit(_LEAST)), F.array(F.lit(_MOST))
    home = asks.select("row", "label", "v", least.alias("low"), most.alias("high"), "leaf")
    first = stage(scan(index, stage(home, "home"), True, k), "first")
    bound = first.where(F.col("place") == k).select("row", F.array("score").alias("low"))
    wide = asks.join(bound, "row", "left").select("row", "label", "v", F.coalesce("low", least).alias("low"), most.alias("high"), "leaf")
    others = scan(index, probe(index, wide, beside_home=True), True, k)
    return topmost(first.drop("place").unionByName(others.drop("place")), ["row"], k).drop("window")


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 5,
    low: tuple[int, int] = (4, 5), fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS, chunk_rows: int = CHUNK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For every row where ``anchors`` holds and each of its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of other labels whose score is at least ``low`` (a fraction) of the positive's and at most the positive's. Scores
    are integer inner products with the anchor; higher scores come first, ties go to the smaller id, copies of a row are rows.

    Rows without id, label or vector, and those with a component that is null or not finite, take no part; neither do
    vectors of another than the commonest length. No rows give no rows. A score beyond 64 bits counts as the end of that range.
    """
    own = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull() & label.isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("asks"), F.size(vector).alias("length"),
    )
    rows = stage(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = rows.where("length > 0").groupBy("length").count().orderBy(F.desc("count"), "length").limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not lengths:
        return empty
    index = build(rows.where(F.col("length") == lengths[0]["length"]).drop("length"), fanout, leaf_rows, chunk_rows)
    asks = stage(index.rows.where("asks").select("row", "id", "label", "v", "leaf"), "anchors")
    near = stage(nearest_of_label(index, asks.drop("id"), positives), "positives")
    over, under = low
    # The least score that is low enough: ceil(over / under * score), in integers.
    lists = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    score = lambda p: p["score"].cast("decimal(38,0)")
    ceiling = lambda p: -F.floor(-(score(p) * over) / F.lit(under).cast("decimal(38,0)"))
    windows = lists.select(
        "row", "p", F.transform("p", lambda p: F.least(ceiling(p), F.lit(_MOST).cast("decimal(38,0)")).cast("long")).alias("low"), F.transform("p", lambda p: p["score"]).alias("high")
    )
    windows = stage(windows, "windows")
    wanted = asks.join(windows.select("row", "low", "high"), "row")
    hard = scan(index, probe(index, wanted.select("row", "label", "v", "low", "high", "leaf")), False, negatives, block_queries)
    named = hard.join(windows.select("row", "p"), "row").join(asks.select("row", F.col("id").alias("anchor_id")), "row")
    positive = F.get("p", F.col("window"))
    return named.select(
        "anchor_id", positive["id"].alias("positive_id"), F.col("place").alias("rank"), F.col("id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
