"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own, so ``k`` centroids a side make ``k * k`` cells. A
query visits cells in the order of the summed distances of their two centroids, taken from a heap, until
they hold enough candidates; all candidates are reranked by their exact distance.

How many candidates are enough is calibrated: for a bounded sample of queries the true neighbours are
found by a scan, and the number is set so that the sample reaches the wanted recall. Data without
structure then costs a large part of a scan, clustered data little.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.plans.joins import BROADCAST_BYTES, measured_bytes
from jostle.plans.staging import stage

NEIGHBOURS = 10
#: Vectors that the codebooks are fitted on at most, and queries that the calibration scans for.
FIT_ROWS = 10_000
SAMPLE_QUERIES = 64
#: Recall on the sample; the margin is for queries outside it.
RECALL = 0.98
#: Vectors and queries that one group holds.
CHUNK_ROWS = 8_000
CHUNK_QUERIES = 4_096
ROUNDS = 8


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components present and finite."""
    value = F.transform(vector, lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & F.coalesce(~F.exists(value, bad) & F.exists(value, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Rows of a list column; all lists have the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (vectors.shape[1] + 1) // 2
    return vectors[:, :middle], vectors[:, middle:]


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if not points.shape[1]:  # vectors of one component have an empty second half
        return np.zeros((len(points), len(centres)))
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None], 0)


def _codebook(points: np.ndarray, k: int) -> np.ndarray:
    random = np.random.default_rng(5)
    centres = points[random.permutation(len(points))[:k]].copy()
    for _ in range(ROUNDS):
        near = np.argmin(_squared(points, centres), axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def codebooks(rows: DataFrame, total: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves, fitted in one task on a sample of ``rows`` (row, v) bounded by ``FIT_ROWS``."""
    share = min(1.0, 0.9 * FIT_ROWS / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)).select("v").limit(FIT_ROWS)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b.column("v")) for b in batches if b.num_rows]
        if parts:
            points = np.concatenate(parts)
            points = points[np.lexsort(points.T[:3])]  # the order of tasks does not matter
            for side, half in enumerate(_halves(points)):
                centres = _codebook(half, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([side] * len(centres), pa.int32()), pa.array(centres.tolist(), pa.list_(pa.float64()))], names=["side", "centre"]
                )

    found = sample.repartition(1).mapInArrow(fitted, "side int, centre array<double>").collect()
    return tuple(np.array([r["centre"] for r in found if r["side"] == s], dtype=float).reshape(-1, len(next(r["centre"] for r in found if r["side"] == s))) for s in (0, 1))


def cells(vector: Column, books: tuple[np.ndarray, np.ndarray]) -> Column:
    """(a, b): the nearest centroid of each half."""
    @F.arrow_udf(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    def nearest(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.StructArray.from_arrays([pa.array([], pa.int32())] * 2, names=["a", "b"])
        found = [np.argmin(_squared(half, book), axis=1).astype(np.int32) for half, book in zip(_halves(_matrix(column)), books, strict=True)]
        return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in found], names=["a", "b"])

    return nearest(vector)


def visit(vector: np.ndarray, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(a, b, candidates so far) of the filled cells, by summed distance: the multi-sequence walk over a heap."""
    first, second = (_squared(half, book)[0] for half, book in zip(_halves(vector[None]), books, strict=True))
    order_a, order_b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    first, second = first[order_a].tolist(), second[order_b].tolist()
    heap, reached, total = [(first[0] + second[0], 0, 0)], [0] * len(first), 0
    while heap:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        a, b = int(order_a[i]), int(order_b[j])
        if counts[a, b]:
            total += int(counts[a, b])
            yield a, b, total
        # The next cell below once the one beside it is done, and the next cell beside once the one below is.
        if i + 1 < len(first) and reached[i + 1] == j:
            heapq.heappush(heap, (first[i + 1] + second[j], i + 1, j))
        if j + 1 < len(second) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))


def nearest_rows(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, distances) of the ``k`` nearest vectors, nearest first, ties by id; exact in double precision."""
    difference = vectors - query
    squared = np.einsum("ij,ij->i", difference, difference)
    if len(squared) > k:
        at = np.nonzero(squared <= np.partition(squared, k - 1)[k - 1])[0]
    else:
        at = np.arange(len(squared))
    at = at[np.lexsort((ids[at], squared[at]))][:k]
    return at, np.sqrt(squared[at])


def _needed(index: DataFrame, queries: DataFrame, books, counts: np.ndarray, k: int, recall: float) -> int:
    """Candidates that the sampled queries need for ``recall``, by the cells of their true neighbours."""
    sample = queries.orderBy(F.xxhash64("row", F.lit(3))).limit(SAMPLE_QUERIES).select("row", "id", "v").collect()
    asked = [(r["row"], np.array(r["v"], float)) for r in sample]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {row: [] for row, _ in asked}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, ids = _matrix(batch.column("v")), batch.column("id").to_numpy()
            a, b, rows_ = (batch.column(c).to_numpy() for c in ("a", "b", "row"))
            for row, vector in asked:
                other = np.nonzero(rows_ != row)[0]
                at, distance = nearest_rows(vector, vectors[other], ids[other], k)
                at = other[at]
                merged = best[row] + list(zip(distance.tolist(), ids[at].tolist(), a[at].tolist(), b[at].tolist(), strict=True))
                best[row] = sorted(merged)[:k]
        flat = [(row, *x) for row, found in best.items() for x in found]
        columns = list(zip(*flat, strict=True)) if flat else [()] * 5
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "d", "id", "a", "b"])

    near = index.select("row", "id", "v", "a", "b").mapInArrow(scanned, "row long, d double, id long, a int, b int")
    place = F.row_number().over(Window.partitionBy("row").orderBy("d", "id"))
    true: dict[int, list] = {}
    for r in near.withColumn("n", place).where(F.col("n") <= k).collect():  # k rows for each sampled query
        true.setdefault(r["row"], []).append((r["a"], r["b"]))
    costs = []
    for row, vector in asked:
        wanted = true.get(row, [])
        seen = {(a, b): total for a, b, total in visit(vector, books, counts)}
        costs += [seen[c] for c in wanted]
    return int(np.quantile(costs, recall, method="higher")) if costs else 0


def search(
    vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding",
    neighbours: int = NEIGHBOURS, recall: float = RECALL, chunk_rows: int = CHUNK_ROWS, k: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found rows of each row for which ``queries`` holds.

    ``score`` is the Euclidean distance of the original vectors; ties go to the smaller id. A row is not its
    own candidate, but another row with its id is. Rows without an id, and unusable vectors (null, zero, a component
    null or not finite), take no part; neither do vectors of another than the commonest length. A repeated
    query row is answered once for each row.
    """
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    own = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), wide.alias("v"), queries.alias("asks"), F.size(vector).alias("length")
    )
    rows = stage(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = rows.groupBy("length").count().orderBy(F.desc("count"), "length").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.col("length") == lengths[0]["length"])
    total = lengths[0]["count"]
    k = k or int(min(256, max(4, round(2 * total**0.25))))
    books = codebooks(rows, total, k)
    index = rows.select("row", "id", "v", "asks", cells(F.col("v"), books).alias("c")).select("row", "id", "v", "asks", "c.a", "c.b")
    index = stage(index, "index")
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)  # one number for each cell reaches the driver
    for r in index.groupBy("a", "b").count().collect():
        counts[r["a"], r["b"]] = r["count"]
    asking = index.where("asks").select("row", "id", "v")
    enough = max(_needed(index, asking, books, counts, neighbours, recall), neighbours + 1)

    # A group is a row of cells (one centroid of the first half), cut into chunks of bounded size.
    chunks = np.maximum(1, -(-counts.sum(axis=1) // chunk_rows)).tolist()

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, own_id, values in zip(*(batch.column(n).to_pylist() for n in ("row", "id", "v")), strict=True):
                by_first: dict[int, list[int]] = {}
                for a, b, seen in visit(np.array(values, float), books, counts):
                    by_first.setdefault(a, []).append(b)
                    if seen >= enough:
                        break
                out += [(row, own_id, values, a, bs, s) for a, bs in by_first.items() for s in range(chunks[a])]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int32()), pa.int32())
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "id", "v", "a", "bs", "chunk"])

    asked = total if total < 1 else asking.count()
    blocks = max(1, -(-asked // CHUNK_QUERIES))
    probes = asking.repartition(max(1, min(asked, index.sparkSession.sparkContext.defaultParallelism * 2)), "row")
    probes = probes.mapInArrow(visited, "row long, id long, v array<double>, a int, bs array<int>, chunk int")
    probes = stage(probes.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "probes")
    many = F.get(F.array(*[F.lit(int(c)) for c in chunks]), F.col("a"))
    # A vector goes to the blocks in which some query visits its cell, and to no others.
    pairs = stage(probes.where("chunk = 0").select("a", F.explode("bs").alias("b"), "block").distinct(), "pairs")
    dealt = index.select("row", "id", "v", "a", "b", F.pmod(F.xxhash64("row"), many).cast("int").alias("chunk"))
    dealt = dealt.join(F.broadcast(pairs) if measured_bytes(pairs) <= BROADCAST_BYTES else pairs, ["a", "b"])

    def reranked(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            vectors_, ids, seconds, rows_ = _matrix(right.column("v")), *(right.column(c).to_numpy() for c in ("id", "b", "row"))
            order = np.argsort(seconds, kind="stable")
            vectors_, ids, seconds, rows_ = vectors_[order], ids[order], seconds[order], rows_[order]
            for row, own_id, values, bs in zip(*(left.column(n).to_pylist() for n in ("row", "id", "v", "bs")), strict=True):
                at = np.nonzero(np.isin(seconds, bs) & (rows_ != row))[0]
                near, distance = nearest_rows(np.array(values, float), vectors_[at], ids[at], neighbours)
                found += [(row, own_id, int(i), float(d)) for i, d in zip(ids[at[near]], distance, strict=True)]
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "query_id", "vec_id", "score"])

    keys = ["a", "chunk", "block"]
    scored = probes.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(reranked, "row long, query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
