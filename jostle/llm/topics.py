"""Topics: spherical k-means on hashed word vectors; every row takes part in every round."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.llm.common import WordCache, texts

TOPICS = 8
DIMENSIONS = 64
#: Words shorter than this say little about a topic.
LEAST_LETTERS = 4
ROUNDS = 4
#: Vectors among which the first centroids are sought.
SEED_ROWS = 256
_SCALE = 8192


def _vector(text: str, cache: WordCache) -> tuple[int, bytes]:
    words = text.split()
    at = np.array([cache[w] for w in words], dtype=np.int64)
    counts = np.bincount(at[at >= 0], minlength=DIMENSIONS).astype(float)
    weights = np.log1p(counts)
    weights -= weights.mean()
    norm = np.sqrt(weights @ weights)
    return len(words), np.rint(weights / (norm or 1.0) * _SCALE).astype("<i2").tobytes()


def word_vectors(text: Column) -> Column:
    """(words, vector): the number of words and a hashed, log-scaled word vector of length one, as int16."""
    result = T.StructType([T.StructField("words", T.LongType()), T.StructField("vector", T.BinaryType())])

    @F.arrow_udf(result)
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WordCache(lambda w: zlib.crc32(w.lower().encode()) % DIMENSIONS if len(w) >= LEAST_LETTERS else -1)
        for column in batches:
            found = [_vector(t, cache) for t in texts(column, cache)]
            yield pa.StructArray.from_arrays(
                [pa.array([n for n, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], names=["words", "vector"]
            )

    return vectors(text)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, DIMENSIONS).astype(np.int64)


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(vectors @ centroids.T, axis=1)


def _seeds(rows: DataFrame, vector: str) -> list[bytes]:
    """The ``SEED_ROWS`` distinct vectors with the smallest hashes; each task sends so many at most."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[int, bytes]] = set()
        for batch in batches:
            held.update((xxhash.xxh3_64_intdigest(v) >> 1, v) for v in batch.column(0).to_pylist())
            held = set(heapq.nsmallest(SEED_ROWS, held))
        found = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], names=["h", "v"])

    sent = rows.select(vector).mapInArrow(least, "h long, v binary").distinct()
    return [bytes(r["v"]) for r in sent.orderBy("h", "v").limit(SEED_ROWS).collect()]


def centroids(rows: DataFrame, vector: str = "vector", topics: int = TOPICS) -> np.ndarray:
    """Centroids of the vectors of ``rows`` (staged: it is read once a round).

    The driver gets the ``SEED_ROWS`` vectors with the smallest hashes of all rows, and then one sum per topic and round; sums are integers, so the
    result does not depend on the order of tasks or files. Fewer distinct vectors than topics leave topics unused.
    """
    seeds = sorted(_seeds(rows, vector))
    if not seeds:
        return np.zeros((1, DIMENSIONS))
    pool = np.array([np.frombuffer(s, "<i2") for s in seeds], dtype=float)
    chosen = [0]
    nearest = pool @ pool[0]
    while len(chosen) < min(topics, len(pool)):  # the one least like those chosen
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, pool @ pool[chosen[-1]])
    current = pool[chosen]

    for _ in range(ROUNDS):
        def sums(batches: Iterator[pa.RecordBatch], at=current) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(at), DIMENSIONS), np.int64)
            for batch in batches:
                if batch.num_rows:
                    vectors = _matrix(batch.column(0))
                    np.add.at(total, _nearest(vectors, at), vectors)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel(), pa.int64())], names=["at", "n"]
            )

        gathered = rows.select(vector).mapInArrow(sums, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(current.size)
        total[gathered.column("at").to_numpy()] = gathered.column("n").to_numpy()
        total = total.reshape(current.shape)
        norms = np.sqrt((total**2).sum(axis=1, keepdims=True))
        current = np.where(norms > 0, total / np.maximum(norms, 1) * _SCALE, current)
    return current


def topic(vector: Column, at: np.ndarray) -> Column:
    """The number of the nearest centroid."""
    @F.arrow_udf(T.IntegerType())
    def nearest(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.int32())
        return pa.array(_nearest(_matrix(column), at).astype(np.int32), pa.int32())

    return nearest(vector)
