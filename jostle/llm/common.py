"""Shared pieces of the operators: tables, row keys, byte-wise words, cached word values."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jostle.plans.staging import stage

# Functions travel to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules["jostle.llm"])

#: The white space that separates words, as a Java regular expression: space and \t to \r.
SPACE = r"[\x20\x09-\x0D]+"
#: Values of words that a Python worker keeps; beyond it the cache starts anew, so memory is bounded.
CACHE_WORDS = 100_000
#: Rows in an Arrow batch: texts can be long, and a batch is held whole by a Python worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Batches small enough for long texts; left alone where they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names clash regardless of case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` staged with a unique row number, so equal rows and repeated ids stay apart.

    The number is made once and read back, so a lost executor cannot change it.
    """
    return stage(df.withColumn(column, F.monotonically_increasing_id()), name)


def word_array(text: Column) -> Column:
    """Words of a text, without empty ones; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


class WordCache(dict):
    """Word -> value, filled on demand by ``make`` and emptied when it has grown to ``limit``.

    Call :meth:`trim` between texts, not within one.
    """

    def __init__(self, make: Callable, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def texts(column, cache: WordCache | None = None) -> Iterator[str]:
    """Python strings of an Arrow column, null as empty; ``cache`` is trimmed before each. At its end, memory of earlier
    batches goes back to the system: an idle Python worker would keep it beside the executor."""
    for value in column:
        if cache is not None:
            cache.trim()
        yield value.as_py() or ""
    pa.default_memory_pool().release_unused()
