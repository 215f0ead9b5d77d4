"""Descriptors of vectors of a known length: equal to those of any length, and compiled."""

from pyspark.sql import functions as F

from jostle.functions import scores as S

DATA = [([3, 1, 4], [1, 5, 9], 0), ([0, 0, 0], [2, 6, 5], 1), ([3, None, 4], [1, 2, 3], 2), (None, [1, 2, 3], 1), ([1, 2, 3], [1, 2, 3], None), ([7, 7, 2], [0, 0, 0], 2)]


def described(size):
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    return [
        S.target_margin(a, t, size), S.l2(a, size), S.squared_change(a, b, size), S.l2_change(a, b, size), S.linf_change(a, b, size), S.dot(a, b, size), S.cosine_distance(a, b, size),
    ]


def test_known_lengths_give_the_same_without_lambdas(spark):
    df = spark.createDataFrame(DATA, "a array<long>, b array<long>, t int")
    known, free = df.select(*described(3)), df.select(*described(None))
    assert [tuple(r) for r in known.collect()] == [tuple(r) for r in free.collect()]
    assert "lambda" not in known._jdf.queryExecution().toString() and "lambda" in free._jdf.queryExecution().toString()
