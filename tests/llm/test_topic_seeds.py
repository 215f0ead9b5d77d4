"""First centroids of the topics."""

import numpy as np

from jostle.llm import topics


def test_first_centroids_do_not_depend_on_the_order_of_rows(spark):
    random = np.random.default_rng(1)
    vectors = [v.astype("<i2").tobytes() for v in random.integers(-3000, 3000, (40_000, topics.DIMENSIONS))]
    forward = spark.createDataFrame([(bytearray(v),) for v in vectors], "vector binary")
    backward = spark.createDataFrame([(bytearray(v),) for v in reversed(vectors)], "vector binary")
    assert (topics.centroids(forward) == topics.centroids(backward)).all()
