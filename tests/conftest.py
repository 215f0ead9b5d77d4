import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from jostle.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows("a long, b double", [...]) -> DataFrame"""
    return lambda schema, data: spark.createDataFrame(data, schema)


def collect(df, *order):
    """Rows as tuples, sorted by ``order`` or by all columns."""
    chosen = list(order) or df.columns
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(v) for v in r)) if not order else [
        tuple(r) for r in df.orderBy(*chosen).collect()
    ]


@pytest.fixture
def table():
    return collect
