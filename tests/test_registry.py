"""The registered queries against their SQL on the smallest tables, and the model surface."""

import os

import duckdb
import pytest

import check_oracles as K
from __spark_entry__ import entry, oracle_sql, queries
from jostle.catalog import load
from jostle.catalog.fixtures import fixture
from jostle.catalog.runs import linear_model_factory
from jostle.operators import scoring as SC

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in K.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    known = load()
    assert set(known.ORACLES) == set(known.QUERIES)
    assert set(known.QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    got = {r["outcome"]: (r["unique_n"], r["event_weighted_n"]) for r in entry(spark).collect()}
    assert got["class_preserved"] == (10477, 11766) and got["adverse"] == (177, 191) and got["lateral"] == (0, 0)


@pytest.mark.parametrize("name", sorted(load().QUERIES))
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = [tuple(K.plain(r[c]) for c in columns) for r in df.select(*columns).collect()]
    relation = con.sql(oracle_sql()[name])
    place = [relation.columns.index(c) for c in columns]
    theirs = [tuple(K.plain(r[i]) for i in place) for r in relation.fetchall()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)


@pytest.mark.parametrize("reverse", [False, True])
def test_python_model_equals_the_column_scorer(spark, reverse):
    x = fixture(spark, DATA)
    scored = SC.score_batches(SC.tensors(x.cells), linear_model_factory(5), 7, reverse=reverse)
    joined = scored.withColumnRenamed("scores", "m").join(x.sources, "source_id").collect()
    assert len(joined) == 10 and all(list(r["m"]) == [float(s) for s in r["scores"]] for r in joined)


def test_invalid_model_output_fails(spark):
    x = fixture(spark, DATA)

    def broken():
        def model(batch, lengths):
            import numpy as np

            return np.full((len(batch), 5), np.nan)

        return model

    with pytest.raises(Exception, match="invalid score output"):
        SC.score_batches(SC.tensors(x.cells), broken, 7).collect()
