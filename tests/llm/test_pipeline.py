"""The pipeline on the smallest tables, stage by stage, and the queries as registered."""

import os

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from jostle.llm import packing, pii

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


def test_all_are_registered():
    names = set(queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(oracle_sql()) <= names


def test_url_filter_equals_sql(spark):
    got = sorted(tuple(map(str, r)) for r in queries()["op7_url_filter"](spark, DATA).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{DATA}/pages.parquet')")
    assert got == sorted(tuple(map(str, r)) for r in con.sql(oracle_sql()["op7_url_filter"]).fetchall())


def test_stages_narrow_the_corpus_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen, everything = docs.columns, [docs], {r["doc_id"] for r in docs.collect()}
    for k, (_, stage_of) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage_of(spark, seen[-1], DATA).write.parquet(path)
        seen.append(spark.read.parquet(path))
    ids = [[r["doc_id"] for r in x.select("doc_id").collect()] for x in seen]
    for before, after in zip(ids, ids[1:-1], strict=False):
        assert set(after) <= set(before) and len(after) <= len(before)
    assert all(x.columns == columns for x in seen[:-1]) and set(ids[0]) == everything
    assert 0 < len(ids[1]) < len(ids[0]) and len(ids[3]) == len(ids[2])
    assert all(r["spans"] == "" for r in pii.digest(seen[3]).collect())
    assert set(ids[5]) == set(ids[4])
    run = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(map(str, run)) == sorted(map(str, seen[5].collect()))
    assert corpus_pipeline.ORACLE_SQL is None and packing.LENGTH == 4096
