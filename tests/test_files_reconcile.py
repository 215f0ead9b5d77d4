"""Readers, writers, manifests, chunks and reconciliation."""

import hashlib
import json

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.functions.hashing import canonical_hash
from jostle.operators import reconcile as R
from jostle.operators import texts
from jostle.sources import chunks, files, manifest, ragged

CSV = T.StructType([T.StructField("id", T.LongType()), T.StructField("clean_correct", T.BooleanType())])


def test_strict_booleans(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("﻿id,clean_correct\n1,True\n2,False\n3,1\n4,0\n", encoding="utf-8")
    got = files.read_typed_csv(spark, str(tmp_path / "ok.csv"), CSV)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, True), (2, False), (3, True), (4, False)]
    inferred = files.read_typed_csv(spark, str(tmp_path / "ok.csv"))
    assert inferred.columns == ["id", "clean_correct"] and dict(inferred.dtypes)["clean_correct"] == "boolean"
    (tmp_path / "bad.csv").write_text("id,clean_correct\n1,2\n")
    with pytest.raises(PySparkException):
        files.read_typed_csv(spark, str(tmp_path / "bad.csv"), CSV).collect()


def test_empty_table_is_refused(spark, rows, tmp_path):
    with pytest.raises(ValueError):
        files.write_table(rows("a long", []), str(tmp_path / "x"))


def test_reports_hold_null_but_refuse_nan(spark, rows, tmp_path):
    for odd in (float("nan"), float("-inf")):
        with pytest.raises(PySparkException):
            files.write_report(rows("b double, a long", [(odd, 1)]), str(tmp_path / f"odd{odd}"))
        with pytest.raises(PySparkException):
            files.write_report(rows("b array<double>", [([1.0, odd],)]), str(tmp_path / f"array{odd}"))
    (tmp_path / "indented.json").write_text('{\n  "a": 1,\n  "b": [2.5]\n}\n')
    assert [tuple(r) for r in files.read_report(spark, str(tmp_path / "indented.json"), whole=True).collect()] == [(1, [2.5])]
    path = files.write_report(rows("b double, a long", [(None, 1), (2.5, 2)]), str(tmp_path / "r"))
    lines = sorted(line for p in (tmp_path / "r").glob("*.json") for line in p.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"a": 1, "b": None}, {"a": 2, "b": 2.5}]
    with pytest.raises(AnalysisException):
        files.write_report(rows("a long", [(1,)]), path)


@pytest.mark.parametrize("path", ["/data/in/new", "/data/in", "/data", "/data/in/../x"])
def test_protected_output(path):
    with pytest.raises(ValueError):
        files.fresh_output(path, ["/data/in"])
    assert files.fresh_output("/data/out", ["/data/in"]) == "/data/out"


def test_manifest_detects_each_kind_of_damage(spark, rows, tmp_path):
    for name in ("same", "changed", "extra"):
        (tmp_path / f"{name}.txt").write_text(name)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = rows("path string, sha256 string", [("same.txt", digest("same")), ("changed.txt", digest("other")), ("gone.txt", digest("gone"))])
    found = manifest.file_digests(spark, str(tmp_path))
    got = {r["path"]: r["status"] for r in manifest.verify_manifest(found, listed).collect()}
    assert got == {"same.txt": "ok", "changed.txt": "modified", "extra.txt": "unexpected", "gone.txt": "missing"}
    assert {tuple(r) for r in manifest.manifest_difference(found, listed).collect()} == {("extra.txt", "unexpected"), ("gone.txt", "missing")}
    with pytest.raises(PySparkException):
        manifest.verify_manifest(found, rows("path string, sha256 string", [("same.txt", "xyz")])).collect()


def test_chunks_resume_and_reject_another_contract(spark, rows, tmp_path):
    path = str(tmp_path / "chunks")
    data = rows("chunk long, v long", [(i % 4, i) for i in range(20)])
    chunks.write_pending(data.where("chunk < 2"), "chunk", path, "c1")
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "chunks").glob("chunk=0/*.parquet")}
    stored = chunks.write_pending(data.withColumn("v", F.when(F.col("chunk") < 2, -1).otherwise(F.col("v"))), "chunk", path, "c1")
    assert stored.count() == 20 and stored.where("v < 0").isEmpty()
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "chunks").glob("chunk=0/*.parquet")}
    with pytest.raises(ValueError):
        chunks.write_pending(data, "chunk", path, "c2")


def test_ragged_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(ragged, "BLOCK", 3)
    offsets = rows("position long, source_id long, start long", [(1, 7, 0), (2, 8, 4), (3, 9, 10), (4, None, 12)])
    parts = ragged.segments(offsets)
    assert sorted(tuple(r) for r in parts.collect()) == [(7, 0, 4), (8, 4, 10), (9, 10, 12)]
    values = rows("pos long, value long", [(i, i * i) for i in range(12)])
    got = {(r["source_id"], r["t"], r["f"]): r["value"] for r in ragged.unpack_ragged(values, parts, 2).collect()}
    assert got[(7, 1, 1)] == 9 and got[(8, 2, 0)] == 64 and got[(9, 0, 1)] == 121 and len(got) == 12
    with pytest.raises(PySparkException):
        ragged.unpack_ragged(values, parts, 5).collect()


def test_canonical_hash_is_sorted_compact_json(rows):
    df = rows("b long, a string", [(2, "x")])
    want = hashlib.sha256(json.dumps({"a": "x", "b": 2}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert df.select(canonical_hash(["b", "a"]).alias("h")).first()["h"] == want


TREE = "id long, name string, mean double, counts array<long>"


def test_tree_comparison(rows):
    a = R.flatten_rows(rows(TREE, [(1, "x", 0.5, [1, 2]), (2, "y", 0.5, [1])]), "t", ["id"])
    b = R.flatten_rows(rows(TREE, [(1, "x", 0.5 + 1e-13, [1, 3]), (2, "z", 0.5, [1, 4])]), "t", ["id"])
    assert {tuple(r) for r in R.compare_tree(a, b).collect()} == {
        ("t/1/counts/1", "number"), ("t/2/name", "value"), ("t/2/counts/length", "number"), ("t/2/counts/1", "missing"),
    }


def test_tolerance_depends_on_the_path(rows):
    leaves = lambda mean, p: R.flatten_rows(rows("id long, mean double, p_value double", [(1, mean, p)]), "t", ["id"])
    ok = R.compare_tolerant(leaves(0.5 + 1e-7, 0.1), leaves(0.5, 0.1), "/mean$").first()
    assert (ok["status"], ok["accepted_differences"]) == ("PASS", 1) and ok["max_accepted_difference"] == pytest.approx(1e-7)
    assert R.compare_tolerant(leaves(0.5, 0.1 + 1e-7), leaves(0.5, 0.1), "/mean$").first()["status"] == "FAIL"


def test_cells_and_paths(rows):
    values = rows("path string, value string", [("a", "12.346"), ("b", "7"), ("c", "true"), ("d", "1"), ("d", "2"), ("e", "0.12344"), ("f", "7.4")])
    cells = rows("id string, path string, kind string, printed string, decimals int, scale double", [
        ("1", "a", "number", "12.35", 2, None), ("2", "a", "number", "12.34", 2, None), ("3", "b", "number", "7", 0, None),
        ("4", "c", "bool", "True", None, None), ("5", "d", "number", "1", 0, None), ("6", "x", "number", "1", 0, None),
        ("7", "e", "number", "12.34", 2, 100.0), ("8", "f", "number", "7", 0, None),
    ])
    got = {r["id"]: r["status"] for r in R.check_cells(values, cells).collect()}
    assert got == {"1": "PASS", "2": "FAIL", "3": "PASS", "4": "PASS", "5": "AMBIGUOUS", "6": "MISSING", "7": "PASS", "8": "FAIL"}
    leaves = rows("table string, item string, column string, value string", [
        ("t", "0", "k", "a"), ("t", "0", "v", "1"), ("t", "1", "k", "b"), ("t", "1", "v", "2"), ("t", "2", "k", "b"), ("t", "2", "v", "3"),
    ])
    assert R.resolve_path(leaves, "t", {"k": "a"}, "v").first()["value"] == "1"
    for selector in ({"k": "b"}, {"k": "none"}):
        with pytest.raises(PySparkException):
            R.resolve_path(leaves, "t", selector, "v").collect()


def test_require_clean_names_the_broken_check(rows):
    table = rows("a long", [(1,), (2,)])
    R.require_clean(R.invariant_suite({"positive": (table, F.col("a") < 1)}))
    with pytest.raises(ValueError, match="small: 1"):
        R.require_clean(R.invariant_suite({"small": (table, F.col("a") > 1)}))


def test_scan_reads_whole_texts_and_skips_exempt_ones(rows):
    docs = rows("doc_id long, text string", [(1, "x " * 50000 + "/tmp/a /tmp/b"), (2, "/home/u"), (3, "clean")])
    got = texts.scan_patterns(docs, "doc_id", "text", {"path": "/tmp/|/home/"}, rows("doc_id long", [(2,)]))
    assert [tuple(r) for r in got.collect()] == [(1, "path", 2)]
