"""Paths into nested documents, printed values, and outputs compared on all grains."""

import pytest
from pyspark.sql import Row

from jostle.operators import documents as D
from jostle.operators import reconcile as R

SCHEMA = "id long, name string, ok boolean, rates array<double>, inner struct<v:long,more:array<struct<k:string,x:int>>>, tags map<string,double>"


@pytest.fixture
def nodes(rows):
    return D.document_nodes(rows(SCHEMA, [
        (1, "a.b", True, [0.5, 0.25], Row(v=7, more=[Row(k="p", x=1), Row(k="q", x=2)]), {"t": 1.5}),
        (2, "c", False, [], Row(v=None, more=None), {}),
        (3, "c", None, None, None, None),
        (4, "d", True, [float("nan")], Row(v=8, more=[Row(k="p", x=3), Row(k="p", x=4)]), {"t": 2.5}),
    ]), "items", ["id"])


def resolved(nodes, rows, *paths):
    out = {}
    for r in D.resolve_paths(nodes, rows("path string", [(p,) for p in paths])).collect():
        out.setdefault(r["path"], []).append((r["status"], r["matches"], r["position"], r["kind"], r["text"]))
    return {p: sorted(found, key=str) for p, found in out.items()}


def test_values_lists_and_objects(nodes, rows):
    got = resolved(nodes, rows, "items[id=1].inner.v", "items[0].rates", "items[name=a.b,ok=TRUE].rates[1]", "items[id=1].tags.t", "items[id=2].rates", "items[ok=null].name", "items[1].inner.v", "items[id=3].inner")
    assert got["items[id=1].inner.v"] == [("FOUND", 1, None, "number", "7")]
    assert got["items[0].rates"] == [("FOUND", 1, 0, "number", "0.5"), ("FOUND", 1, 1, "number", "0.25"), ("FOUND", 1, None, "list", None)]
    assert got["items[name=a.b,ok=TRUE].rates[1]"] == [("FOUND", 1, None, "number", "0.25")]
    assert got["items[id=1].tags.t"] == [("FOUND", 1, None, "number", "1.5")] and got["items[id=2].rates"] == [("FOUND", 1, None, "list", None)]
    assert got["items[ok=null].name"] == [("FOUND", 1, None, "string", "c")] and got["items[1].inner.v"][0][3] == "null" and got["items[id=3].inner"][0][3] == "null"


def test_selectors_are_resolved_one_after_the_other(nodes, rows):
    got = resolved(nodes, rows, "items[id=1].inner.more[k=q].x", "items[id=4].inner.more[k=p].x", "items[ok=true].inner.more[k=q].x", "items[id=1].inner.more[k=q,x=1].x", "items[name=c].id")
    assert got["items[id=1].inner.more[k=q].x"] == [("FOUND", 1, None, "number", "2")]
    assert got["items[id=4].inner.more[k=p].x"][0][:2] == ("AMBIGUOUS", 2)
    assert got["items[ok=true].inner.more[k=q].x"][0][:2] == ("AMBIGUOUS", 2)  # although only one of the two leads on
    assert got["items[id=1].inner.more[k=q,x=1].x"][0][:2] == ("MISSING", 0) and got["items[name=c].id"][0][:2] == ("AMBIGUOUS", 2)


def test_missing_and_faulty_paths(nodes, rows):
    missing = ["items[9].id", "items[id=1].nothing", "nothing", "items[id=1].rates[2]", "items.id", "items[id=1].inner.v.w"]
    invalid = ["", ".items", "items.", "items..id", "items[", "items[]", "items[id]", "items[=1]", "items]x", "items[-1]"]
    got = resolved(nodes, rows, *missing, *invalid)
    assert {p: got[p][0][0] for p in missing + invalid} == {p: "MISSING" for p in missing} | {p: "INVALID" for p in invalid}


def test_one_document_and_a_repeated_one(rows):
    one = D.document_nodes(rows("a struct<b:array<long>>", [(Row(b=[4, 5]),)]), "")
    assert resolved(one, rows, "a.b[1]")["a.b[1]"] == [("FOUND", 1, None, "number", "5")]
    assert resolved(one.unionByName(one), rows, "a.b[1]")["a.b[1]"][0][:2] == ("AMBIGUOUS", 2)
    assert resolved(one.where("false"), rows, "a.b")["a.b"][0][:2] == ("MISSING", 0)


CELLS = "id string, path string, kind string, printed string, items array<double>, decimals int, scale double"


def test_printed_cells(nodes, rows):
    cells = rows(CELLS, [
        ("exact", "items[id=1].inner.v", "number", "7", None, None, None), ("wrong", "items[id=1].inner.v", "number", "8", None, 0, None),
        ("percent", "items[id=1].rates[1]", "number", "25.0", None, 1, 100.0), ("edge", "items[id=1].tags.t", "number", "1.45", None, 1, None), ("far", "items[id=1].tags.t", "number", "1.44", None, 1, None),
        ("text", "items[id=1].name", "string", "a.b", None, None, None), ("flag", "items[id=2].ok", "bool", "False", None, None, None), ("number?", "items[id=1].name", "number", "1", None, None, None),
        ("list", "items[id=1].rates", "list", None, [50.0, 25.2], 0, 100.0), ("short", "items[id=1].rates", "list", None, [0.5], 2, None), ("long", "items[id=1].rates", "list", None, [0.5, 0.25, 0.1], 2, None),
        ("off", "items[id=1].rates", "list", None, [0.5, 0.3], 2, None), ("empty", "items[id=2].rates", "list", None, [], 2, None), ("nan", "items[id=4].rates", "list", None, [1.0], 2, None),
        ("nowhere", "items[id=9].name", "string", "x", None, None, None), ("two", "items[name=c].id", "number", "2", None, None, None), ("faulty", "items[", "number", "2", None, None, None), ("no list", "items[id=1].name", "list", None, [1.0], 0, None),
    ])
    got = {r["id"]: r for r in D.check_cells(nodes, cells).collect()}
    assert {i for i, r in got.items() if r["status"] == "PASS"} == {"exact", "percent", "edge", "text", "flag", "list", "empty"}
    why = {i: r["reason"] for i, r in got.items() if r["reason"]}
    assert why == {"wrong": "value", "far": "value", "number?": "kind", "short": "length", "long": "length", "off": "value", "nan": "value", "nowhere": "missing", "two": "ambiguous", "faulty": "invalid", "no list": "kind"}
    assert got["wrong"]["difference"] == -1 and got["wrong"]["computed"] == "7.0" and got["exact"]["tolerance"] == 0 and got["off"]["difference"] == pytest.approx(0.05)
    resolved_ = D.resolve_paths(nodes, cells)
    found = {(r["id"], r["position"], r["reason"]) for r in D.list_findings(resolved_, cells).collect() if r["id"] != "no list"}
    assert found == {("short", 1, "unexpected"), ("long", 2, "missing"), ("off", 1, "number"), ("nan", 0, "value")}


POINT, TRACES, PATCHES = "source_id long, cand long, candidate_prediction int, m double", "source_id long, cand long, stage int, metric int, value double", "source_id long, cand long, stage int, patch_scores array<double>, patch_prediction int, clean_scores array<double>"


def test_outputs_on_all_grains(rows):
    nan = float("nan")
    points = [(1, c, 0, 0.5) for c in range(9)]
    traces = [(1, c, 0, 0, 0.1) for c in range(9)]
    patches = [(1, c, 3, [1.0, 2.0], 1, [1.0, 2.0]) for c in range(9)]
    change = lambda table, at, new: [new if r[1] == at and new else r for r in table if r[1] != at or new]
    fresh = R.output_cells(
        rows(POINT, change(change(points, 0, (1, 0, 1, 0.5)), 8, None)), rows(TRACES, change(change(change(traces, 2, None), 3, (1, 3, 0, 0, nan)), 8, None)),
        rows(PATCHES, change(change(change(change(patches, 4, None), 5, (1, 5, 3, [1.0, 2.2], 1, [1.0, 2.0])), 6, (1, 6, 3, [1.0, 2.0], 0, [1.0, 2.0])), 8, None)), ["m"], (3,),
    )
    stored = R.output_cells(rows(POINT, change(points, 1, (1, 1, 0, None))), rows(TRACES, traces), rows(PATCHES, change(patches, 7, None)), ["m"])
    got = {r["cand"]: r for r in R.compare_outputs(fresh, stored, 0.1, 1e-3, ["m"]).collect()}
    assert {c: r["failed"] for c, r in got.items()} == {
        0: "candidate_prediction", 1: "m", 2: "trace_metrics", 3: "trace_metrics", 4: "missing_patch_scores", 5: "patch_scores,positive_controls", 6: "patch_predictions", 7: "", 8: "missing_fresh",
    }
    assert got[5]["max_control_difference"] == pytest.approx(0.2) and got[7]["max_control_difference"] == 0 and got[7]["max_patch_difference"] is None
    repeated = R.output_cells(rows(POINT, points + points[:1]), rows(TRACES, traces), rows(PATCHES, patches), ["m"], (3,))
    assert {r["failed"] for r in R.compare_outputs(repeated, stored, 0.1, 1e-3, ["m"]).where("cand = 0").collect()} == {"candidate_prediction,m"}


def test_replacement_bitmaps(rows):
    schema = "chunk int, source_id long, cand long, stage int, patch_scores array<double>"
    whole = [(0, 1, c, s, [0.0, 1.0]) for c in range(6) for s in range(2)]
    faulty = [r for r in whole if r[2:4] != (1, 0) and r[2] != 2 and r[2:4] != (3, 1) and r[2:4] != (4, 1)]
    faulty += [(0, 1, 3, 1, [0.0]), (0, 1, 4, 1, [0.0, None]), (0, 1, 5, 2, [0.0, 1.0]), (0, 1, 9, 0, [0.0, 1.0]), (0, 1, 9, 1, [0.0, 1.0]), (1, 2, 0, 0, [0.0, 1.0]), (1, 2, 0, 1, [0.0, 1.0])]
    asked = rows("chunk int, source_id long, cand long", [(0, 1, c) for c in range(6)] + [(1, 2, 0)])
    got = {r["chunk"]: tuple(r)[1:] for r in R.replacement_coverage(asked, rows(schema, faulty), "chunk", 2, 2).collect()}
    assert got == {0: (6, 6, 1, 1, 1, 3, False), 1: (1, 1, 0, 0, 0, 0, True)}
