"""Rows behind counts: matches, differences, dense classes, validation runs, padding, and numbers that are not finite."""

import pytest
from pyspark.sql import Row

from jostle.operators import census as C
from jostle.operators import reconcile as R
from jostle.operators import replicas as P
from jostle.operators import scoring as SC
from jostle.operators import texts as T
from jostle.sources import files as S
from jostle.sources import manifest as M


def test_matches_are_listed_with_their_lines(rows):
    docs = rows("id long, body string", [(1, "a1 b22\n\nx\na3 a1"), (2, None), (3, "none"), (4, "a9")])
    got = T.list_matches(docs, "id", "body", {"a": "a[0-9]", "digits": "[0-9]+"}, rows("id long", [(4,)]))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 1, "a", 1, "a1"), (1, 1, "digits", 1, "1"), (1, 1, "digits", 2, "22"), (1, 4, "a", 1, "a3"), (1, 4, "a", 2, "a1"), (1, 4, "digits", 1, "3"), (1, 4, "digits", 2, "1"),
    ]


def test_differences_are_listed_with_their_tolerance(rows):
    leaves = lambda mean, p: R.flatten_rows(rows("id long, mean double, p double", [(1, mean, p)]), "t", ["id"])
    got = {r["path"]: (r["reason"], r["absolute_tolerance"]) for r in R.tolerant_differences(leaves(0.5 + 1e-7, 0.1 + 1e-7), leaves(0.5, 0.1), "/mean$").collect()}
    assert got == {"t/1/mean": (None, 1e-6), "t/1/p": ("number", 1e-12)}
    assert R.tolerant_differences(leaves(0.5, 0.1), leaves(0.5, 0.1), "/mean$").count() == 0


def test_every_class_has_a_row(rows):
    labelled = rows("k string, label long, prediction long", [("x", 0, 0), ("x", 0, 2), ("y", 3, 3)])
    per_class = C.classification_metrics(labelled, ["k"], 4)[1]
    got = {(r["k"], r["class"]): (r["support"], r["predicted"], r["f1"]) for r in C.class_report(per_class, ["k"], 4).collect()}
    assert len(got) == 8 and got["x", 1] == (0, 0, 0.0) and got["x", 2] == (0, 1, 0.0) and got["y", 3] == (1, 1, 1.0)


def test_concentration_of_fractions(rows):
    whole = C.concentration(rows("id long, v long", [(1, 1), (2, 3)]), "v", "id").first()
    half = C.concentration(rows("id long, v double", [(1, 0.25), (2, 0.75)]), "v", "id").first()
    assert tuple(whole) == pytest.approx(tuple(half)) and half["herfindahl"] == pytest.approx(0.625)


def test_validation_runs(rows):
    panel = rows("r string, source_id long, clean_prediction long, label long", [("a", 0, 1, 1), ("a", 2, 0, 0), ("a", 5, 0, 0), ("b", 0, 1, 1)])
    runs = rows("r string, source_id long, scores array<double>, prediction long, label long", [
        ("a", 0, [0.0, 1.0], 1, 1), ("a", 1, [0.0, 1.0], 0, 1), ("a", 2, [1.0, 0.0], 1, 0), ("a", 4, [1.0, 0.0], 0, 0), ("a", 4, [1.0, 0.0], 0, 0), ("c", 0, [1.0], 0, None),
    ])
    got = {(r["r"], r["check"]): r["violations"] for r in P.validation_consistency(panel, runs, "r").collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("a", "prediction_disagrees_with_scores"): 2, ("a", "repeated_source"): 1, ("a", "missing_source"): 1, ("a", "panel_source_missing"): 1, ("a", "panel_prediction_differs"): 1,
        ("b", "panel_source_missing"): 1,
    }


def test_padding_is_summed_up(rows):
    logits = rows("source_id long, horizon long, padded_horizon long, t long, z array<double>", [
        *[(s, 1, 2, t, [1.0, 0.0] if t == 0 else [0.0, 9.0]) for s in (1, 2, 3) for t in (0, 1)], (4, 1, 1, 0, [1.0, 0.0]),
    ])
    split = SC.prefix_extra_split(logits, "z", 2)
    native = rows("source_id long, native_scores array<double>", [(1, [0.7, 0.3]), (2, [0.2, 0.8]), (4, [0.9, 0.1])])
    recorded = rows("source_id long, native_recorded long, padded_recorded long", [(1, 0, 1), (2, 1, 1), (3, 0, 0), (4, 0, 0)])
    got = SC.padding_summary(split, native, recorded).first().asDict()
    assert got == {
        "sources": 4, "incomplete": 1, "recorded_changes": 1, "unchanged_with_padding": 2, "padding_label_changes": 1, "prefix_only_differs": 1, "restored_without_extra": 1,
        "native_plus_extra_changes": 1, "native_disagreements": 1, "padded_disagreements": 1,
    }


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_numbers_that_are_not_finite_are_refused_at_any_depth(rows, tmp_path, bad):
    schema = "id long, s struct<a:double,b:array<struct<c:float>>>, m map<string,array<double>>, plain string"
    fine = (1, Row(a=None, b=[Row(c=1.0), None]), {"k": [1.0, None]}, "x")
    S.write_report(rows(schema, [fine]), str(tmp_path / "fine"))
    for n, row in enumerate([(1, Row(a=bad, b=None), None, "x"), (1, Row(a=1.0, b=[Row(c=bad)]), None, "x"), (1, None, {"k": [bad]}, "x")]):
        with pytest.raises(Exception, match="not finite"):
            S.write_report(rows(schema, [fine, row]), str(tmp_path / str(n)))


def test_a_file_without_a_digest_is_not_missing(rows):
    files = rows("path string, sha256 string", [("a", None), ("b", "0" * 64)])
    got = dict(map(tuple, M.verify_manifest(files, rows("path string, sha256 string", [("a", "0" * 64), ("b", "0" * 64), ("c", "0" * 64)])).collect()))
    assert got == {"a": "modified", "b": "ok", "c": "missing"}
