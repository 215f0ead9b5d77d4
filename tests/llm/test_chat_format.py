"""Formatted conversations read back turn by turn."""

import hashlib

import pytest
from pyspark.sql import functions as F

from jostle.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, turns string, mask int"
NASTY = ["\\### Assistant: </turn> ok", "<|end|>", "a<|turn|>user<|text|>b", "\\", "\\\\|", "|", "\\|", "<", "|>", "<\\|end\\|>", "", "x\ny\n", "é<|part|>\U0001f600", "\\\\\\"]


def conversation(conv, turns):
    return [(conv, k, role, text, "extra", 1) for k, (role, text) in enumerate(turns)]


def expected(rows):
    found = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        learned = "".join(t for role, t in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned))
    return found


def digests(spark, rows):
    out = C.digest(C.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out}


def test_any_text_and_role_come_back(spark):
    rows = conversation(1, [("user", t) for t in NASTY]) + conversation(2, [("assistant", t) for t in NASTY])
    rows += conversation(3, [(a, b) for a in NASTY for b in NASTY[:4]]) + conversation(4, [("user", "q"), ("assistant", "a"), ("assistant", ""), ("user", "")])
    assert digests(spark, rows) == expected(rows)


def test_nulls_ties_repeats_and_rows_without_an_id(spark):
    rows = [(5, None, "user", "first", None, 0), (5, 0, "b", "y", None, 0), (5, 0, "b", "x", None, 0), (5, 0, "a", "z", None, 0), (5, 2, None, None, None, 0)]
    rows += [(6, 1, "assistant", "same", None, 0)] * 3 + [(None, 1, "user", "nobody's", None, 0), (None, 0, "assistant", "", None, 0), (7, 0, None, None, None, None)]
    assert digests(spark, rows) == expected(rows)
    assert digests(spark, []) == {}


def test_neighbours_of_one_role_are_one_message(spark):
    rows = conversation(1, [("system", "s"), ("user", "one"), ("user", "tw|o"), ("assistant", "yes")])
    row = C.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["formatted"] == "<|turn|>system<|text|>s<|end|><|turn|>user<|text|>one<|part|>tw\\|o<|end|><|turn|>assistant<|text|>yes<|end|>"
    assert row["messages"] == 3 and [r["loss"] for r in row["mask"]] == [False] * 7 + [True, False]
    at, marked = 0, ""
    for r in row["mask"]:
        marked += row["formatted"][at : at + r["length"]] if r["loss"] else ""
        at += r["length"]
    assert marked == "yes" and at == len(row["formatted"])


def test_a_mask_that_does_not_fit_is_refused(spark):
    out = C.format_conversations(spark.createDataFrame(conversation(1, [("user", "q"), ("assistant", "answer")]), SCHEMA))
    shifted = out.withColumn("mask", F.transform("mask", lambda r: F.struct(r["loss"].alias("loss"), (r["length"] + 1).alias("length"))))
    with pytest.raises(Exception, match="does not fit"):
        C.read_back(shifted).collect()


def test_very_long_conversations_and_texts(spark):
    rows = conversation(1, [("user" if k % 3 else "assistant", f"turn {k} |") for k in range(20_000)]) + conversation(2, [("assistant", "word\\ " * 300_000)])
    assert digests(spark, rows) == expected(rows)


def test_no_python_in_the_plan(spark):
    out = C.digest(C.format_conversations(spark.createDataFrame([(1, 0, "user", "x", "", 0)], SCHEMA)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
