"""Rows with very many spans, and the running values they rest on."""

import random
import time

from pyspark.sql import functions as F

from jostle.llm import pii, scans


def test_running_values_equal_a_loop(spark):
    r, rows = random.Random(1), []
    for n in (0, 1, 2, 3, 4, 5, 9, 10, 17, 100):
        rows.append((n, [r.randrange(-50, 50) for _ in range(n)]))
    df = spark.createDataFrame(rows, "n long, v array<int>")
    out = df.select("v", scans.scan(F.col("v"), lambda x, y: x + y).alias("s"), scans.scan(F.col("v"), F.greatest).alias("m"))
    for x in out.collect():
        assert x["s"] == [sum(x["v"][: i + 1]) for i in range(len(x["v"]))] and x["m"] == [max(x["v"][: i + 1]) for i in range(len(x["v"]))]


def test_parts_of_a_text(spark):
    text = "".join(chr(0x61 + i % 26) if i % 7 else "\U0001f600" for i in range(3 * scans.PIECE + 5)) + "\n\r\nend"
    places = [0, 1, 5, scans.PIECE - 1, scans.PIECE, scans.PIECE + 1, 2 * scans.PIECE, len(text) - 1, len(text)]
    rows = [(a, b) for a in places for b in places if a <= b]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("cut", scans.pieces(F.lit(text)))
    assert all(x["p"] == text[x["a"] : x["b"]] for x in df.select("a", "b", scans.part(F.col("cut"), F.col("a"), F.col("b")).alias("p")).collect())
    assert spark.range(1).select(scans.pieces(F.lit(""))).first()[0] == []


def _took(spark, n):
    text = "10.0.0.1 x " * n
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    found, clean = pii.digest(docs).first(), pii.redact(docs).first()
    assert found["n_ip"] == n and clean["text"] == "<IP> x " * n
    return time.time() - start


def test_many_spans_in_a_text_cost_their_number(spark):
    _took(spark, 50)
    assert _took(spark, 32_000) < 60  # minutes, were it quadratic
