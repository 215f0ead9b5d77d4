"""Markup that hid text, markup that cost the square of its length, and repeated ids among vectors."""

import time

import numpy as np
from pyspark.sql import functions as F

from jostle.llm import html_tree, multi_index


def texts(source):
    return [t for _, t in html_tree.parse(source).runs]


def test_quotes_count_after_an_equals_sign_only():
    assert texts("<p title=Bob's>One text here</p><p>and don't lose</p><p>me</p>") == ["One text here", "and don't lose", "me"]
    assert texts("<p class\"x\">a</p><p a='1>2' b=\"3>4\" c = '5>'>b</p><p x=>c</p><p y=a=\"b>d\">e</p>") == ["a", "b", "c", 'd">e']
    assert texts('<p title="never closed>a</p><p>b</p>') == ["a", "b"]


def test_comments_that_end_at_once():
    assert texts("<p>a</p><!--><p>b</p>--><p>c</p>") == ["a", "b", "-->", "c"] and texts("<!---><p>b</p><!-- x --!><p>c</p><!-- open") == ["b", "c"]


def took(n):
    start = time.time()
    html_tree.parse("<div>" * n + "</x>" * n + "<b>" * n + "<hr>" * n + "<td>" * n + "</li>" * n)
    return time.time() - start


def test_ends_without_a_beginning_cost_nothing():
    took(100)
    assert took(40_000) < 20  # minutes, were it quadratic


def test_another_row_with_the_query_s_id_is_a_candidate(spark):
    r = np.random.default_rng(3)
    rows = [(k % 40, r.normal(size=4).tolist()) for k in range(120)]  # every id three times
    rows[40] = (0, [x + 0.01 for x in rows[0][1]])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], round(x["score"], 9)) for x in multi_index.search(df, F.col("vec_id") == 0, recall=1.0).collect())
    want = []
    for n, (i, v) in enumerate(rows):
        if i == 0:
            near = sorted((float(np.linalg.norm(np.array(v) - np.array(w))), j) for m, (j, w) in enumerate(rows) if m != n)[:10]
            want += [(0, k + 1, j, round(d, 9)) for k, (d, j) in enumerate(near)]
    assert got == sorted(want) and any(j == 0 for _, _, j, _ in got)


def test_three_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CHUNK_QUERIES", 20)
    r = np.random.default_rng(4)
    data = r.normal(size=(300, 5))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = multi_index.search(df, F.col("vec_id") % 5 == 0, recall=1.0, chunk_rows=50).collect()
    hits = 0
    for q in range(0, 300, 5):
        near = np.argsort(np.linalg.norm(data - data[q], axis=1))[1:11]
        hits += len(set(near.tolist()) & {x["vec_id"] for x in got if x["query_id"] == q})
    assert len(got) == 600 and hits >= 0.95 * 600
