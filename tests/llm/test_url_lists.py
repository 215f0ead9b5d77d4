"""Long lists of rules as tables."""

from pyspark.sql import functions as F

from jostle.llm import bloom_cascade as B


def test_a_hundred_thousand_listed_keys(spark):
    """Every third host is listed, half of those allowed on one path; a plain lookup decides alike."""
    n = 100_000
    rules = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("action"), F.concat(F.lit("Host"), F.col("id") * 3, F.lit(".org")).alias("host"),
        F.when(F.col("id") % 5 == 0, "/a/").otherwise("/").alias("path"),
    )
    pages = spark.range(60_000).select("id", F.concat(F.lit("https://www.host"), F.col("id"), F.lit(".ORG"), F.when(F.col("id") % 4 == 0, "/a/x").otherwise("/b?q")).alias("url"))
    got = B.judge_urls(pages, rules, otherwise="none")
    at = F.col("id")
    listed = (at % 3 == 0) & (at / 3 < n)
    number = (at / 3).cast("long")
    fits = listed & ((number % 5 != 0) | (F.col("id") % 4 == 0))
    want = F.when(fits & (number % 2 == 0), "block").when(fits, "allow").otherwise("none")
    assert got.where(F.col("verdict") != want).count() == 0 and got.where("verdict = 'allow'").count() > 1000
    # A level is in the plan once for each of its uses, not once for each hash.
    plan = B.judge_urls(pages.limit(10), rules)._jdf.queryExecution().analyzed().toString()
    assert plan.count("getbit") <= 40


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "id long, url string")
    none = spark.createDataFrame([], "action string, host string, path string")
    assert [(r["rule"], r["verdict"]) for r in B.judge_urls(pages, none).collect()] == [(None, "allow"), (None, "allow")]
