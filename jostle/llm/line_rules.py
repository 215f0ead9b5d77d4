"""Quality rules by words, repeated windows and the frequency of lines across documents.

A line of any length is normalised (small letters, single blanks, digits as 0) and hashed; the distinct documents that
hold it are counted per host, where equal texts are one document. Lines above a share of the host's documents are taken
out, and a document that keeps too little of itself is rejected. Everything is a column expression, an aggregation or
an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jostle.llm.common import SPACE, free_name, keyed, word_array
from jostle.plans.joins import attach
from jostle.plans.staging import stage

#: A line in more than this share of a host's documents is boilerplate, and more than so many must hold it.
LINE_SHARE, LINE_TEXTS = 0.05, 5
#: The share of its words that a document must keep.
LEAST_SHARE = 0.3
LEAST_WORDS = 50
WINDOW = 3
MOST_REPEATED = 0.5
# Fixed value: the symbols to count.
SYMBOLS = r"[#*$%&|<>]"


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")), "[0-9]+", "0")


def measures(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of every whole text.

    n_repeat_words counts the words inside windows of three words that the text holds twice or more.
    Equal windows are found by sorting their hashes within the row, so no row leaves its task.
    """
    names = {n: free_name(docs, n) for n in ("words", "own_lines", "windows", "sorted", "places")}
    words, windows, ordered, places = F.col(names["words"]), F.col(names["windows"]), F.col(names["sorted"]), F.col(names["places"])
    count = F.size(words) - WINDOW + 1
    hashed = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    none = F.array().cast("array<bigint>")
    # Most texts repeat no window; only the others sort theirs with positions.
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twin = lambda p, k: p["h"].eqNullSafe(F.get(ordered, k - 1)["h"]) | p["h"].eqNullSafe(F.get(ordered, k + 1)["h"])
    step = lambda seen, at: F.struct(at.alias("last"), (seen["n"] + F.least(F.lit(WINDOW), at - seen["last"])).alias("n"))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    found = docs.withColumn(names["words"], word_array(F.col(text))).withColumn(names["own_lines"], _lines(F.col(text)))
    found = found.withColumn(names["windows"], F.when(count >= 2, hashed).otherwise(none))
    found = found.withColumn(names["sorted"], F.when(repeats, pairs))
    found = found.withColumn(names["places"], F.array_sort(F.transform(F.filter(ordered, twin), lambda p: p["i"])))
    lines = F.col(names["own_lines"])
    return found.select(
        *docs.columns,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(places, zero, step, lambda seen: seen["n"]), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _common(each: DataFrame, rows: DataFrame, line_texts: int, line_share: float) -> DataFrame:
    """(host, hash) of the lines above the limit, staged; ``each`` are (host, content, hash), ``rows`` (host, content).

    Distinct (host, line, text) come first: a line in every document is then counted from partial counts.
    """
    held = each.groupBy("host", "hash", "content").agg(F.lit(1).alias("one"))
    counted = held.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > line_texts)
    sizes = rows.where(F.col("content").isNotNull()).groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    found = attach(counted, stage(sizes, "hosts"), ["host"], spread=F.col("hash"))
    return stage(found.where(F.col("texts") > line_share * F.col("size")).select("host", "hash"), "common")


def _content(text: str) -> Column:
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    line_texts: int = LINE_TEXTS, line_share: float = LINE_SHARE, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """Per row of ``docs``: doc_id, the measures, base_failed, lines_removed, words_removed and kept.

    ``docs`` should be staged or a table; rows are told apart by number, so repeated ids stay apart. A
    null text has no words; a null host is a host of its own. Equal texts of a host are one document there, so
    copies of a document do not make boilerplate of it. A text without words is base_failed.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("\x00null")).alias("host"))
    line = lambda x: F.struct(F.xxhash64(normalised(x)).alias("hash"), F.size(word_array(x)).alias("words"))
    made = measures(own, "text").withColumns({"lines": F.transform(_lines(F.col("text")), line), "content": _content("text")})
    rows = keyed(made.drop("text"), "rules", "row_key")
    each = rows.select("row_key", "host", "content", F.explode("lines").alias("line")).select("row_key", "host", "content", "line.hash", "line.words")
    hits = attach(each, _common(each, rows, line_texts, line_share), ["host", "hash"], spread=F.col("row_key"))
    removed = hits.groupBy("row_key").agg(F.count(F.lit(1)).alias("lines_removed"), F.sum("words").cast("long").alias("words_removed"))
    marked = rows.join(removed, "row_key", "left").fillna(0, ["lines_removed", "words_removed"])
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    whole = F.col("n_words") - F.col("words_removed") >= least_share * F.col("n_words")
    return marked.select(
        "row_key", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "lines_removed", "words_removed", (~failed & whole).alias("kept"),
    )


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The kept rows of ``docs``, without the lines above the limit; same columns.

    Unlike :func:`judge` this carries texts: the common lines of a row are gathered (a row holds no more
    of them than it has lines) and taken out of its text.
    """
    key = free_name(docs, "line_key")
    rows = keyed(docs, "texts", key)
    verdict = judge(rows.withColumnRenamed(key, "own_key").select(F.col("own_key").alias("k"), F.col(text).alias("t"), F.col(host).alias("h")), "k", "t", "h", **limits)
    kept = rows.join(verdict.where("kept").select(F.col("doc_id").alias(key)), key, "left_semi")
    place = F.coalesce(F.col(host).cast("string"), F.lit("\x00null"))
    placed = rows.select(key, place.alias("host"), _content(text).alias("content"), text)
    each = placed.select(key, "host", "content", F.explode(_lines(F.col(text))).alias("line")).withColumn("hash", F.xxhash64(normalised(F.col("line"))))
    common = _common(each, placed, limits.get("line_texts", LINE_TEXTS), limits.get("line_share", LINE_SHARE))
    gone = attach(each, common, ["host", "hash"], spread=F.col(key)).groupBy(key).agg(F.collect_set("line").alias("gone"))
    column = free_name(docs, "gone_lines")
    joined = kept.join(gone.withColumnRenamed("gone", column), key, "left")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col(column), x)), "\n")
    return joined.withColumn(text, F.when(F.col(column).isNull(), F.col(text)).otherwise(rest)).select(*docs.columns)
