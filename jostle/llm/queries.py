"""The operators as registered queries over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jostle.llm import (
    bloom_cascade, chat_format, gnat, html_tree, line_rules, multi_index, nbsvm, packing, pii, prefix_trie, raking, simhash, sparse_suffix,
)
from jostle.llm.common import table, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary() -> str:
    """The tokenizer file of the packing; it is installed with its package on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return fn


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(table(spark, folder, "documents"))


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = nbsvm.fit(nbsvm.training_rows(docs, table(spark, folder, "labels")))
    return nbsvm.classify(docs, model).select("doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary())


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    drawn = raking.mix(table(spark, folder, "documents").select("doc_id", "text", "source", "lang"))
    return drawn.select("doc_id", "source", "lang", "topic", "words", "probability", "sampled")


@query
def op10_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = line_rules.judge(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed", "words_removed"
    )


ORACLES["op10_line_rules"] = r"""
WITH d AS (
  SELECT doc_id, text, coalesce(source, '(null)') AS host, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS own_lines FROM documents
), g AS (
  SELECT doc_id, u.i AS i, count(*) OVER (PARTITION BY doc_id, u.g) AS times FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]})) AS u FROM d)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id
), l AS (
  SELECT doc_id, host, text, regexp_replace(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS line,
         len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '')) AS words
  FROM (SELECT doc_id, host, text, unnest(own_lines) AS x FROM d)
), c AS (
  SELECT l.host, line FROM l JOIN (SELECT host, count(DISTINCT text) AS size FROM d GROUP BY host) h ON h.host = l.host GROUP BY l.host, line, size HAVING count(DISTINCT text) > greatest(5, 0.05 * size)
), m AS (
  SELECT doc_id, count(*) AS lines_removed, CAST(sum(words) AS BIGINT) AS words_removed FROM l JOIN c USING (host, line) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(own_lines) - len(list_distinct(own_lines)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, coalesce(lines_removed, 0) AS lines_removed, coalesce(words_removed, 0) AS words_removed
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_words - words_removed >= 0.3 * n_words AS kept FROM f
"""


#: The rules that the URL query applies, as (action, host, path).
URL_RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)


@query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return bloom_cascade.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op7_url_filter"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), r(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), m AS (
  SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, 'allow') AS verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, verdict FROM m WHERE n = 1
"""


@query
def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    extracted = html_tree.extract(pages, html_tree.train(pages))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.search(table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


@query
def op5_sparse_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return sparse_suffix.repeated_passages(table(spark, folder, "documents"))


#: The conversation that the contract adds, both of whose turns say this.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


@query
def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest(chat_format.format_conversations(rows))


ORACLES["op11_chat_format"] = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), f AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS begins FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(text, chr(92), chr(92) || chr(92)), '|', chr(92) || '|')) + CASE WHEN begins
    THEN length('<|turn|><|text|><|end|>') + length(replace(replace(role, chr(92), chr(92) || chr(92)), '|', chr(92) || '|')) ELSE length('<|part|>') END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


ORACLES["op12_prefix_trie"] = r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
  SELECT conv_id, turns, 3 & xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))))) AS h FROM own
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[:CAST(c.h AS INTEGER)], c.turns[CAST(c.h AS INTEGER) + 1:]) AS turns FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), member AS (
  SELECT conv_id, d, turns[:d] AS node, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)
), node AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM member GROUP BY node, d
), kids AS (
  SELECT node[:depth - 1] AS node, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1
), facts AS (
  SELECT node.*, coalesce(kids.n, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(regexp_split_to_array(node[depth].text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS saved FROM node LEFT JOIN kids USING (node)
), sums AS (
  SELECT up AS node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT node[:k] AS up, n_children, saved FROM (SELECT *, unnest(range(depth + 1)) AS k FROM facts)) GROUP BY up
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM facts f JOIN sums s ON s.node = f.node LEFT JOIN node p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.node = f.node[:f.depth - 1]
"""


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    seventh = F.pmod("vec_id", F.lit(7)) == 0
    label = F.when(seventh, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return gnat.hard_negatives(table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0, label)


ORACLES["op13_hard_negatives"] = r"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS y
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.n AS an, a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_inner_product(a.y, b.y) AS BIGINT) AS score FROM v a JOIN v b ON a.n <> b.n WHERE a.id % 100 = 0
), p AS (
  SELECT an, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY an ORDER BY score DESC, id) AS place FROM s WHERE same
), h AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.an, p.place ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.an = p.an AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 5
"""
