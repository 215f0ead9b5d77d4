"""Each operator on small hand-made tables: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jostle.llm import bloom_cascade, components, html_tree, line_rules, multi_index, nbsvm, packing, pii, raking, simhash, sparse_suffix
from jostle.llm import queries as Q
from jostle.llm.tokens import WordEncoder

LONG = "lorem ipsum dolor " * 4000
ODD = [(1, None, "a"), (2, "", "a"), (3, "  \t\n ", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (None, "two words", "b"), (6, LONG, "a"), (7, "é😀 \u00a0x", "c")]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Edge rows with extra columns whose names clash with those of the operators."""
    rows = [(*r, "en", 0, 0.5, "k") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, fingerprint int, score double, row_key string")


def story(seed, n, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


# ---- 8: SimHash

def slow_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def test_fingerprint_equals_the_definition():
    for text in [t for _, t, _ in ODD] + [story(s, 1 + s * 7) for s in range(20)] + ["A b C", "A\x0bb\x0cC", "x\x1cy"]:
        assert simhash.fingerprint(text or "") & (1 << 64) - 1 == slow_fingerprint(text)


def test_links_equal_all_pairs(spark):
    r = random.Random(1)
    prints = {0, -1, 1 << 62, -(1 << 63)}
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(4):
            value = base
            for b in r.sample(range(64), r.randint(0, 5)):
                value ^= 1 << b
            prints.add(value - (1 << 64) if value >> 63 else value)
    for bits in (0, 1, 3, 5):
        got = [tuple(x) for x in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), "fp", bits).collect()]
        want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        assert set(got) == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 130)) and got[201] == got[200] == 200
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_odd_rows(odd):
    found = simhash.near_duplicates(odd)
    assert found.columns == [*odd.columns, "row_key_", "fingerprint_", "component_id"]
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in found.collect())
    assert got[(1, 1)] == got[(2, 1)] == got[(3, 1)] == 1 and got[(4, 4)] == 1 and got[(5, 4)] == 2 and got[(None, None)] == 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_keep_one_keeps_exactly_one_row_of_each_group(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "6", "7", "None"]
    base = story(3, 300)
    copies = [(i, base) for i in (9, 8, 8, 10)] + [(11, base + " end"), (12, story(4, 300))]
    assert sorted(r[0] for r in simhash.keep_one(spark.createDataFrame(copies, "doc_id long, text string")).collect()) in ([8, 12], [8, 11, 12])


# ---- 9: personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def slow_spans(text):
    digits = lambda h: re.sub("[^0-9]", "", h)
    valid = {
        "email": lambda h: True, "ip": lambda h: all(int(x) <= 255 for x in h.split(".")),
        "card": lambda h: 12 <= len(digits(h)) <= 19 and slow_luhn(digits(h)), "phone": lambda h: 9 <= len(digits(h)) <= 15,
    }
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, k in enumerate(BASE) for m in re.finditer(BASE[k], text or "") if valid[k](m[0])]
    return [s for _, _, s in sorted(found)]


def test_base_spans_equal_plain_regular_expressions(spark):
    r = random.Random(5)
    alphabet = ["@", ".", "-", "+", " ", "1", "2", "5", "0", "a", "b.c", "_", "(", ")", "4111 1111 1111 1111", "x@y.z", "255.1.2.3", "+49 30 1234567", "😀", "é", "\n"]
    texts = [t for _, t, _ in ODD] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts += ["a." * 3000 + "x@" + "b." * 3000 + "c", "1" * 5000, "1.2.3.4." * 2000, "0001.255.0.0", "GB82 WEST 1234 5698 7654 32"]
    got = {x["doc_id"]: x for x in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = slow_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:80]
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}


def test_checksums_and_context_words(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32."), (2, "iban GB83 WEST 1234 5698 7654 32."), (3, "call 030 1234 5678 now"), (4, "item 030 1234 5678 now")]
    got = dict(pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "spans").collect())
    assert got[1] == "iban:5:32" and got[2] == "" and got[3] == "national_phone:5:18" and got[4] == ""


def test_redaction_replaces_every_span_and_nothing_else(odd, spark):
    assert sorted(map(str, pii.redact(odd).collect())) == sorted(map(str, odd.collect()))
    rows = spark.createDataFrame([(1, "a x@y.zz, 1.2.3.4 é 4111-1111-1111-1111!"), (2, None)], "doc_id long, text string")
    assert dict(pii.redact(rows).collect()) == {1: "a <EMAIL>, <IP> é <CARD>!", 2: None}
    assert pii.redact(odd.limit(0)).count() == 0


# ---- 10: line rules

def slow_measures(text):
    words = WORDS.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_measures_equal_the_definition(spark, odd):
    r = random.Random(2)
    texts = [t for _, t, _ in ODD] + [" ".join(r.choice(["a", "b", "c#", "d\n", "\t|"]) for _ in range(n)) for n in range(0, 120, 3)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for x in line_rules.judge(docs).collect():
        got = tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == slow_measures(texts[x["doc_id"]])
    assert line_rules.judge(odd).count() == len(ODD) and line_rules.judge(odd.limit(0)).count() == 0


def test_common_lines_leave_and_depleted_documents_with_them(spark):
    footer = "All rights reserved 2024 by the host"
    rows = [(i, story(i, 60) + f"\n{footer.upper() if i % 2 else footer.replace('2024', str(i))}", "h") for i in range(8)]
    rows += [(50, "\n".join([" ".join(["unique", "words"] * 3) + f" {k}" for k in range(3)]) + "\n" + "\n".join([footer] * 20), "h")]
    rows += [(60 + i, story(99, 60) + "\nsame copy line", "h") for i in range(9)]  # copies count once
    rows += [(80, story(7, 60) + "\n" + footer, "other"), (81, None, "h"), (82, story(8, 60), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x["doc_id"]: x for x in line_rules.judge(docs, line_texts=5).collect()}
    assert all(got[i]["lines_removed"] == 1 and got[i]["kept"] for i in range(8))
    assert got[50]["lines_removed"] == 20 and not got[50]["kept"]
    assert all(got[i]["lines_removed"] == 0 and got[i]["kept"] for i in (60, 68, 80, 82)) and not got[81]["kept"]
    cleaned = {x["doc_id"]: x["text"] for x in line_rules.clean(docs, line_texts=5).collect()}
    assert set(cleaned) == {x for x in got if got[x]["kept"]} and cleaned[1] == story(1, 60) and cleaned[80].endswith(footer)


# ---- 7: Bloom filter cascade

def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"host{i}.example/{i % 7}" for i in range(4000)]
    listed = {k for i, k in enumerate(keys) if i % 3 == 0}
    universe = spark.createDataFrame([(k,) for k in [*keys, None, keys[0]]], "key string")
    cascade = bloom_cascade.build(universe, spark.createDataFrame([(k,) for k in [*listed, "absent", None]], "key string"))
    assert len(cascade.levels) > 2
    got = dict(universe.where("key is not null").distinct().select("key", cascade.listed(F.col("key")).alias("in")).collect())
    assert {k for k, v in got.items() if v} == listed
    nothing = bloom_cascade.build(universe.limit(0), universe)
    assert not nothing.levels and universe.where(nothing.listed(F.col("key"))).count() == 0
    with pytest.raises(ValueError):
        bloom_cascade.build(universe, spark.createDataFrame([(k,) for k in listed], "key string"), most_bytes=16)


def slow_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, a) for a, h, p in Q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, action = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, action


def test_url_verdicts(spark):
    urls = [
        None, "", "no scheme", "http://a.NET/x", "http://net", "http://net/", "https://xnet/", "http://example.net/en/1", "http://EXAMPLE.net/EN/1", "http://m.example.net/en/",
        "http://example.com/de/?q#f", "http://example.com?x=/de/", "http://a.org/fr/#top", "ftp://b.org/de/", "x://y://z.net/", "http://É.org/fr/", "http://.net/", "http://a..net/",
        "http://a.net\n/x", "http://a.net/" + "x/" * 5000, "http://" + "a." * 3000 + "net/",
    ]
    rows = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls + urls)], "page_id long, url string, HOST string")
    got = bloom_cascade.judge_urls(rows, Q.URL_RULES)
    assert got.columns == ["page_id", "url", "HOST", "host_", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r["host_"], r["path"], r["rule"], r["verdict"]) == slow_verdict(r["url"]), r["url"]
    assert bloom_cascade.judge_urls(rows.limit(0), Q.URL_RULES).count() == 0


# ---- 4: packing

def slow_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


ODD_TEXTS = ["It's <|endoftext|> a<|startoftext|>b C'est d'été ÉTÉ! ΣΑΣ İstanbul", "x\u3000y\x1cz \u00a0w", "e\u0301 n\u0303", "don't!!! #$% '' ''' a'b", "ﬁ Å K", "\ud7ff 中文 テスト 한글"]


def test_word_encoder_equals_the_tokenizer():
    encoder = WordEncoder(Q.vocabulary(), limit=20)
    assert encoder.direct
    known = [t or "" for _, t, _ in ODD] + ODD_TEXTS + [story(s, 50) for s in range(8)]
    for group in ([t] for t in known), (known[k : k + 3] for k in range(0, len(known), 3)):
        for some in group:
            for text, ids in zip(some, encoder.pack(some), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == slow_ids(text)[:-1], text[:50]


def test_pieces_make_up_documents_and_fill_sequences(spark):
    texts = [t for _, t, _ in ODD] + ODD_TEXTS + [story(s, 5 + s * 9) for s in range(150)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = packing.pack(docs, Q.vocabulary(), length=256).collect()
    sequences, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    for i, text in enumerate(texts):
        ids, at = np.array(slow_ids(text), "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    tokens = sum(r["length"] for r in rows)
    assert 256 * len(sequences) - tokens < 0.04 * tokens and sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(docs.limit(0), Q.vocabulary()).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.pack(twice, Q.vocabulary()).count() == 3


def test_column_generation_reaches_the_optimum():
    # 3 + 3 + 4 fill a sequence of 10; first-fit decreasing alone would need more.
    sizes, demand = np.array([3, 4, 5]), np.array([200, 100, 60])
    plan = packing.plan_sequences(sizes, demand, 10)
    assert sum(n for _, n in plan) == 130 and (sum(c * n for c, n in plan) == demand).all()
    r = np.random.default_rng(0)
    for _ in range(5):
        sizes = np.unique(r.integers(1, 64, 30))
        demand = r.integers(1, 400, len(sizes))
        plan = packing.plan_sequences(sizes, demand, 64)
        assert (sum(c * n for c, n in plan) == demand).all() and all((c * sizes).sum() <= 64 for c, _ in plan)
        _, uses = packing.solve_patterns(sizes, demand.astype(float), 64)
        assert sum(n for _, n in plan) <= uses.sum() + 4 and uses.sum() >= (sizes * demand).sum() / 64 - 1e-6
    price, counts = packing.best_pattern(np.array([0.4, 0.6, -1.0]), np.array([3, 5, 1]), 11)
    assert price == pytest.approx(1.4) and counts.tolist() == [2, 1, 0]


# ---- 3: mixing

def test_raking_on_driver_and_by_joins_agree_and_meet_targets(spark):
    r = random.Random(4)
    cells = [(i, r.randint(0, 5000), f"s{i % 7}", f"l{i % 3}", str(i % 4)) for i in range(84)]
    table = spark.createDataFrame(cells, "cell long, tokens long, source string, lang string, topic string")
    by_driver, by_joins = (dict(raking.rake(table, raking.POWERS, 0.5, n).collect()) for n in (1000, 1))
    assert max(abs(by_driver[c] - by_joins[c]) for c in by_driver) < 1e-6
    for m, at in (("source", 2), ("lang", 3), ("topic", 4)):
        have, kept = collections.Counter(), collections.Counter()
        for c in cells:
            have[c[at]] += c[1]
            kept[c[at]] += c[1] * by_driver[c[0]]
        goal = raking.target_tokens(dict(have), raking.POWERS[m], 0.5)
        assert all(abs(kept[k] - goal[k]) < 0.002 * sum(have.values()) for k in have)
    assert all(0 <= p <= 1 for p in by_driver.values())


def test_targets_never_exceed_what_there_is():
    goal = raking.target_tokens({"a": 1000.0, "b": 10.0, "c": 0.0}, 0.0, 0.5)
    assert goal["b"] == 10 and goal["c"] == 0 and goal["a"] == pytest.approx(495)
    assert raking.target_tokens({}, 0.7, 0.5) == {}


def test_mixture_of_odd_rows(odd):
    got = raking.mix(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["probability"] <= 1 and r["sampled"] is not None for r in got)
    assert len({r["sampled"] for r in got if r["doc_id"] == 5}) == 1 and raking.mix(odd.limit(0)).count() == 0
    assert all(r["sampled"] for r in raking.mix(odd, keep=1.0).collect())


# ---- 6: classifier

def test_classifier_separates_and_learns_no_held_out_label(spark, odd):
    r = random.Random(6)
    rows = [(i, story(i, 60) if i % 3 else " ".join(w.upper() + "!!" for w in story(i, 40).split())) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    # Labels of held-out rows are turned over: a model that learnt them would be worse.
    labels = spark.createDataFrame([(i, int(bool(i % 3)) ^ (i in held)) for i in range(300)] + [(None, 1), (5000, 1), (1, None)], "doc_id long, quality int")
    training = nbsvm.training_rows(docs, labels)
    assert training.count() == 300 - len(held)
    model = nbsvm.fit(training)
    got = {x["doc_id"]: x["predicted"] for x in nbsvm.classify(docs, model).collect()}
    assert np.mean([got[i] == int(bool(i % 3)) for i in held]) > 0.95
    scored = nbsvm.classify(odd, model)
    assert scored.columns[-2:] == ["score_", "predicted"] and all(0 <= x["score_"] <= 1 for x in scored.collect())
    assert nbsvm.classify(odd.limit(0), model).count() == 0
    one = nbsvm.fit(training.where("label = 1"))
    assert all(x["score"] > 0.9 for x in nbsvm.classify(docs, one).collect())
    none = nbsvm.fit(training.limit(0))
    assert {x["score"] for x in nbsvm.classify(docs, none).collect()} == {0.5} and r


def test_dual_descent_solves_a_small_problem():
    items = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])]
    w = nbsvm.descend(items, np.ones(3), np.array([1.0, -1, 1, -1]), np.full(4, 10.0))
    assert w[0] > 0.4 and w[1] < -0.4 and abs(w[2]) < 0.2


# ---- 1: pages

def test_marginals_equal_enumeration():
    pages, labels = html_tree.examples()
    model = html_tree.fit(pages[:12], labels[:12], steps=20)
    page = html_tree.parse("<div class=nav><a>x</a></div><div><h1>Title</h1><p>Text one, two.</p></div><p>end")
    tree = html_tree.forest([page], [html_tree.features(page, {})], model.vocabulary)
    got, _ = html_tree.propagate(tree, model.weights, model.pairs)
    own = np.bincount(tree.owner, model.weights[tree.feature], len(page.tags))
    total, ones = 0.0, np.zeros(len(page.tags))
    for code in range(1 << len(page.tags)):
        y = [code >> k & 1 for k in range(len(page.tags))]
        p = np.exp(sum(own[k] * y[k] for k in range(len(y))) + sum(model.pairs[tree.kind[k], y[q], y[k]] for k, q in enumerate(page.parents) if q >= 0))
        total += p
        ones += p * np.array(y)
    assert np.allclose(got, ones / total)


def test_main_text(spark):
    body = "<h1>A title &amp; more</h1><p>One  long\n sentence, with <b>bold</b>&nbsp;words &lt;here&gt;.</p><ul><li>First item<li>Second item</ul><p>Unclosed paragraph, long enough to read."
    around = "<html><head><title>t</title><style>p{}</style><script>var a='</p><p>no'</script></head><body><nav><ul><li><a>Home</a><li><a>News</a></ul></nav><!-- <p>gone</p> -->{}<div class='comments'><p>Nice text, I like it.</p></div><form><input><button>Send</button></form><aside class=sidebar><p>Other things, here.</p></aside><footer>&copy; me</footer></body></html>"
    pages = [(i, f"u{i}", around.replace("{}", f"<{t}>{body}</{t}>"), "x") for i, t in enumerate(["article", "main"])]
    pages += [(2, None, around.replace("{}", f"<div class='post-content'>{body}</div>"), "x"), (3, "u", None, "x"), (4, "u", "", "x"), (5, "u", "<" * 3000, "x"), (6, "u", "<div a='" * 2000, "x"), (7, "u", "<div>" * 3000 + "deep", "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    model = html_tree.train(table)
    got = {r["page_id"]: r["text_"] for r in html_tree.extract(table, model).collect()}
    want = "A title & more\nOne long sentence, with bold words <here>.\nFirst item\nSecond item\nUnclosed paragraph, long enough to read."
    assert got[0] == got[1] == got[2] == want and got[3] == got[4] == ""
    assert html_tree.extract(table.limit(0), html_tree.train(table.limit(0))).count() == 0


def test_model_extracts_unseen_pages_of_the_corpus(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs the generated tables")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    model = html_tree.train(pages, most=40)

    def plain(source):
        inside = re.sub(r"<[^>]*$", "", (re.search(r"<article>(.*?)(?:</article>|$)", source or "", re.S) or ["", ""])[1])
        parts = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:h1|p)>", "\x00", inside))).split("\x00")
        return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)

    rows = html_tree.extract(pages, model).select("html", "text").collect()
    assert np.mean([r["text"] == plain(r["html"]) for r in rows]) > 0.98


# ---- 2: neighbours

def test_search_reaches_the_recall_and_returns_exact_distances(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16))
    points = np.concatenate([centres[r.integers(0, 20, 1500)] + 0.2 * r.normal(size=(1500, 16)), np.tile(centres[0], (300, 1))])
    bad = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [float("inf")] + [1.0] * 15), (9005, [None] + [1.0] * 15), (9006, [1.0] * 3), (None, [1.0] * 16), (9007, [])]
    table = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)] + [(*b, 0) for b in bad], "vec_id long, embedding array<double>, rank int")
    for chunk in (100_000, 70):
        rows = multi_index.search(table, F.pmod("vec_id", F.lit(100)) == 0, chunk_rows=chunk).collect()
        got = collections.defaultdict(list)
        for x in sorted(rows, key=lambda x: x["rank"]):
            got[x["query_id"]].append((x["score"], x["vec_id"]))
        assert set(got) == set(range(0, 1800, 100)) and all(v == sorted(v) and len(v) == 10 for v in got.values())
        hits = 0
        for q, found in got.items():
            distance = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
            distance[q] = np.inf
            true = np.lexsort((np.arange(len(points)), distance))[:10]
            hits += len(set(true.tolist()) & {i for _, i in found})
            assert all(d == pytest.approx(distance[i], abs=1e-12) for d, i in found)
        assert hits >= 0.9 * 180
    few = table.where("vec_id in (0, 1, 2, 9001)")
    assert [(x["query_id"], x["rank"]) for x in multi_index.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert multi_index.search(table.limit(0), F.lit(True)).count() == 0 and multi_index.search(few.where("vec_id = 0"), F.lit(True)).count() == 0


def test_cells_are_visited_by_summed_distance():
    r = np.random.default_rng(2)
    books, counts = (r.normal(size=(6, 3)), r.normal(size=(5, 3))), r.integers(0, 3, (6, 5))
    query = r.normal(size=6)
    walked = list(multi_index.visit(query, books, counts))
    total = lambda a, b: ((query[:3] - books[0][a]) ** 2).sum() + ((query[3:] - books[1][b]) ** 2).sum()
    sums = [total(a, b) for a, b, _ in walked]
    assert sums == sorted(sums) and {(a, b) for a, b, _ in walked} == set(zip(*np.nonzero(counts), strict=True)) and walked[-1][2] == counts.sum()


# ---- 5: repeated passages

def slow_passages(rows, length=50):
    seen = collections.defaultdict(set)
    split = [(d, [(m[0], *m.span()) for m in WORDS.finditer(t or "")]) for d, t in rows]
    window = lambda w, i: tuple(x[0] for x in w[i : i + length])
    for d, w in split:
        for i in range(len(w) - length + 1):
            seen[window(w, i)].add(d)
    found = set()
    for d, w in split:
        spans = []
        for i in range(len(w) - length + 1):
            if len(seen[window(w, i)]) > 1:
                if spans and i - spans[-1][1] <= length:
                    spans[-1][1] = i
                else:
                    spans.append([i, i])
        found |= {(d, w[a][1], w[b + length - 1][2]) for a, b in spans}
    return found


def test_passages_equal_all_windows(spark, odd):
    passage, other, edge = story(1, 60), story(2, 50), story(3, 49)
    rows = [(i, story(10 + i, 40 + 7 * i) + "\n" + passage + " " + story(40 + i, 30)) for i in range(12)]
    rows += [(20, other), (21, "é😀  " + other.replace(" ", "\t \n") + " x"), (22, edge), (23, edge), (24, passage + " " + passage), (24, passage), (25, story(5, 50) * 2)]
    rows += [(26, "w " * 500), (27, "w " * 300), (28, story(6, 300)), (29, story(6, 300)), (30, None), (31, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sparse_suffix.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in got} == slow_passages(rows)
    first = {r["doc_id"]: r["first_doc_id"] for r in got}
    assert first[29] == 28 and first[21] == 20 and first[11] == 0 and not {22, 23, 25} & set(first)
    assert sparse_suffix.repeated_passages(docs.limit(0)).count() == 0
    assert sparse_suffix.repeated_passages(odd).count() == 0
    nameless = spark.createDataFrame([(None, passage), (1, passage)], "doc_id long, text string")
    assert {r["doc_id"] for r in sparse_suffix.repeated_passages(nameless).collect()} == {None, 1}


def test_minimisers_cover_every_window():
    r = np.random.default_rng(3)
    grams = r.integers(0, 1 << 63, 500).astype(np.uint64)
    grams[100:160] = grams[100]  # ties go to the first
    at = set(sparse_suffix.minimisers(grams, 24).tolist())
    order = (grams & ~sparse_suffix._LOW).astype(object)
    assert at == {i + min(range(24), key=lambda k: (order[i + k], k)) for i in range(477)}
