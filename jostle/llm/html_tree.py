"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree. Each has a hidden label, main text or not, with a potential from its
features, and each parent-child pair has a potential by the kind of the child. Sum-product messages go up and
down the tree once and give exact marginals; the text of elements whose marginal is at least one half is kept.
The potentials are fitted by gradient ascent on the likelihood of labelled pages, with the same messages.

Labelled pages are the layouts in ``html_examples`` and a bounded sample of the corpus: pages with exactly one
``article`` or ``main`` element, whose inside is their main text but for the parts that say otherwise.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.llm.common import free_name, texts
from jostle.llm.html_examples import LAYOUTS

#: Corpus pages that are taken as labelled examples at most, chosen by hash.
LABELLED_PAGES = 200
#: Longer pages are no examples (they are extracted like all others).
EXAMPLE_CHARS = 100_000
STEPS = 150
#: Nodes that one pass of messages holds; larger batches of pages are cut between pages.
PASS_NODES = 200_000

# Element names of HTML by their role in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template noscript iframe svg object canvas audio video textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements that may end in their own start tag.
FOREIGN = frozenset(["svg"])
#: Skipped elements whose content is markup: without an end tag they do not hide the rest of the page.
OPEN_ENDED = frozenset("svg object canvas audio video".split())
#: An element that ends an open one of these names, up to an element of the third set.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Inside an article these open something else.
NOT_MAIN = frozenset("nav aside form footer button select dialog menu".split())
#: Kinds of child elements that have pair potentials of their own.
PAIR_KINDS = {name: k + 1 for k, name in enumerate("p h1 h2 h3 h4 li ul ol div section article main blockquote td tr table header footer nav aside form".split())}

_TOKEN = re.compile(
    # A comment may end at once (<!-->, <!--->). In a tag only a value after "=" may be quoted, so that other quotes hide nothing.
    r"""<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'=][^\s>]*+)|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)"""
)
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in SKIPPED}
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[A-Za-z]{2,}")


@dataclass
class Page:
    """Block elements of a page in page order (a parent before its children), and its runs of text."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)  # element, text with references decoded
    linked: list[int] = field(default_factory=list)  # characters inside links, per element


def parse(source: str) -> Page:
    """The block tree of a page. Broken markup is mended as browsers do: implied ends, unclosed elements."""
    page = Page(["#page"], [-1], [""], [], [0])
    open_: list[tuple[str, int]] = [("#page", 0)]  # all open elements with the block that holds their text
    pieces: list[str] = []
    counts: dict[str, int] = defaultdict(int)  # open elements by name, so that an end without a beginning costs nothing
    links, at, size = 0, 0, len(source)

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                page.runs.append((open_[-1][1], text))
            pieces.clear()

    def leave(depth: int) -> None:
        nonlocal links
        if any(block != open_[depth - 1][1] for _, block in open_[depth:]):
            flush()
        for name, _ in open_[depth:]:
            links -= name == "a"
            counts[name] -= 1
        del open_[depth:]

    while at < size:
        start = source.find("<", at)
        start = size if start < 0 else start
        if start > at:
            pieces.append(source[at:start])
            if links:
                page.linked[open_[-1][1]] += start - at
        if start == size:
            break
        m = _TOKEN.match(source, start)
        if m is None:  # a lone "<" is text
            pieces.append("<")
            at = start + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for depth in range(len(open_) - 1 if counts[name] else 0, 0, -1):
                if open_[depth][0] == name:
                    leave(depth)
                    break
            continue
        if name in SKIPPED:
            if name not in INLINE:
                if name in FOREIGN and m[3].endswith("/"):
                    continue
                end = _END[name].search(source, at)
                if end is not None:
                    at = source.find(">", end.end()) + 1 or size
                elif name not in OPEN_ENDED:  # the content of these is read on as browsers do
                    at = size
            continue
        if name in CLOSES_P:
            for depth in range(len(open_) - 1 if counts["p"] else 0, 0, -1):
                if open_[depth][0] == "p":
                    leave(depth)
                    break
                if open_[depth][0] not in INLINE:
                    break
        elif name in ENDS:
            ended, until = ENDS[name]
            for depth in range(len(open_) - 1 if any(counts[e] for e in ended) else 0, 0, -1):
                if open_[depth][0] in ended:
                    leave(depth)
                    break
                if open_[depth][0] in until:
                    break
        if name in VOID:
            if name == "hr":
                flush()
            else:
                pieces.append(" ")
            continue
        block = open_[-1][1]
        if name not in INLINE:
            flush()
            page.tags.append(name)
            page.parents.append(block)
            page.attributes.append(m[3])
            page.linked.append(0)
            block = len(page.tags) - 1
        links += name == "a"
        counts[name] += 1
        open_.append((name, block))
    flush()
    return page


_SIZES = (1, 20, 60, 140, 300, 700)


def _bucket(value: float, edges: tuple) -> int:
    return sum(value >= e for e in edges)


def features(page: Page, cache: dict[tuple[str, str], tuple[str, ...]]) -> list[list[str]]:
    """Names of the features of every element."""
    n = len(page.tags)
    chars, stops = [0] * n, [0] * n
    for node, text in page.runs:
        chars[node] += len(text)
        stops[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
    deep_chars, deep_links = chars[:], page.linked[:]
    children = [0] * n
    for k in range(n - 1, 0, -1):  # children come after parents
        p = page.parents[k]
        deep_chars[p] += deep_chars[k]
        deep_links[p] += deep_links[k]
        children[p] += 1
    every, before = max(deep_chars[0], 1), 0
    found = []
    for k in range(n):
        key = (page.tags[k], page.attributes[k])
        fixed = cache.get(key)
        if fixed is None:
            words = []
            for name, a, b, c in _ATTRIBUTE.findall(key[1]):
                if name.lower() != "y":
                    words += [w.lower() for w in _NAME.findall(a or b or c)]
            fixed = ("tag=" + key[0], *["name=" + w for w in dict.fromkeys(words)]) + (() if words else ("unnamed",))
            if len(cache) < 50_000:
                cache[key] = fixed
        parent = page.tags[page.parents[k]] if k else ""
        density = deep_links[k] / max(deep_chars[k], 1)
        found.append([
            *fixed, "in=" + parent, f"chars={_bucket(chars[k], _SIZES)}", f"deep={_bucket(deep_chars[k], _SIZES)}",
            f"stops={min(stops[k], 3)}", f"links={_bucket(density, (0.01, 0.3, 0.7))}", f"kids={_bucket(children[k], (1, 3, 8))}",
            f"share={_bucket(deep_chars[k] / every, (0.05, 0.2, 0.5, 0.9))}", f"at={_bucket(before / every, (0.02, 0.5, 0.9, 0.98))}",
        ])
        before += chars[k]
    return found


def labels(page: Page) -> list[int]:
    """Labels from the attribute ``y`` of examples: an element without it follows its parent."""
    found = []
    for k, text in enumerate(page.attributes):
        own = next((a or b or c for name, a, b, c in _ATTRIBUTE.findall(text) if name.lower() == "y"), None)
        found.append(int(own) if own is not None else found[page.parents[k]] if k else 0)
    return found


def corpus_labels(page: Page) -> list[int] | None:
    """Labels of a page with exactly one article or main element; None for others."""
    mains = [k for k, t in enumerate(page.tags) if t in ("article", "main")]
    if len(mains) != 1:
        return None
    found = [0] * len(page.tags)
    for k in range(1, len(found)):
        found[k] = int(k == mains[0] or (found[page.parents[k]] and page.tags[k] not in NOT_MAIN))
    return found


@dataclass
class Forest:
    """Pages side by side: arrays over all elements."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]  # elements by depth
    owner: np.ndarray  # element of each feature entry
    feature: np.ndarray


def forest(pages: list[Page], named: list[list[list[str]]], vocabulary: dict[str, int]) -> Forest:
    parents, kinds, depths, owners, ids, base = [], [], [], [], [], 0
    for page, names in zip(pages, named, strict=True):
        depth = [0] * len(page.tags)
        for k, p in enumerate(page.parents):
            if k:
                depth[k] = depth[p] + 1
            parents.append(p + base if k else -1)
            kinds.append(PAIR_KINDS.get(page.tags[k], 0))
            known = [vocabulary[f] for f in names[k] if f in vocabulary]
            ids += known
            owners += [base + k] * len(known)
        depths += depth
        base += len(page.tags)
    depth = np.array(depths, np.int64)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1))
    return Forest(np.array(parents, np.int64), np.array(kinds, np.int64), np.split(order, cuts), np.array(owners, np.int64), np.array(ids, np.int64))


@dataclass(frozen=True)
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray  # of each feature, for label 1
    pairs: np.ndarray  # [kind of child, label of parent, label of child]


def propagate(trees: Forest, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals of label 1, and of (label of parent, label) for every element with a parent."""
    n = len(trees.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = np.bincount(trees.owner, weights[trees.feature], n)
    message = np.zeros((n, 2))
    for level in trees.levels[:0:-1]:
        pair = pairs[trees.kind[level]]
        message[level] = np.logaddexp(belief[level, None, 0] + pair[:, :, 0], belief[level, None, 1] + pair[:, :, 1])
        np.add.at(belief, trees.parent[level], message[level])
    total, joint = belief.copy(), np.zeros((n, 2, 2))
    for level in trees.levels[1:]:
        rest = total[trees.parent[level]] - message[level]
        joint[level] = rest[:, :, None] + pairs[trees.kind[level]] + belief[level, None, :]
        total[level] = np.logaddexp(joint[level, 0], joint[level, 1])
        top = joint[level].max(axis=(1, 2), keepdims=True)
        joint[level] = np.exp(joint[level] - top)
        joint[level] /= joint[level].sum(axis=(1, 2), keepdims=True)
        total[level] -= total[level].max(axis=1, keepdims=True)
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), joint


def fit(pages: list[Page], labelled: list[list[int]], steps: int = STEPS) -> Model:
    """Potentials that make the labels of the pages likely, with an L2 penalty, by Adam on exact gradients.

    Each page is seen twice: as it is, and with its article and main elements and all names hidden, so that
    the shape of the text counts too.
    """
    hidden = re.compile(r"tag=(?:article|main)$|in=(?:article|main)$|name=|unnamed$")
    named = [features(p, {}) for p in pages]
    bare = [[[f for f in names if not hidden.match(f)] for names in page] for page in named]
    pages, named = pages + pages, named + bare
    label = np.array([y for ys in labelled + labelled for y in ys])
    counts: dict[str, int] = {}
    for page in named:
        for names in page:
            for f in names:
                counts[f] = counts.get(f, 0) + 1
    vocabulary = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= 3))}
    trees = forest(pages, named, vocabulary)
    child = np.nonzero(trees.parent >= 0)[0]
    kinds = max(PAIR_KINDS.values()) + 1
    theta = np.zeros(len(vocabulary) + kinds * 4)
    seen_features = np.bincount(trees.feature, label[trees.owner], len(vocabulary))
    slot = trees.kind[child] * 4 + label[trees.parent[child]] * 2 + label[child]
    seen_pairs = np.bincount(slot, minlength=kinds * 4)
    mean, square = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, steps + 1):
        pairs = theta[len(vocabulary):].reshape(kinds, 2, 2)
        marginal, joint = propagate(trees, theta[: len(vocabulary)], pairs)
        expected = np.zeros((kinds, 2, 2))
        np.add.at(expected, trees.kind[child], joint[child])
        gradient = np.concatenate([
            seen_features - np.bincount(trees.feature, marginal[trees.owner], len(vocabulary)), seen_pairs - expected.ravel(),
        ]) / len(pages) - 0.004 * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta += 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(vocabulary, theta[: len(vocabulary)], theta[len(vocabulary):].reshape(kinds, 2, 2))


def examples() -> tuple[list[Page], list[list[int]]]:
    """The layouts, each filled several times with words of varying number."""
    random = np.random.default_rng(3)
    syllables = "an ber con de el fi gar hin is jo ka lum mi no or pa qui re sto ti un ver wa xi yo zen".split()

    def fill(m: re.Match) -> str:
        count = max(1, int(int(m[2]) * random.choice([0.4, 0.8, 1.0, 2.0])))
        if m[1] == "#":
            return " ".join(["".join(random.choice(syllables, 2))] * count)
        words = ["".join(random.choice(syllables, random.integers(1, 4))) for _ in range(count)]
        for k in range(6, count, 9):
            words[k] += random.choice([",", ".", "."])
        return " ".join(words).capitalize()

    pages, found = [], []
    for _ in range(6):
        for layout in LAYOUTS:
            page = parse(re.sub(r"([@#])(\d+)", fill, layout))
            pages.append(page)
            found.append(labels(page))
    return pages, found


def train(pages: DataFrame, source: str = "html", most: int = LABELLED_PAGES) -> Model:
    """The model from the examples and at most ``most`` labelled pages of the corpus; none are needed."""
    wanted = pages.select(F.col(source).alias("h")).where(F.lower("h").rlike("<(?:article|main)[\\s>]") & (F.length("h") <= EXAMPLE_CHARS))
    # By hash, so that every task sends its part of about ``most`` pages and no more.
    share = 0.9 * most / max(wanted.count(), 1)
    rows = wanted.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < share * (1 << 30)).limit(most).collect()
    known, found = examples()
    for row in sorted(rows, key=lambda r: r["h"]):  # whatever the order of tasks
        page = parse(row["h"])
        label = corpus_labels(page)
        if label is not None:
            known.append(page)
            found.append(label)
    return fit(known, found)


def main_texts(sources: list[str], model: Model) -> list[str]:
    """The main text of each page; empty where there is none."""
    done: list[str] = []
    cache: dict = {}
    pages: list[Page] = []
    names: list[list[list[str]]] = []

    def flush() -> None:
        if not pages:
            return
        marginal, _ = propagate(forest(pages, names, model.vocabulary), model.weights, model.pairs)
        at = 0
        for page in pages:
            done.append("\n".join(text for node, text in page.runs if marginal[at + node] >= 0.5))
            at += len(page.tags)
        pages.clear()
        names.clear()

    held = 0
    for source in sources:
        page = parse(source)
        pages.append(page)
        names.append(features(page, cache))
        held += len(page.tags)
        if held > PASS_NODES:
            flush()
            held = 0
    flush()
    return done


def extract(pages: DataFrame, model: Model, source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of every whole page in ``out``; null and empty pages give empty text.

    If ``pages`` has a column ``out``, the new one gets trailing underscores. Blocks are joined by one line end; white space inside a block is one blank; nothing is cut off.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model.vocabulary, model.weights, model.pairs))  # a few hundred potentials

    @F.arrow_udf(T.StringType())
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(main_texts(list(texts(column)), Model(*shared.value)), pa.string())

    return pages.withColumn(free_name(pages, out), extracted(F.col(source)))
