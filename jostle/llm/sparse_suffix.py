"""Repeated passages across documents by sparse suffix arrays.

Of all suffixes (starting at words) only those at minimisers are kept: the position with the smallest hash of
``GRAM`` words among ``WINDOW`` consecutive ones. The choice depends on content alone, so two copies of a
passage of ``LENGTH`` words keep the same suffixes, and the first of them has ``RIGHT`` words of the passage
to its right and fewer than ``WINDOW`` to its left. The kept suffixes are sorted by (a hash of) their first
``RIGHT`` words and each is compared with its neighbours. Matches are then extended left and right: the
passages of ``LENGTH`` words around each match are compared as a whole, those found in two documents are
joined to maximal spans. Nothing depends on how often a passage occurs: there are no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.llm.common import WordCache
from jostle.plans.joins import attach
from jostle.plans.staging import discard, stage

LENGTH = 50
GRAM = 8
WINDOW = 24
RIGHT = LENGTH - WINDOW + 1

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = np.uint64((1 << 24) - 1)
#: Ids of documents are below this.
_UNNAMED = 1 << 62
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, as many as are asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (
                np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size - 1, b, np.uint64)))) for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any run of words of a text, by differences of prefix sums."""

    def __init__(self, words: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(words) + 1)
        self.sums = np.concatenate(([np.uint64(0)], np.add.accumulate(words * up[:-1])))

    def runs(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts])


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the smallest gram (the first, if tied) of some ``window`` consecutive ones."""
    n = len(grams)
    if n < window:
        return np.empty(0, np.int64)
    place = np.arange(n, dtype=np.uint64)
    least, width = (grams & ~_LOW) | (place & _LOW), 1
    while 2 * width <= window:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < window:
        least = np.minimum(least[: n - window + 1], least[window - width : n - width + 1])
    start = np.arange(len(least), dtype=np.uint64)
    return np.unique(start + (((least & _LOW) - start) & _LOW)).astype(np.int64)


def _cache() -> WordCache:
    return WordCache(xxhash.xxh64_intdigest)


def suffixes(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """(ident, text) -> (key, ident, pos) of the suffixes at minimisers, keyed by their first words."""
    right = length - WINDOW + 1
    powers, cache = Powers(_BASES[0]), _cache()
    for batch in batches:
        cache.trim()
        keys, idents, places = [], [], []
        for ident, text in zip(batch.column("ident").to_pylist(), batch.column("text"), strict=True):
            words = text.as_py().encode().split()
            if len(words) < length:
                continue
            hashes = Hashes(np.array([cache[w] for w in words], dtype=np.uint64), powers)
            grams = hashes.runs(np.arange(len(words) - GRAM + 1), GRAM)
            at = minimisers(grams, WINDOW)
            at = at[at + right <= len(words)]
            keys.append(hashes.runs(at, right))
            places.append(at)
            idents.append(np.full(len(at), ident, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(idents)), pa.array(np.concatenate(places).astype(np.int32))],
                names=["key", "ident", "pos"],
            )


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, ident, pos) -> (ident, pos) of the suffixes with the key of a neighbour.

    The first and last suffix of a task may have their neighbour in another one and are always kept.
    """
    held = None  # the last row seen, and whether it is already known to match

    def out(ident: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ident, pa.int64()), pa.array(pos, pa.int32())], names=["ident", "pos"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, ident, pos = (batch.column(n).to_numpy() for n in ("key", "ident", "pos"))
        match = np.zeros(len(key) + 1, bool)
        if held is None:
            key, ident, pos, match = np.append(key[:1], key), np.append(ident[:1], ident), np.append(pos[:1], pos), match
            same = key[1:] == key[:-1]
            same[0], match[1] = False, True  # the doubled first row only stands in front
            first = 1
        else:
            key, ident, pos = np.append(held[0], key), np.append(held[1], ident), np.append(held[2], pos)
            same, match[0], first = key[1:] == key[:-1], held[3], 0
        match[1:] |= same
        match[:-1] |= same
        held = (key[-1:], ident[-1:], pos[-1:], match[-1])
        keep = np.nonzero(match[:-1])[0]
        keep = keep[keep >= first]
        yield out(ident[keep], pos[keep])
    if held is not None:
        yield out(held[1], held[2])


def passages(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """(ident, tag, text, matches) -> (hash, ident, tag, word): every passage of ``length`` words around a match, by its first word."""
    powers, cache = Powers(_BASES[1]), _cache()
    for batch in batches:
        cache.trim()
        found, idents, tags, places = [], [], [], []
        rows = zip(*(batch.column(n).to_pylist() for n in ("ident", "tag", "text", "matches")), strict=True)
        for ident, tag, text, matches in rows:
            words = text.encode().split()
            if len(words) < length:
                continue
            around = np.zeros(len(words) + 1, np.int64)
            at = np.array(matches, np.int64)
            np.add.at(around, np.clip(at - WINDOW + 1, 0, len(words)), 1)
            np.add.at(around, np.clip(at + 1, 0, len(words)), -1)
            starts = np.nonzero(np.cumsum(around)[: len(words) - length + 1] > 0)[0]
            found.append(Hashes(np.array([cache[w] for w in words], dtype=np.uint64), powers).runs(starts, length).view(np.int64))
            idents.append(np.full(len(starts), ident, np.int64))
            tags.append(np.full(len(starts), tag, np.int64))
            places.append(starts.astype(np.int32))
        if found:
            columns = [pa.array(np.concatenate(c), t) for c, t in ((found, pa.int64()), (idents, pa.int64()), (tags, pa.int64()), (places, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "ident", "tag", "word"])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def offsets(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Code points at which spans (first word, number of words) of a text begin and end."""
    found = []
    for value, own in zip(text, spans.to_pylist(), strict=True):
        words = [m.span() for m in _WORD.finditer(value.as_py())]
        found.append([{"start": words[x["word"]][0], "end": words[x["word"] + x["words"] - 1][1]} for x in own])
    return pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def _texts(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """(doc_id, text, ident, tag) of texts that can hold a passage; the tag tells texts of one id apart."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = own.where(F.length("text") >= 2 * length - 1)  # so many characters at least
    # Texts without an id get one above all others, from their hash.
    unnamed = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(_UNNAMED))
    own = own.withColumn("ident", F.coalesce("doc_id", unnamed))
    return own.withColumn("tag", F.pmod(F.xxhash64("text"), F.lit(1 << 38)))


def _matched(own: DataFrame, length: int) -> DataFrame:
    """(ident, tag, matches): where the suffixes of a text have a neighbour with the same first words."""
    keyed = own.select(F.xxhash64("ident", "tag").alias("ident"), "text").mapInArrow(lambda b: suffixes(b, length), "key long, ident long, pos int")
    # Staged, because range partitioning samples its input first. Text and position cut through hot keys.
    kept = stage(keyed, "suffixes")
    ordered = kept.repartitionByRange("key", "ident", "pos").sortWithinPartitions("key", "ident", "pos")
    matches = ordered.mapInArrow(neighbours, "ident long, pos int")
    hits = stage(matches.groupBy(F.col("ident").alias("at")).agg(F.collect_set("pos").alias("matches")), "matches")  # bounded by the text
    discard(kept)
    return hits


def _repeated(own: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """(ident, tag, word, words, first): maximal runs of passages that another document holds."""
    around = attach(own.withColumn("at", F.xxhash64("ident", "tag")), hits, ["at"], salts=1)
    found = stage(around.select("ident", "tag", "text", "matches").mapInArrow(lambda b: passages(b, length), "hash long, ident long, tag long, word int"), "passages")
    shared = found.groupBy("hash").agg(F.min("ident").alias("first"), F.max("ident").alias("most"))
    shared = stage(shared.where(F.col("first") != F.col("most")).select("hash", "first"), "shared")
    copies = found.join(shared, "hash").select("ident", "tag", "word", "first")
    text_of = Window.partitionBy("ident", "tag").orderBy("word")
    new = F.when(F.col("word") - F.lag("word").over(text_of) <= length, 0).otherwise(1)
    numbered = copies.withColumn("new", new).withColumn("span", F.sum("new").over(text_of.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("ident", "tag", "span").agg(
        F.min("word").alias("word"), (F.max("word") - F.min("word") + length).alias("words"), F.min("first").alias("first")
    )
    spans = stage(spans.groupBy("ident", "tag").agg(F.collect_list(F.struct("word", "words", "first")).alias("spans")), "spans")
    discard(found)
    return spans


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, start, end, start_word, n_words, first_doc_id): the maximal spans of passages of at least
    ``length`` words that another document holds too; offsets in code points, end exclusive.

    Words are separated by ASCII white space and compared as they are. Rows that share an id are one
    document and do not repeat each other; without an id, equal texts are one document (reported with
    its null id). ``first_doc_id`` is the smallest id that holds part of the span (null if that document has none); a
    document is the first itself where the two are equal. Spans that overlap or touch are one. Null, empty
    and shorter texts have no span; repeated rows give their spans once. Passages are compared by 64-bit
    hashes, and only around suffixes whose own first words agree by another one.
    """
    if length < WINDOW + GRAM - 1:
        raise ValueError(f"length must be at least {WINDOW + GRAM - 1}")
    own = _texts(docs, doc_id, text, length)
    hits = _matched(own, length)
    spans = _repeated(own, hits, length)
    placed = attach(own, spans, ["ident", "tag"], salts=1).withColumn("at", offsets("text", "spans"))
    each = placed.select("doc_id", "ident", "tag", F.explode(F.arrays_zip("spans", "at")).alias("s"))
    named = F.when(F.col("s.spans.first") < _UNNAMED, F.col("s.spans.first"))
    return each.select(
        "doc_id", F.col("s.at.start").alias("start"), F.col("s.at.end").alias("end"), F.col("s.spans.word").cast("long").alias("start_word"),
        F.col("s.spans.words").cast("long").alias("n_words"), named.alias("first_doc_id"),
    ).distinct()
