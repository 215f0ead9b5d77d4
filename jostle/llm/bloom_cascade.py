"""URL filters by a Bloom filter cascade over the corpus's complete key universe.

Level 1 holds the listed keys, level 2 the keys of the universe that level 1 takes wrongly, level 3 the listed
keys that level 2 takes wrongly, and so on until no key is taken wrongly. The first level that does not
take a key decides, and for every key of the universe the answer is exact. The filters are binary
literals, one for each level, so a URL is judged on its row: no join, no shuffle. The list is a table of any size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jostle.llm.common import free_name
from jostle.plans.staging import stage

#: A level of more bytes is refused, as every task gets it with its plan. A level takes 1.44 bits a key for each halving of its rate:
#: about 100 million keys beside ten times as many others fit.
MOST_BYTES = 64 << 20
#: Fixed value: at this rate of wrong answers a filter and the next one together are smallest.
LATER_RATE = 0.5

BLOCK, ALLOW = "block", "allow"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    bits: bytes  # bit p is bit p % 8 of byte p // 8
    size: int
    hashes: int
    seed: int

    def takes(self, key: Column) -> Column:
        bits = F.lit(bytearray(self.bits))  # one literal, whatever the number of hashes

        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substr(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
            return F.getbit(byte.cast("int"), F.pmod(place, F.lit(8)).cast("int")) == 1

        return F.forall(F.array(*places(key, self.size, self.hashes, self.seed)), is_set)


def places(key: Column, size: int, hashes: int, seed: int) -> list[Column]:
    """Bit positions of a key, from two hashes."""
    first, second = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(size)), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(size))
    return [F.pmod(first + i * second, F.lit(size)).cast("long") for i in range(hashes)]


def _level(keys: DataFrame, count: int, rate: float, seed: int, most_bytes: int) -> Level:
    size = max(64, 8 * math.ceil(1.4427 * count * math.log2(1 / rate) / 8))
    if size // 8 > most_bytes:
        raise ValueError(f"a filter of {size // 8} bytes exceeds {most_bytes}; split the list or raise the bound")
    hashes = max(1, round(math.log2(1 / rate)))
    set_bits = keys.select(F.explode(F.array(*places(F.col("key"), size, hashes, seed))).alias("p"))
    words = set_bits.groupBy(F.shiftright("p", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(p % 8 as int))")).alias("byte"))
    filled = bytearray(size // 8)
    for row in words.toLocalIterator():  # at most one row for each byte of a filter of checked size
        filled[row["at"]] = row["byte"]
    return Level(bytes(filled), size, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    """Membership in a list, exact for the keys of the universe it was built over."""

    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)  # taken by all levels: the last one decides
        for number in range(len(self.levels), 0, -1):
            answer = F.when(self.levels[number - 1].takes(key), answer).otherwise(F.lit(number % 2 == 0))
        return answer


def build(universe: DataFrame, listed: DataFrame, most_bytes: int = MOST_BYTES) -> Cascade:
    """The cascade of the ``listed`` keys (column key) over the keys of ``universe`` (column key).

    Nulls and repeated keys are ignored. Listed keys outside the universe cannot be asked for and are
    left out. Rates follow the sizes of the two sides, so no key is left wrong and no level is large.
    """
    keys = stage(universe.where("key is not null").select("key").distinct(), "universe")
    inside = stage(keys.join(listed.select("key").where("key is not null").distinct(), "key", "left_semi"), "listed")
    outside = keys.join(inside, "key", "left_anti")
    held, other = inside, stage(outside, "others")
    n_held, n_other, levels = held.count(), other.count(), []
    rate = min(LATER_RATE, max(1e-9, n_held * math.sqrt(0.5) / max(n_other, 1)))
    while n_held:
        level = _level(held, n_held, rate, len(levels) + 1, most_bytes)
        levels.append(level)
        wrong = stage(other.where(level.takes(F.col("key"))), "wrong")
        held, other, n_held = wrong, held, wrong.count()
        rate = LATER_RATE
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII capitals lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, CAPITALS, SMALL), path


def candidates(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Keys that a rule for this host and path may have, longest first.

    A key is the last ``labels`` labels of the host with the first ``lengths`` characters of the path, for
    the counts and lengths that rules have; so their number does not grow with host or path.
    """
    parts = F.split(host, r"\.")
    keys = [F.lit(None).cast("string")]
    for n in labels:
        suffix = F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
        for length in lengths:
            prefix = F.when(F.length(path) >= length, F.substring(path, 1, length) if length else F.lit(""))
            keys.append(F.concat(suffix, prefix))
    every = F.array_distinct(F.array_compact(F.array(*keys)))
    longest = F.array_sort(F.transform(every, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))
    return F.transform(longest, lambda s: s["key"])


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, url: str = "url", otherwise: str = ALLOW, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict (appended in this order).

    ``rules``: (action, host, path), as a sequence or a table with these columns. A rule fits its host and all subdomains if the path starts with its path;
    the longest decides, ties going to the smaller one. Block and allow rules each have a cascade over all keys of
    the corpus. A URL that no listed key fits gets ``otherwise``: the cascades prove it unlisted. Null urls,
    empty tables and repeated rows need no care: each row is judged on its own. If ``pages`` has columns
    of these names, the new ones get trailing underscores.
    """
    spark = pages.sparkSession
    own = {n: free_name(pages, n) for n in ("host", "path", "rule", "verdict", "keys")}
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")
    small = F.translate("host", CAPITALS, SMALL)
    rules = stage(rules.select("action", F.concat(small, "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")), "rules")
    # Few numbers: how many labels hosts of rules have, and how long their paths are.
    distinct = lambda c: sorted((r[0] for r in rules.where(F.col(c).isNotNull()).select(c).distinct().collect()), reverse=True)
    host, path = host_and_path(F.col(url))
    split = pages.withColumns({own["host"]: host, own["path"]: path})
    split = split.withColumn(own["keys"], candidates(F.col(own["host"]), F.col(own["path"]), distinct("labels"), distinct("length")))
    universe = stage(split.select(F.explode(own["keys"]).alias("key")).distinct(), "keys")
    cascades = {action: build(universe, rules.where(F.col("action") == action).select("key"), most_bytes) for action in (BLOCK, ALLOW)}
    # Each key is asked once; the first one that a rule has decides.
    told = F.transform(own["keys"], lambda k: F.struct(k.alias("key"), F.when(cascades[BLOCK].listed(k), BLOCK).when(cascades[ALLOW].listed(k), ALLOW).alias("action")))
    judged = split.withColumn(own["rule"], F.get(F.filter(told, lambda t: t["action"].isNotNull()), F.lit(0)))
    return judged.withColumn(own["verdict"], F.coalesce(F.col(own["rule"])["action"], F.lit(otherwise))).withColumn(own["rule"], F.col(own["rule"])["key"]).drop(own["keys"])
