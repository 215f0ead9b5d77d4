"""SimHash near-duplicates: fingerprints, segment-popcount embedding, grid range join.

A fingerprint is embedded as the bit counts of its two-bit segments. Flipping one bit moves one count
by one, so the Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. The segments are dealt to ``g`` groups with ``d <= 2 g - 1``: fingerprints within ``d``
bits agree up to Manhattan distance one in some group. That range join is an equality join of grid
cells, one side taken with its upward neighbours; its rows are verified on the fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.llm.common import free_name, keyed, texts
from jostle.llm.components import components
from jostle.plans.staging import stage

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
_EVEN_BITS = 0x5555555555555555


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as a signed 64-bit integer; 0 without words.

    A-Z is lower-cased; fewer than ``width`` words are one shingle; repeated shingles count again.
    """
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(words) - width] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)],
            dtype=np.uint64,
        )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # a bounded piece of a very long text at a time
        part = hashes[at : at + 65_536]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(column: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in texts(column)], pa.int64())


def embedding(bits: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in its own two bits of a long."""
    low, high = bits.bitwiseAND(F.lit(_EVEN_BITS)), F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_EVEN_BITS))
    # The sum of two bits is (both, either but not both); bit operations cannot overflow.
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _signed(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value)


def _cells(groups: int) -> list[list[int]]:
    """Segment numbers of each group, as even as possible."""
    return [[s for s in range(32) if s * groups // 32 == g] for g in range(groups)]


def links(distinct: DataFrame, column: str = "fp", max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v), u < v: all pairs of the distinct fingerprints in ``column`` at most ``max_bits`` apart."""
    if not 0 <= max_bits <= 31:
        raise ValueError("max_bits must be between 0 and 31")
    layout = _cells(max_bits // 2 + 1)
    embedded = distinct.select(F.col(column).alias("x"), embedding(F.col(column)).alias("e"))
    exact, upward = [], []
    for g, segments in enumerate(layout):
        mask = sum(3 << (2 * s) for s in segments)
        cell = F.col("e").bitwiseAND(_signed(mask))
        exact.append(F.struct(F.lit(g).alias("g"), cell.alias("cell")))
        upward.append(F.struct(F.lit(g).alias("g"), cell.alias("cell"), F.lit(True).alias("same")))
        for s in segments:
            count = F.shiftrightunsigned(F.col("e"), 2 * s).bitwiseAND(F.lit(3))
            # One more in this segment: 0 becomes 1, 1 becomes 2 (binary 10).
            above = cell.bitwiseXOR(F.when(count == 0, _signed(1 << (2 * s))).otherwise(_signed(3 << (2 * s))))
            upward.append(F.when(count < 2, F.struct(F.lit(g).alias("g"), above.alias("cell"), F.lit(False).alias("same"))))
    left = embedded.select("x", F.explode(F.array_compact(F.array(*upward))).alias("c")).select("c.g", "c.cell", "c.same", "x")
    right = embedded.select(F.col("x").alias("y"), F.explode(F.array(*exact)).alias("c")).select("c.g", "c.cell", "y")
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits
    pairs = left.hint("merge").join(right, ["g", "cell"]).where(near & ((F.col("x") < F.col("y")) | ~F.col("same")))
    return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))


def _classes(rows: DataFrame, doc_id: str, key: str, fp: str, max_bits: int) -> DataFrame:
    """(fp, root, component_id, first) of each distinct fingerprint of ``rows``.

    ``root`` tells components apart, ``component_id`` is the smallest id in one (null without any), and
    ``first`` the number of the row that has it: the first of rows with equal ids.
    """
    place = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(key).alias("row"))
    own = stage(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(place).alias("least")), "distinct")
    roots = stage(components(links(own, "fp", max_bits)), "roots")
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("s"))
    return stage(rooted.join(smallest, "root").select("fp", "root", F.col("s.id").alias("component_id"), F.col("s.row").alias("first")), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """All columns of ``docs`` plus ``row_key`` (unique), ``fingerprint`` (long) and ``component_id``.

    Documents with equal fingerprints, empty and null texts among them (fingerprint 0), meet before
    any join: links are sought between distinct fingerprints only. ``component_id`` is the smallest
    id of the documents reachable over links (null if none of them has an id). Repeated rows each
    keep their row. If ``docs`` has columns of these names, the new ones get trailing underscores.
    """
    names = [free_name(docs, n) for n in ("row_key", "fingerprint", "component_id")]
    rows = keyed(docs.withColumn(names[1], fingerprints(F.col(text))), "fingerprints", names[0])
    classes = _classes(rows, doc_id, names[0], names[1], max_bits)
    named = classes.select(F.col("fp").alias(names[1]), F.col("component_id").alias(names[2]))
    # A hot fingerprint meets one row here, and nothing above needs its rows together: the join can be split.
    return rows.join(named, names[1], "left").select(*docs.columns, *names)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Equal ids (repeated rows) are told apart by row number, so exactly one row stays; a row without
    an id stays only where no other row of its component has one. Rows are never joined by fingerprint.
    """
    key, fp = free_name(docs, "row_key"), free_name(docs, "fingerprint")
    rows = keyed(docs.withColumn(fp, fingerprints(F.col(text))), "fingerprints", key)
    keepers = _classes(rows, doc_id, key, fp, max_bits).select(F.col("first").alias(key)).distinct()
    return rows.join(keepers, key, "left_semi").select(*docs.columns)
