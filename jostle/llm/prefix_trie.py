"""The prefix trie of conversations, with totals of every subtree.

Every distinct sequence of first turns is a node. It is named by two sums of 62-bit hashes of (depth, role, text) over its
turns, so one running sum per conversation yields all its nodes and their parents; a third of all turns in one conversation is
ordered in ranges like any hot group. Members are counted by map-side sums. Subtree totals come from tree contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jostle.llm.common import word_array
from jostle.llm.tree_contraction import subtree_totals
from jostle.plans.joins import attach
from jostle.plans.ordering import running
from jostle.plans.staging import discard, stage

#: Conversations of a family share the first turns of the family's first conversation.
FAMILY = 20
#: A conversation takes at most one turn less than this from there.
SHARED = 4
#: Ids in one piece of the text under a node's digest.
PIECE = 4096
_MODULUS = 1 << 62
ROOT = (0, 0)


def _bits(digest: Column, start: int) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def numbered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, a, b, words): the turns of every conversation, numbered from 1, with a digest of role and text.

    Turns are sorted by turn number (null first), ties by the digest; equal rows are turns of their own. A null role or text
    is empty. Rows without a conversation id take no part.
    """
    who, said = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256)
    facts = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.size(word_array(said)).alias("words")
    )
    narrow = facts.select("conv", "turn", _bits(F.col("digest"), 1).alias("a"), _bits(F.col("digest"), 17).alias("b"), "words")
    placed = running(narrow, ["conv"], [F.col("turn").asc_nulls_first(), F.col("a").asc(), F.col("b").asc()], out="place")
    return stage(placed.select("conv", "place", "a", "b", "words"), "turns")


def shared_turns(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string")), F.lit(SHARED))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of all rebuilt conversations, table of all conversations).

    Conversation c begins with the first h = crc32(c) mod 4 turns of conversation c - c % 20 (fewer, where that has fewer or
    is absent), and goes on with its own turns after its first h.
    """
    convs = stage(turns.where("place = 1").select("conv", shared_turns(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base")), "convs")
    heads = stage(turns.where(f"place < {SHARED} and conv % {FAMILY} = 0").withColumnRenamed("conv", "base"), "heads")
    lent = convs.join(heads, "base").where("place <= h").select("conv", F.col("place").alias("depth"), "a", "b", "words")
    lengths = heads.groupBy("base").agg(F.max("place").alias("n"))
    short = convs.join(lengths, "base", "left").select("conv", (F.col("h") - F.coalesce("n", F.lit(0))).alias("lack")).where("lack > 0")
    own = attach(turns.where(F.col("place") > shared_turns(F.col("conv"))), stage(short, "short"), ["conv"], how="left", spread=F.col("place"))
    own = own.select("conv", (F.col("place") - F.coalesce("lack", F.lit(0))).alias("depth"), "a", "b", "words")
    return lent.unionByName(own), convs


def paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, words) for every turn of ``turns`` (conv, depth, a, b, words); depth counts from 1."""
    part = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(k), "depth", "a", "b"), 2)
    weighed = turns.select("conv", "depth", "words", part(1).alias("p"), part(2).alias("q"))
    sums = running(weighed, ["conv"], [F.col("depth").asc()], {s: F.col(c).cast("decimal(38,0)") for s, c in (("sp", "p"), ("sq", "q"))})
    low = lambda c: (c % F.lit(_MODULUS).cast("decimal(38,0)")).cast("long")
    name = lambda p, q: F.struct(low(p).alias("p"), low(q).alias("q"))
    before = [F.col(s) - F.col(c) for s, c in (("sp", "p"), ("sq", "q"))]
    return stage(sums.select("conv", "depth", name(F.col("sp"), F.col("sq")).alias("node"), name(*before).alias("parent"), "words"), "paths")


def id_digests(members: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of the ids ``conv`` of each node, ascending and comma-joined.

    The ids are ordered and joined in pieces; a digest takes the pieces in order as a stream, so no node is held.
    """
    placed = running(members, ["node"], [F.col("conv").asc()], out="position")
    pieces = placed.groupBy("node", F.floor((F.col("position") - 1) / PIECE).alias("piece")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    joined = pieces.select("node", "piece", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    streams = joined.select("node.p", "node.q", "piece", "ids").repartition("p", "q").sortWithinPartitions("p", "q", "piece")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for p, q, ids in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "ids")), strict=True):
                if (p, q) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (p, q), hashlib.sha256()
                state.update(ids.encode())
            yield _rows(done)
        if node is not None:
            yield _rows([(*node, state.hexdigest())])

    found = streams.mapInArrow(hashed, "p long, q long, ends_sha256 string")
    return found.select(F.struct("p", "q").alias("node"), "ends_sha256")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["p", "q", "ends_sha256"]
    )


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv, depth, a, b, words); ``convs`` has every conversation, turnless ones too.

    conv_id is the smallest member, parent_conv_id that of the parent (null at the root); n_convs counts members, n_children
    children, n_leaves the childless nodes of the subtree, saved_tokens its repeated words, and ends_sha256 digests the ids of the
    members that end here. Without conversations there is no root and no row.
    """
    steps = paths(turns)
    root = F.struct(F.lit(ROOT[0]).cast("long").alias("p"), F.lit(ROOT[1]).cast("long").alias("q"))
    inner = steps.groupBy("node").agg(
        F.min("conv").alias("conv_id"), F.min("depth").cast("long").alias("depth"), F.struct(F.min("parent.p").alias("p"), F.min("parent.q").alias("q")).alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.max("words").cast("long").alias("words")
    )
    top = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root.alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("struct<p:bigint,q:bigint>").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words")
    )
    nodes = inner.unionByName(top)
    counts = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(counts, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    last = steps.groupBy("conv").agg(F.struct(F.max_by("node.p", "depth").alias("p"), F.max_by("node.q", "depth").alias("q")).alias("node"))
    turnless = convs.select("conv").join(last, "conv", "left_anti").withColumn("node", root)
    ends = stage(id_digests(last.unionByName(turnless.select("conv", "node"))), "ends")

    weights = nodes.select(
        "node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    )
    totals = subtree_totals(weights, ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("node.p").alias("pp"), F.col("node.q").alias("pq"), F.col("conv_id").alias("parent_conv_id"))
    # Of a parent with very many children each salted copy serves a share.
    flat = nodes.select("*", F.col("parent.p").alias("pp"), F.col("parent.q").alias("pq"))
    named = attach(flat, parents, ["pp", "pq"], how="left", spread=F.col("node"), salts=8)
    whole = named.join(totals, "node").join(ends, "node", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations of ``rows``; see :func:`numbered_turns`, :func:`rebuilt` and :func:`trie`."""
    turns = numbered_turns(rows, conv_id, turn, role, text)
    longer, convs = rebuilt(turns)
    found = stage(trie(longer, convs), "trie")
    discard(turns)
    return found
