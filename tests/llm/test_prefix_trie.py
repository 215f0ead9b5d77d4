"""Tree contraction and the prefix trie against plain recomputation."""

import hashlib
import random
import zlib

import pytest

from jostle.llm import prefix_trie as P
from jostle.llm.tree_contraction import subtree_totals
from jostle.plans import ordering

NODES = "node long, parent long, a long, b long"


def totals_of(spark, nodes):
    out = subtree_totals(spark.createDataFrame(nodes, NODES), ["a", "b"])
    return {r["node"]: (r["a"], r["b"]) for r in out.collect()}


def plain_totals(nodes):
    parent = {n: p for n, p, _, _ in nodes}
    found = {n: [0, 0] for n in parent}
    for n, _, a, b in nodes:
        up = n
        while up is not None:
            found[up][0] += a or 0
            found[up][1] += b or 0
            up = parent[up]
    return {n: tuple(v) for n, v in found.items()}


def test_forests_of_all_shapes(spark):
    r = random.Random(3)
    tree = [(0, None, 1, 5)] + [(k, r.randrange(max(0, k - 4), k), r.randrange(9), r.randrange(9)) for k in range(1, 90)]  # mostly chains
    star = [(1000, None, 1, 1)] + [(1001 + k, 1000, 1, k) for k in range(60)]
    path = [(2000 + k, 2000 + k - 1 if k else None, 1, None if k % 5 == 0 else k) for k in range(70)]
    comb = [(3000 + k, None if not k else 3000 + (k - 1 if k % 2 else max(0, k - 2)), k, 1) for k in range(40)]
    nodes = tree + star + path + comb + [(9000, None, 4, 4)]
    r.shuffle(nodes)
    assert totals_of(spark, nodes) == plain_totals(nodes)


def test_no_nodes_and_cycles(spark):
    assert totals_of(spark, []) == {}
    with pytest.raises(ValueError, match="cycle"):
        totals_of(spark, [(1, 2, 1, 1), (2, 3, 1, 1), (3, 1, 1, 1), (4, None, 1, 1)])


SCHEMA = "conv_id long, turn long, role string, text string, node string"


def plain_trie(rows):
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0))] for c, rs in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        kids = [n for n in nodes if len(n) == len(node) + 1 and n[:-1] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in nodes)]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].split()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(spark, rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in P.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def conversations():
    r, rows = random.Random(5), []
    for c in list(range(0, 45)) + [61, 79, 100, 101]:  # 60 and 80 are absent
        rows += [(c, k, r.choice(["user", "assistant", None]), r.choice(["hi  there", "yes", "", None, "a b c"]), "x") for k in range(r.choice([1, 1, 2, 3, 5]))]
    rows += [(c, k, "user", "the same", "x") for c in range(120, 135) for k in range(5)]  # copies
    return rows + [(3, None, "system", "null turn", "x"), (None, 0, "user", "nobody", "x"), (41, 0, "user", "yes", "x"), (41, 0, "user", "yes", "x")]


def test_trie_equals_plain_recomputation(spark, monkeypatch):
    rows = conversations()
    # Ties of turn number with other content are ordered by a digest, so only equal rows tie here.
    rows = [r for r in rows if r[0] != 41] + [(41, 0, "user", "yes", "x")] * 2
    assert trie_of(spark, rows) == plain_trie(rows)
    monkeypatch.setattr(ordering, "GROUP_ROWS", 8)  # every larger conversation and node is ordered in ranges
    monkeypatch.setattr(P, "PIECE", 2)
    assert trie_of(spark, rows) == plain_trie(rows)


def test_turnless_conversations_and_empty_tables(spark):
    assert trie_of(spark, []) == []
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 2)  # its family's first is absent
    rows = [(lone, 0, "user", "gone", "x")]
    assert trie_of(spark, rows) == plain_trie(rows) and len(plain_trie(rows)) == 1
