"""Subtree totals of a forest of any shape by parallel tree contraction.

A round *rakes* all leaves (their totals are known and go to their parents) and *compresses* unary chains: a node
with one child is spliced out if its own coin shows heads and its parent's tails, so no two neighbours go at once;
its parent takes over its amounts, its child hangs on the parent. Bushy trees shrink by raking, paths by a constant share
of their nodes, so the number of rounds is logarithmic in the number of nodes. Then the rounds are gone through
backwards: the total of a spliced node is what it held plus the total of the child it had.

Each half of a round is one grouped sum of messages, so a node with any number of children costs one row a task.
Each round is written and reread. Coins are hashes of the node and the round, so a lost task repeats them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.plans.staging import discard, stage


def _heads(parts: list[str], role: str, number: int) -> Column:
    return F.pmod(F.xxhash64(*[f"{role}_{p}" for p in parts], F.lit(number)), F.lit(2)) == 0


class _Messages:
    """What nodes send each other: plain columns, so that sums and maxima need no sorting.

    A node is named by one column for each of its ``parts``. Of several kids any mixture may arrive; it is read only where one kid is.
    """

    def __init__(self, parts: dict[str, str], values: Sequence[str]):
        self.parts, self.values = parts, list(values)

    def name(self, role: str) -> list[Column]:
        return [F.col(f"{role}_{p}") for p in self.parts]

    def message(self, to: str, held: bool = False, carry: bool = False, alive: bool = False, **roles: str) -> Column:
        """To the node named by role ``to``; ``roles`` say which of the sender's names travel as parent, hang or kid."""
        fields = [c.alias(f"node_{p}") for p, c in zip(self.parts, self.name(to), strict=True)]
        for role in ("parent", "hang", "kid"):
            source = roles.get(role)
            fields += [(F.col(f"{source}_{p}") if source else F.lit(None).cast(kind)).alias(f"{role}_{p}") for p, kind in self.parts.items()]
        flag = lambda on: F.lit(1 if on else 0).cast("long")
        fields += [flag(held).alias("held"), flag(alive).alias("alive")]
        fields += [(F.col(c) if held else F.lit(0).cast("long")).alias(c) for c in ("kids", "gone")]
        fields += [(F.col(v) if carry else F.lit(0).cast("decimal(38,0)")).alias(v) for v in self.values]
        return F.struct(*fields)

    def delivered(self, nodes: DataFrame, sent: list[Column]) -> DataFrame:
        """One row for each node that still holds itself, with what it was sent."""
        rows = nodes.select(F.explode(F.filter(F.array(*sent), lambda m: m.isNotNull())).alias("m")).select("m.*")
        seen = [F.max(f"{role}_{p}").alias(f"{role}_{p}") for role in ("parent", "hang", "kid") for p in self.parts]
        met = rows.groupBy(*[f"node_{p}" for p in self.parts]).agg(
            *seen, F.sum("held").alias("held"), F.sum("alive").alias("alive"), F.max("kids").alias("kids"), F.max("gone").alias("gone"),
            *[F.sum(v).cast("decimal(38,0)").alias(v) for v in self.values],
        )
        return met.where("held > 0")


def _round(state: DataFrame, m: _Messages, number: int) -> DataFrame:
    """The nodes that are no leaf, one round later; ``gone`` marks those that were spliced out."""
    parts = list(m.parts)
    leaf, has_parent = F.col("kids") == 0, F.col(f"parent_{parts[0]}").isNotNull()
    raked = m.delivered(state, [
        F.when(~leaf, m.message("node", held=True, carry=True, parent="parent")),
        F.when(leaf & has_parent, m.message("parent", carry=True)), F.when(~leaf & has_parent, m.message("parent", alive=True, kid="node")),
    ]).withColumn("kids", F.col("alive"))
    spliced = F.coalesce((F.col("kids") == 1) & has_parent & _heads(parts, "node", number) & ~_heads(parts, "parent", number), F.lit(False))
    marked = raked.withColumn("gone", spliced.cast("long"))
    gone = F.col("gone") == 1
    out = m.delivered(marked, [
        m.message("node", held=True, carry=True, parent="parent", kid="kid"), F.when(gone, m.message("parent", carry=True)), F.when(gone, m.message("kid", hang="parent")),
    ])
    moved = [F.coalesce(f"hang_{p}", f"parent_{p}").alias(f"parent_{p}") for p in parts]
    return out.select(*m.name("node"), *moved, *m.name("kid"), "kids", "gone", *m.values)


def subtree_totals(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """(node, <values>): for every node the sums of ``values`` over its subtree, itself included.

    ``nodes`` are (node, parent, <integer values>); ``node`` is a unique key, one value or a struct of values without nulls, and the
    parent of a root is null. Every other parent must be a node. A null amount counts as zero; no nodes give no rows.
    """
    kind = nodes.schema["node"].dataType
    fields = {f.name: f.dataType.simpleString() for f in kind} if isinstance(kind, T.StructType) else {"id": kind.simpleString()}
    m, of = _Messages(fields, values), (lambda role, p: F.col(f"{role}.{p}" if isinstance(kind, T.StructType) else role))
    amounts = [F.coalesce(F.col(v), F.lit(0)).cast("decimal(38,0)").alias(v) for v in values]
    flat = nodes.select(*[of(role, p).alias(f"{role}_{p}") for role in ("node", "parent") for p in fields], *amounts)
    key, up = [f"node_{p}" for p in fields], [f"parent_{p}" for p in fields]
    counted = flat.where(F.col(up[0]).isNotNull()).groupBy(*[F.col(u).alias(k) for u, k in zip(up, key, strict=True)]).agg(F.count(F.lit(1)).alias("kids"))
    first = flat.join(counted, key, "left")
    none = [F.lit(None).cast(t).alias(f"kid_{p}") for p, t in fields.items()]
    states = [stage(first.select(*key, *up, *none, F.coalesce("kids", F.lit(0).cast("long")).alias("kids"), F.lit(0).cast("long").alias("gone"), *values), "contract")]
    left = states[0].count()
    while left:
        states.append(stage(_round(states[-1].where("gone = 0"), m, len(states)), "contract"))
        now = states[-1].where("gone = 0").count()
        if now == left:
            # Every round rakes the leaves of what is left; nothing raked means a cycle.
            raise ValueError("the parents of the nodes form a cycle")
        left = now

    # Backwards: what a round left is known, so are the leaves before it, and the spliced nodes follow from their children.
    totals = stage(states[-1].where("false").select(*key, *values), "totals")
    for later, earlier in zip([None, *states[:0:-1]], states[::-1], strict=True):
        known = earlier.where("gone = 0 and kids = 0").select(*key, *values).unionByName(totals)
        if later is not None:
            held = later.where("gone = 1").select(*key, *m.name("kid"), *[F.col(v).alias(f"own_{v}") for v in values])
            below = totals.select(*[F.col(f"node_{p}").alias(f"kid_{p}") for p in fields], *values)
            opened = held.join(below, [f"kid_{p}" for p in fields])
            known = known.unionByName(opened.select(*key, *[(F.col(f"own_{v}") + F.col(v)).cast("decimal(38,0)").alias(v) for v in values]))
        before, totals = totals, stage(known, "totals")
        discard(before)
    for state in states:
        discard(state)
    node = F.struct(*[F.col(f"node_{p}").alias(p) for p in fields]) if isinstance(kind, T.StructType) else F.col("node_id")
    return totals.select(node.alias("node"), *[F.col(v).cast("long").alias(v) for v in values])
