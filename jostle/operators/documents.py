"""Nested documents as rows, values found in them by path, and printed values checked against them.

A document (structs, arrays and maps of any depth) becomes one row for each of its nodes: its *shape*, which is its path
with every list position written ``[*]``, the positions, and the value. A path such as ``a.b[3].c[k=v,m=w].d`` is compiled
by column expressions to a shape with the positions that are fixed, and to the conditions of its selectors. So any number of
paths meet any number of nodes in joins by shape, positions and value, and nothing is looked up node by node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.operators.reconcile import NUMERIC
from jostle.plans.ordering import running
from jostle.plans.staging import stage, staged

NODE = "shape string, positions array<bigint>, kind string, text string, number double"


# ---------------------------------------------------------------- documents as rows


def _node(shape: Column, positions: Column, kind: Column | str, value: Column | None = None, number: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.lit(None).cast("string") if value is None else value.cast("string")
    number = F.lit(None).cast("double") if number is None else number.cast("double")
    return F.struct(shape.alias("shape"), positions.alias("positions"), kind.alias("kind"), text.alias("text"), number.alias("number"))


def _nodes(value: Column, kind: T.DataType, shape: Column, positions: Column) -> Column:
    """Array of the nodes of ``value`` and of all below it."""
    missing = F.array(_node(shape, positions, "null"))
    if isinstance(kind, T.StructType):
        parts = [F.array(_node(shape, positions, "object"))]
        parts += [_nodes(value[f.name], f.dataType, F.concat(shape, F.lit(f".{f.name}")), positions) for f in kind.fields]
        found = F.concat(*parts)
    elif isinstance(kind, T.ArrayType):
        each = lambda v, i: _nodes(v, kind.elementType, F.concat(shape, F.lit("[*]")), F.concat(positions, F.array(i.cast("long"))))
        found = F.concat(F.array(_node(shape, positions, "list", number=F.size(value))), F.flatten(F.transform(value, each)))
    elif isinstance(kind, T.MapType):
        each = lambda e: _nodes(e["value"], kind.valueType, F.concat(shape, F.lit("."), e["key"].cast("string")), positions)
        found = F.concat(F.array(_node(shape, positions, "object")), F.flatten(F.transform(F.map_entries(value), each)))
    else:
        name = kind.simpleString()
        numeric = name in NUMERIC or name.startswith("decimal")
        found = F.array(_node(shape, positions, "number" if numeric else name, value, value if numeric else None))
    return F.when(value.isNull(), missing).otherwise(found)


def document_nodes(df: DataFrame, root: str, order: Sequence[str] | None = None, **how) -> DataFrame:
    """The nodes of the list ``root`` whose items are the rows of ``df``, as rows (shape, positions, kind, text, number).

    Items are numbered from 0 in ``order`` (columns that are unique together; distributed, however many rows there are). Without ``order``
    ``df`` is one document and its columns are the keys of the object ``root``. Names that hold ``.`` or a bracket cannot
    be reached by a path.
    """
    top = F.lit(f".{root}" if root else "")
    columns = F.struct(*[F.col(c) for c in df.columns])
    if order is None:
        return df.select(F.explode(_nodes(columns, df.schema, top, F.array().cast("array<bigint>"))).alias("n")).select("n.*")
    placed = running(df, [], [F.col(c).asc() for c in order], out="__place", **how)
    items = placed.select(F.explode(_nodes(columns, df.schema, F.concat(top, F.lit("[*]")), F.array(F.col("__place").cast("long") - 1))).alias("n"))
    itself = placed.agg(F.count(F.lit(1)).alias("rows")).select(_node(top, F.array().cast("array<bigint>"), "list", number=F.col("rows")).alias("n"))
    return items.unionByName(itself).select("n.*")


# ---------------------------------------------------------------- paths

_TOKEN = r"(\.?[^.\[\]]+|\[[^\]]*\])"


def compile_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, valid, shape, fixed, selectors): what each distinct path asks for.

    ``fixed`` has one entry for each bracket: the position it names, or NULL for a selector. ``selectors`` are (level, shape, tests):
    the number of brackets up to the selector, the shape of its list's items, and its ``key=value`` tests. Dots may stand inside brackets.
    A path that the language does not cover is not valid.
    """
    tokens = F.regexp_extract_all(F.col("path"), F.lit(_TOKEN), F.lit(1))
    cut = paths.select(F.col(path).alias("path")).where("path is not null").distinct().withColumn("tokens", tokens)
    bracket = lambda t: F.startswith(t, F.lit("["))
    shaped = F.transform("tokens", lambda t, i: F.when(bracket(t), "[*]").otherwise(F.concat(F.lit("."), F.ltrim(t, F.lit(".")))))
    inner = F.transform(F.filter("tokens", bracket), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    cut = cut.withColumns({"shaped": shaped, "inner": inner})
    test = lambda c: F.struct(F.substring_index(c, "=", 1).alias("key"), F.substring(c, F.instr(c, "=") + 1, F.length(c)).alias("want"))
    number = lambda text: text.rlike("^[0-9]{1,18}$")
    at = F.filter(F.sequence(F.lit(1), F.size("tokens")), lambda i: bracket(F.get("tokens", i - 1)) & ~number(F.substring(F.get("tokens", i - 1), F.lit(2), F.length(F.get("tokens", i - 1)) - 2)))
    selectors = F.transform("at", lambda i: F.struct(
        F.size(F.filter(F.slice("tokens", F.lit(1), i), bracket)).alias("level"), F.array_join(F.slice("shaped", F.lit(1), i), "").alias("shape"),
        F.transform(F.split(F.substring(F.get("tokens", i - 1), F.lit(2), F.length(F.get("tokens", i - 1)) - 2), ","), test).alias("tests"),
    ))
    cut = cut.withColumn("at", F.when(F.size("tokens") > 0, at).otherwise(F.array().cast("array<int>")))
    named = F.forall("selectors", lambda s: F.forall(s["tests"], lambda t: t["key"] != ""))
    well = F.forall("inner", lambda b: number(b) | F.forall(F.split(b, ","), lambda c: F.instr(c, "=") > 1))
    whole = (F.size("tokens") > 0) & (F.array_join("tokens", "") == F.col("path")) & ~F.startswith(F.col("path"), F.lit("."))
    return cut.withColumn("selectors", selectors).select(
        "path", (whole & named & well).alias("valid"), F.array_join("shaped", "").alias("shape"),
        F.transform("inner", lambda b: F.when(number(b), b).cast("long")).alias("fixed"), "selectors",
    )


# What a node answers to: a condition asks for its value by equality, booleans without case.
_ANSWER = {"null": lambda text: F.lit("null"), "boolean": lambda text: F.concat(F.lit("boolean:"), F.lower(text))}


def _answer(kind: Column, text: Column) -> Column:
    """The key under which a node is found by conditions; NULL for objects and lists."""
    return F.when(kind == "null", _ANSWER["null"](text)).when(kind == "boolean", _ANSWER["boolean"](text)).otherwise(F.concat(F.lit("is:"), text))


def _asked_for(want: Column) -> Column:
    """The keys that satisfy a condition; a node has one of them at most."""
    keys = F.array(F.concat(F.lit("is:"), want), _ANSWER["boolean"](want), F.when(F.lower(want).isin("null", "none"), _ANSWER["null"](want)))
    return F.filter(keys, lambda k: k.isNotNull())


def _parent(positions: Column) -> Column:
    return F.slice(positions, F.lit(1), F.size(positions) - 1)


def _satisfied(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(list, parent, tests, at): the items of a list that satisfy all tests of a selector.

    ``asked`` are distinct (list, parent, tests), ``answers`` distinct (shape, positions, key). The items come from the test that
    fewest of them pass and are held to the others, so a common value costs nothing beside a rare one.
    """
    selector = ["list", "parent", "tests"]
    tests = asked.select(*selector, F.posexplode("tests").alias("test", "t")).select(
        *selector, "test", F.concat("list", F.lit("."), "t.key").alias("shape"), F.explode(_asked_for(F.col("t.want"))).alias("key")
    )
    single, several = tests.where(F.size("tests") == 1), tests.where(F.size("tests") > 1)
    placed = answers.withColumn("parent", _parent(F.col("positions"))).withColumnRenamed("positions", "at")
    counts = placed.groupBy("shape", "parent", "key").agg(F.count(F.lit(1)).alias("n"))
    sizes = several.join(counts, ["shape", "parent", "key"], "left").groupBy(*selector, "test").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rarest = sizes.groupBy(*selector).agg(F.min(F.struct("n", "test")).alias("r")).select(*selector, F.col("r.test").alias("test"))
    first = single.unionByName(several.join(rarest, [*selector, "test"], "left_semi"))
    items = first.join(placed, ["shape", "parent", "key"]).select(*selector, "at").distinct()
    held = items.where(F.size("tests") > 1).select(*selector, "at", F.posexplode("tests").alias("test", "t")).select(
        *selector, "at", "test", F.concat("list", F.lit("."), "t.key").alias("shape"), F.explode(_asked_for(F.col("t.want"))).alias("key")
    )
    passed = held.join(answers.withColumnRenamed("positions", "at"), ["shape", "at", "key"]).groupBy(*selector, "at").agg(F.count_distinct("test").alias("met"))
    return items.where(F.size("tests") == 1).unionByName(passed.where(F.col("met") == F.size("tests")).select(*selector, "at"))


def resolve_paths(nodes: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, status, matches, position, kind, text, number) for every distinct path of ``paths``.

    A path that leads to one value has status ``FOUND`` and that value with position NULL; a list is followed by its items, one row each
    with their position. ``MISSING`` is a path that leads nowhere, ``AMBIGUOUS`` one with a selector that several items satisfy (or that
    several documents hold), ``INVALID`` one outside the language; ``matches`` counts the items or values. A selector must single out one
    item before the next one is looked at. Booleans are compared without case, and ``null`` asks for a null.

    Nodes are met by shape, positions and value, never by shape alone: a path costs what it finds, not the length of the list.
    """
    asked = staged(compile_paths(paths, path), "paths")
    valid, zero = asked.where("valid"), F.lit(0)
    tested = F.flatten(F.transform("selectors", lambda s: F.transform(s["tests"], lambda t: F.concat(s["shape"], F.lit("."), t["key"]))))
    shapes = valid.select(F.explode(F.concat(tested, F.array(F.col("shape"), F.concat("shape", F.lit("[*]"))))).alias("shape")).distinct()
    held = stage(nodes.join(shapes, "shape", "left_semi"), "nodes")
    answers = held.select("shape", "positions", _answer(F.col("kind"), F.col("text")).alias("key")).where("key is not null").distinct()

    # Selector by selector: the items that satisfy it below what the ones before it singled out.
    chosen = asked.select("path", F.when(F.col("valid"), "FOUND").otherwise("INVALID").alias("status"), zero.cast("long").alias("matches"),
                          F.array().cast("array<bigint>").alias("prefix"), "shape", "fixed", "selectors")
    # Positions up to bracket ``level``: what was singled out, then the fixed ones behind it.
    upto = lambda level: F.concat("prefix", F.slice("fixed", F.size("prefix") + 1, F.greatest(level - F.size("prefix"), F.lit(0))))
    deepest = asked.agg(F.max(F.size("selectors"))).first()[0] or 0  # brackets in one path
    for k in range(deepest):
        selector = F.get("selectors", F.lit(k))
        here = chosen.withColumns({"list": selector["shape"], "parent": upto(selector["level"] - 1), "tests": selector["tests"]})
        open_ = (F.col("status") == "FOUND") & F.col("tests").isNotNull()
        wanted = here.where(open_).select("list", "parent", "tests").distinct()
        found = _satisfied(wanted, answers).groupBy("list", "parent", "tests").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
        joined = here.join(found, ["list", "parent", "tests"], "left")
        n = F.coalesce("n", F.lit(0))
        chosen = joined.select(
            "path", F.when(open_ & (n == 0), "MISSING").when(open_ & (n > 1), "AMBIGUOUS").otherwise(F.col("status")).alias("status"),
            F.when(open_, n).otherwise(F.col("matches")).alias("matches"), F.when(open_ & (n == 1), F.col("at")).otherwise(F.col("prefix")).alias("prefix"),
            "shape", "fixed", "selectors",
        )
    chosen = staged(chosen, "chosen")
    ends = chosen.where("status = 'FOUND'").select("path", "shape", upto(F.size("fixed")).alias("place"))
    value = ["kind", "text", "number"]
    reached = ends.join(held.withColumnRenamed("positions", "place"), ["shape", "place"]).select(
        "path", F.lit("value").alias("role"), F.lit(None).cast("long").alias("position"), *value
    ).unionByName(
        ends.withColumn("shape", F.concat("shape", F.lit("[*]"))).join(held.where("size(positions) > 0").withColumn("place", _parent(F.col("positions"))), ["shape", "place"])
        .select("path", F.lit("item").alias("role"), F.element_at("positions", -1).alias("position"), *value)
    )
    counts = reached.where("role = 'value'").groupBy("path").agg(F.count(F.lit(1)).alias("values"), F.max("kind").alias("reached_kind"))
    judged = chosen.join(counts, "path", "left").select(
        "path", F.when((F.col("status") == "FOUND") & F.col("values").isNull(), "MISSING").when((F.col("status") == "FOUND") & (F.col("values") > 1), "AMBIGUOUS")
        .otherwise(F.col("status")).alias("status"),
        F.when(F.col("status") == "FOUND", F.coalesce("values", F.lit(0))).otherwise(F.col("matches")).alias("matches"), "reached_kind",
    )
    seen = reached.select("path", "position", "kind", "text", "number")
    single = judged.where("status = 'FOUND'").join(seen, "path").where("position is null or reached_kind = 'list'").drop("reached_kind")
    others = judged.where("status <> 'FOUND'").select(
        "path", "status", "matches", F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("number")
    )
    return single.unionByName(others)


# ---------------------------------------------------------------- printed values


def _half_unit(decimals: Column) -> Column:
    return 0.5 * F.pow(F.lit(10.0), -F.coalesce(decimals, F.lit(0)).cast("double")) + 1e-9


def list_findings(resolved: DataFrame, cells: DataFrame) -> DataFrame:
    """R3, lists: (id, position, printed, computed, difference, reason) for every item of a printed list that is off.

    Both lists meet by (path, position), so an item that only one of them has is a finding (``missing`` or ``unexpected``), not an
    error. Items lie within half a unit of the last printed digit; what is no number is ``value``.
    """
    scale, decimals = F.coalesce("scale", F.lit(1.0)), F.col("decimals")
    lists = cells.where("items is not null")
    printed = lists.select("id", "path", scale.alias("scale"), decimals.alias("decimals"), F.posexplode("items").alias("position", "printed"))
    printed = printed.withColumn("position", F.col("position").cast("long"))
    found = lists.select("id", "path").join(resolved.where("position is not null"), "path").select("id", "position", "number", "kind")
    met = printed.withColumn("left", F.lit(True)).join(found.withColumn("right", F.lit(True)), ["id", "position"], "full_outer")
    computed = F.col("number") * F.col("scale")
    off = F.abs(computed - F.col("printed"))
    reason = F.when(F.col("right").isNull(), "missing").when(F.col("left").isNull(), "unexpected").when(computed.isNull() | F.isnan(computed) | F.col("printed").isNull(), "value").when(
        off > _half_unit(F.col("decimals")), "number"
    )
    return met.select("id", "position", "printed", F.coalesce(computed, F.col("number")).alias("computed"), off.alias("difference"), reason.alias("reason")).where("reason is not null")


def check_cells(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, path, status, reason, computed, difference, tolerance) for every printed cell.

    ``cells`` are (id, path, kind, printed, items, decimals, scale). Numbers without decimals must be equal as integers, with decimals they
    lie within half a unit of the last printed digit; strings are the same; booleans too, without case; ``items`` (an array, else
    NULL) is a printed list, judged item by item. ``computed`` and ``difference`` (computed minus printed; of a list the largest)
    are given where there is one. A path that leads nowhere, to several places or to no such value fails, and the reason says so.
    """
    resolved = staged(resolve_paths(nodes, cells), "resolved")
    heads = resolved.where("position is null").select("path", F.col("status").alias("found"), "kind", "text", "number")
    joined = cells.withColumnRenamed("kind", "asked").join(heads, "path", "left")
    findings = list_findings(resolved, cells).groupBy("id").agg(
        F.count(F.lit(1)).alias("off"), F.max("difference").alias("worst"), F.count_if(F.col("reason").isin("missing", "unexpected")).alias("lengths")
    )
    joined = joined.join(findings, "id", "left")
    is_list = F.col("items").isNotNull()
    computed = F.col("number") * F.coalesce("scale", F.lit(1.0))
    printed = F.expr("try_cast(printed as double)")
    decimals = F.coalesce("decimals", F.lit(0))
    exact = (F.round(computed) == printed) & (F.abs(computed - F.round(computed)) < 1e-9)
    near = F.abs(computed - printed) <= _half_unit(decimals)
    plain = ~is_list & ~F.col("asked").isin("string", "bool")
    ok = (
        F.when(is_list, (F.col("kind") == "list") & F.col("off").isNull())
        .when(F.col("asked") == "bool", F.lower("text") == F.lower("printed"))
        .when(F.col("asked") == "string", F.col("text") == F.col("printed"))
        .when(decimals > 0, near).otherwise(exact)
    )
    ok = F.coalesce(ok, F.lit(False))
    reason = (
        F.when(F.coalesce("found", F.lit("MISSING")) != "FOUND", F.lower(F.coalesce("found", F.lit("MISSING"))))
        .when(is_list & (F.col("kind") != "list"), "kind").when(plain & (F.col("kind") != "number"), "kind")
        .when(is_list & (F.col("lengths") > 0), "length").when(~ok, "value")
    )
    shown = F.when(plain, computed.cast("string")).when(~is_list, F.col("text"))
    return joined.select(
        "id", "path", F.when(reason.isNull(), "PASS").otherwise("FAIL").alias("status"), reason.alias("reason"), shown.alias("computed"),
        F.when(plain, computed - printed).when(is_list, F.col("worst")).alias("difference"),
        F.when(is_list | (plain & (decimals > 0)), _half_unit(decimals)).when(plain, F.lit(0.0)).alias("tolerance"),
    )
