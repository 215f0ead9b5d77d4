"""Rank statistics and resampling inference with sources as the unit.

All draws come from the counter RNG keyed by (seed, repetition, stratum, slot), so a result does not
depend on partitioning. Work is R x sources keys, hashed in place as arrays and summed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jostle.functions import draws
from jostle.functions.ints import div
from jostle.functions.rng import INDICES, SIGNS, digest, draw, index_of, sign_bits
from jostle.plans.joins import attach
from jostle.plans.ordering import GROUP_ROWS, largest_group, midranks, percentiles, running
from jostle.plans.staging import fan_out, stage, staged

# Fixed-point scale of contrasts in exact comparisons, split in two summable halves.
SCALE, HALF = 1e12, 1_000_000


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def average_rank(rows: DataFrame, keys: Sequence[str], value: str, out: str = "rank", **how) -> DataFrame:
    """1-based mid-rank of every row within ``keys``; a row without a value keeps its place with rank
    NULL and does not count for others."""
    ranks = stage(midranks(rows.where(F.col(value).isNotNull()), keys, value, out=out, **how), "midranks")
    return attach(rows, ranks, [*keys, value], how="left")


def margin_rank(rows: DataFrame, keys: Sequence[str], value: str, identity: str = "source_id", **how) -> DataFrame:
    """Total order by (value, id), rank 1 lowest."""
    return running(rows, keys, [F.col(value).asc(), F.col(identity).asc()], out="rank", **how)


def cumulative_share(rows: DataFrame, value: str, identity: str = "source_id", **how) -> DataFrame:
    """Positive rows by (value desc, id) with rank and running share of the total."""
    positive = stage(rows.where(F.col(value) > 0).select(identity, value), "positive")
    order = [F.col(value).desc(), F.col(identity).asc()]
    placed = running(positive, [], order, {"running": F.col(value), "rank": F.lit(1).cast("long")}, **how)
    total = positive.agg(F.sum(value).alias("total"))
    return placed.join(F.broadcast(total)).withColumn("share", F.col("running") / F.col("total")).drop("running", "total")


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str, **how) -> DataFrame:
    """Rank correlation per ``keys``; NULL below three rows or for a constant side."""
    return spearman_many(rows, keys, x, {"rho": y}, **how)


def spearman_many(rows: DataFrame, keys: Sequence[str], x: str, targets: dict[str, str], group_rows: int | None = None, **how) -> DataFrame:
    """Rank correlations of ``x`` with several columns per ``keys`` as columns named in ``targets``.

    While the largest group fits one task, all ranks come from windows on one partitioning: the rows
    are shuffled once, however many targets there are. Larger groups go through
    :func:`_spearman_of_counts`. Rows with an undefined value in any used column are left out first,
    so both ways see the same rows.
    """
    keys = list(keys)
    used = list(dict.fromkeys([x, *targets.values()]))
    complete = F.lit(True)
    for c in used:
        complete = complete & _finite(c)
    staged = stage(rows.select(*keys, *used).where(complete), "ranked")
    if largest_group(staged, keys)[0] > (GROUP_ROWS if group_rows is None else group_rows):
        parts = [
            _spearman_of_counts(staged, keys, x, y, group_rows=group_rows, **how).withColumnRenamed("rho", name)
            for name, y in targets.items()
        ]
        out = parts[0]
        for name, part in zip(list(targets)[1:], parts[1:]):
            out = out.join(part.select(*keys, name), keys) if keys else out.join(F.broadcast(part.select(name)))
        return out
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    ranks = {}
    for c in dict.fromkeys([x, *targets.values()]):
        ordered = group.orderBy(c)
        upto = F.count(F.lit(1)).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        ranks[f"__r_{c}"] = (F.rank().over(ordered) + upto) / F.lit(2.0)
    centered = staged.withColumns(ranks).withColumn("__mean", (F.count(F.lit(1)).over(group) + 1) / F.lit(2.0))
    d = {c: F.col(f"__r_{c}") - F.col("__mean") for c in dict.fromkeys([x, *targets.values()])}
    sums = centered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(v * v).alias(f"__xx_{c}") for c, v in d.items()],
        *[F.sum(d[x] * d[y]).alias(f"__xy_{name}") for name, y in targets.items()],
    )
    return sums.select(*keys, "n", *[
        _rho(F.col(f"__xy_{name}"), F.col(f"__xx_{x}"), F.col(f"__xx_{y}")).alias(name) for name, y in targets.items()
    ])


def _rho(xy: Column, xx: Column, yy: Column) -> Column:
    defined = (F.col("n") >= 3) & (xx > 0) & (yy > 0)
    return F.when(defined, F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)))


def _spearman_of_counts(rows: DataFrame, keys: list[str], x: str, y: str, **how) -> DataFrame:
    """Equal (x, y) pairs are counted first, and each side is ranked from its distinct values, so ties
    and hot groups shrink before anything is ordered, and no group is held in one task."""
    pairs = stage(rows.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("__pairs")), "pairs")
    rx = stage(midranks(pairs, keys, x, "__pairs", out="__rx", **how), "rx")
    ry = stage(midranks(pairs, keys, y, "__pairs", out="__ry", **how), "ry")
    totals = pairs.groupBy(*keys).agg(F.sum("__pairs").alias("__n"))
    ranked = attach(attach(pairs, rx, [*keys, x]), ry, [*keys, y])
    if keys:
        ranked = attach(ranked, stage(totals, "totals"), keys, spread=F.struct(x, y))
    else:
        ranked = ranked.join(F.broadcast(totals))  # one row
    mean = (F.col("__n") + 1) / F.lit(2.0)
    dx, dy, w = F.col("__rx") - mean, F.col("__ry") - mean, F.col("__pairs")
    sums = ranked.groupBy(*keys).agg(
        F.max("__n").alias("n"), F.sum(w * dx * dy).alias("__xy"), F.sum(w * dx * dx).alias("__xx"), F.sum(w * dy * dy).alias("__yy")
    )
    return sums.select(*keys, "n", _rho(F.col("__xy"), F.col("__xx"), F.col("__yy")).alias("rho"))


def within_source_spearman(
    moves: DataFrame, subset: str, response: str, targets: dict[str, Column], **how
) -> DataFrame:
    """Per subset and target the median over sources of the within-source rank correlation.

    A source with fewer than two rows in a subset fails the job.
    """
    columns = {n: f"__y_{n}" for n in targets}
    rows = moves.select(
        "source_id", subset, F.col(response).cast("double").alias("__x"), *[c.cast("double").alias(columns[n]) for n, c in targets.items()]
    )
    wide = spearman_many(rows, [subset, "source_id"], "__x", columns, **how)
    lines = F.array(*[F.struct(F.lit(n).alias("target"), F.col(n).alias("rho")) for n in targets])
    per_source = stage(
        wide.select(subset, "source_id", "n", F.explode(lines).alias("l")).select(subset, "source_id", "n", "l.target", "l.rho"), "rho"
    )
    checked = per_source.withColumn(
        "rho", F.when(F.col("n") < 2, F.raise_error(F.lit("fewer than two rows")).cast("double")).otherwise(F.col("rho"))
    )
    medians = percentiles(checked, [subset, "target"], "rho", [("median_rho", 0.5)], **how)
    counts = checked.groupBy(subset, "target").agg(F.count(F.lit(1)).alias("sources"))
    return counts.join(medians, [subset, "target"], "left")


def _index(values: DataFrame, keys: Sequence[str], identity: str, **how) -> DataFrame:
    """Rows with ``slot`` 0..n-1 in id order and ``n`` within ``keys``."""
    placed = stage(running(values, keys, [F.col(identity).asc()], out="slot", **how).withColumn("slot", F.col("slot") - 1), "slots")
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        return placed.join(F.broadcast(sizes))  # one row
    return attach(placed, stage(sizes, "sizes"), list(keys), spread=F.col("slot"))


# Rows of a stratum that are packed into arrays of one row; larger strata are drawn by joins, with equal results.
PACK_ROWS = 200_000
# Keys that are hashed for one row of a packed stratum, and such rows of a task.
PIECE_KEYS, TASK_PIECES = 500_000, 4
EXACT = T.DecimalType(38, 0)


def _packed(
    values: DataFrame, groups: Sequence[str], columns: Sequence[str], identity: str, limit: int | None, head: str, key: Sequence[Column] = ()
) -> DataFrame | None:
    """One staged row (``groups``, n, <columns as arrays in id order>, head, middle) for each stratum, or None if the largest
    exceeds ``limit``. ``head`` and ``middle`` are the parts of a random key around the repetition: column ``head`` and ``key``."""
    parts = {"__head": F.concat_ws(":", F.col(head).cast("string"), F.lit("")), "__middle": F.concat(F.lit(":"), F.concat_ws(":", *[k.cast("string") for k in key], F.lit("")))}
    staged_ = staged(values.select(*groups, identity, *columns, *[text.alias(name) for name, text in parts.items()]), "strata")
    if largest_group(staged_, groups)[0] > (PACK_ROWS if limit is None else limit):
        return None
    entries = F.sort_array(F.collect_list(F.struct(identity, *columns)))
    rows = staged_.groupBy(*groups).agg(entries.alias("__rows"), *[F.min(name).alias(name) for name in parts])
    packed = rows.select(*groups, F.size("__rows").cast("long").alias("n"), *[F.col(f"__rows.{c}").alias(c) for c in columns], *parts)
    return stage(packed.where("n > 0"), "packed")


def _drawn(packed: DataFrame, groups: Sequence[str], blocks: int, keys: Sequence[str], fields: str, draw_piece: Callable) -> DataFrame:
    """Rows (``keys``, ``fields``) that ``draw_piece(stratum, blocks)`` gives as arrays for every stratum and block of repetitions.

    Blocks are dealt to pieces by what their stratum has to draw, and the pieces to tasks; a task holds the arrays of a few.
    """
    size = F.greatest(F.lit(1).cast("long"), F.least(F.lit(blocks).cast("long"), div(F.lit(PIECE_KEYS).cast("long"), F.col("n"))))
    facts = packed.select(*groups, size.alias("__size"))
    pieces = facts.agg(F.coalesce(F.sum(F.ceil(F.lit(blocks) / F.col("__size"))), F.lit(0))).first()[0]
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"), F.col("__size")))
    tasks = max(packed.sparkSession.sparkContext.defaultParallelism, -(-int(pieces) // TASK_PIECES))
    every = facts.withColumn("__first", first).repartition(tasks, *groups, "__first")
    rows = attach(every, packed, list(groups)) if groups else every.join(F.broadcast(packed))  # one row
    schema = T.StructType([*[packed.schema[k] for k in keys], *T._parse_datatype_string(fields).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                start, wide = (row.column(c)[0].as_py() for c in ("__first", "__size"))
                found = draw_piece(row, range(start, min(start + wide, blocks)))
                repeated = pa.array(np.zeros(len(found[0]), np.int64))
                yield pa.RecordBatch.from_arrays([*[row.column(k).take(repeated) for k in keys], *found], names=schema.names)

    return rows.mapInArrow(work, schema)


def _column(row: pa.RecordBatch, name: str) -> pa.Array:
    """The array that a packed stratum holds in column ``name``."""
    return row.column(name)[0].values


def _key_parts(row: pa.RecordBatch) -> tuple[str, str, int]:
    return tuple(row.column(c)[0].as_py() for c in ("__head", "__middle", "n"))


def _repeat(rows: DataFrame, repetitions: int, out: str = "rep") -> DataFrame:
    """Every row once per repetition; ``rows`` reads a staged table, so counting it is cheap."""
    spread = fan_out(rows, rows.count() * repetitions, *rows.columns)
    return spread.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))


def bootstrap_means(
    values: DataFrame,
    metrics: Sequence[str],
    repetitions: int,
    seed: Column | int,
    keys: Sequence[str] = (),
    strata: Sequence[str] = (),
    identity: str = "source_id",
    draw_key: Sequence[str] | None = None,
    pack_rows: int | None = None,
    **how,
) -> DataFrame:
    """Means of ``metrics`` per (keys, rep) over a resample of each stratum to its own size.

    One draw serves all metrics. ``draw_key`` names the columns that enter the random key between
    repetition and slot (default: the strata).
    """
    groups = [*keys, *strata]
    key = [F.col(c) for c in (strata if draw_key is None else draw_key)]
    seed_column = seed if isinstance(seed, Column) else F.lit(seed)
    seeded = values.withColumn("__seed", seed_column)
    packed = _packed(seeded, groups, metrics, identity, pack_rows, "__seed", key)
    if packed is None:
        return _joined_means(seeded, metrics, repetitions, keys, groups, key, identity, **how)
    names = list(metrics)

    # A row holds a stratum and draws for the repetitions of its blocks; only sums leave it.
    def sums_of(row: pa.RecordBatch, blocks: range) -> list[pa.Array]:
        head, middle, n = _key_parts(row)
        held = {m: _column(row, m).cast(pa.float64()) for m in names}
        known = {m: v.is_valid().to_numpy(zero_copy_only=False) if v.null_count else None for m, v in held.items()}
        held = {m: v.fill_null(0.0).to_numpy() for m, v in held.items()}
        reps, totals, counts = [], {m: [] for m in names}, {m: [] for m in names}
        for part in draws.spans(blocks, n):
            words = draws.md5_words(head, part, middle, n)
            for p in range(INDICES):
                at = draws.indices(words, p, n)
                reps.append(np.arange(part.start, part.stop) * INDICES + p)
                for m in names:
                    totals[m].append(held[m][at].sum(axis=1))
                    counts[m].append(np.full(len(part), n) if known[m] is None else known[m][at].sum(axis=1))
        every = np.concatenate(reps)
        kept = every < repetitions
        return [pa.array(every[kept]), *[pa.array(np.concatenate(v)[kept]) for v in totals.values()], *[pa.array(np.concatenate(v)[kept].astype(np.int64)) for v in counts.values()]]

    fields = ", ".join(["rep long", *[f"`{m}` double" for m in names], *[f"`n_{m}` long" for m in names]])
    sums = _drawn(packed, groups, -(-repetitions // INDICES), keys, fields, sums_of)
    return sums.groupBy(*keys, "rep").agg(*[F.try_divide(F.sum(m), F.sum(f"n_{m}")).alias(m) for m in metrics])


def _joined_means(
    values: DataFrame, metrics: Sequence[str], repetitions: int, keys: Sequence[str], groups: Sequence[str], key: list[Column], identity: str, **how
) -> DataFrame:
    """The same draws for strata of any size: one row for each draw, joined to the stratum."""
    indexed = stage(_index(values, groups, identity, **how), "indexed")
    # Repetitions that share a digest come from one row.
    blocks = _repeat(indexed.select(*groups, "slot", "n", "__seed"), -(-repetitions // INDICES), "__block")
    hexed = blocks.withColumn("__hex", digest(F.col("__seed"), F.col("__block"), *key, F.col("slot")))
    parts = F.array(*[
        F.struct((F.col("__block") * INDICES + p).alias("rep"), index_of(F.col("n"), F.col("__hex"), p).alias("slot")) for p in range(INDICES)
    ])
    draws = hexed.select(*groups, F.explode(parts).alias("d")).select(*groups, "d.rep", "d.slot").where(F.col("rep") < repetitions)
    lookup = indexed.select(*groups, "slot", *metrics)
    drawn = attach(draws, lookup, [*groups, "slot"])
    return drawn.groupBy(*keys, "rep").agg(*[F.avg(m).alias(m) for m in metrics])


def interval(means: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """95% percentile interval over repetitions; a group holds exactly R rows."""
    aggs = []
    for m in metrics:
        cuts = F.percentile(m, F.array(F.lit(0.025), F.lit(0.975)))
        aggs += [F.get(cuts, F.lit(0)).alias(f"{m}_ci_low"), F.get(cuts, F.lit(1)).alias(f"{m}_ci_high")]
    return means.groupBy(*keys).agg(*aggs)


def bootstrap_mean_ci(
    values: DataFrame, value: str, repetitions: int, seed: Column | int, keys: Sequence[str] = (), **how
) -> DataFrame:
    """Mean and bootstrap interval; non-finite values are dropped, no values give NULLs."""
    finite = values.where(_finite(value))
    observed = finite.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sources"), F.avg(value).alias("mean"))
    means = bootstrap_means(finite.withColumnRenamed(value, "mean"), ["mean"], repetitions, seed, keys, **how)
    limits = interval(means, ["mean"], keys).withColumnsRenamed({"mean_ci_low": "ci_low", "mean_ci_high": "ci_high"})
    return observed.join(limits, list(keys), "left") if keys else observed.join(F.broadcast(limits), how="left")


def signflip_test(
    contrasts: DataFrame, value: str, repetitions: int, seed: Column | int, keys: Sequence[str] = (), pack_rows: int | None = None, **how
) -> DataFrame:
    """U4: two-sided sign-flip p with the bootstrap interval at ``seed + 1``.

    Sums are compared in fixed point (12 decimals), so ties between a flipped and the observed sum
    count the same in any order of addition.
    """
    keys = list(keys)
    finite = stage(contrasts.where(_finite(value)), "contrasts")
    seed_column = seed if isinstance(seed, Column) else F.lit(seed)
    units = F.round(F.col(value) * SCALE).cast("long")
    rows = finite.withColumns({"__seed": seed_column, "__u": units})
    packed = _packed(rows, keys, ["__u"], "source_id", pack_rows, "__seed")
    null = _joined_flips(rows, keys, repetitions, **how) if packed is None else _packed_flips(packed, keys, repetitions)
    high = div(units, HALF)
    observed = finite.groupBy(*keys).agg(F.sum(high).alias("hi"), F.sum(units - high * HALF).alias("lo"))
    observed = observed.select(*keys, _whole(F.col("hi"), F.col("lo")).alias("observed"))
    if keys:
        compared = null.join(F.broadcast(observed), keys) if _small(observed) else null.join(observed, keys)
    else:
        compared = null.join(F.broadcast(observed))
    p = compared.groupBy(*keys).agg(
        ((1 + F.count_if(F.col("null") >= F.col("observed"))) / F.lit(1.0 + repetitions)).alias("p_value")
    )
    ci = bootstrap_mean_ci(finite, value, repetitions, seed_column + 1, keys, pack_rows=pack_rows, **how)
    return ci.join(p, keys) if keys else ci.join(F.broadcast(p), how="left")


def _whole(high: Column, low: Column) -> Column:
    return F.abs(high.cast("decimal(38,0)") * HALF + low)


# Bits of the summands of a flipped sum, and slots whose signs are numbers at once: sums of so few bits are exact as doubles.
PART_BITS, SIGN_SLOTS = 22, 8_192


def _packed_flips(packed: DataFrame, keys: Sequence[str], repetitions: int) -> DataFrame:
    """(keys, null): the absolute sum of every repetition, from packed strata."""

    def flipped(row: pa.RecordBatch, blocks: range) -> list[pa.Array]:
        head, _, n = _key_parts(row)
        units, low = _column(row, "__u").to_numpy(), (1 << PART_BITS) - 1
        parts = np.stack([units & low, (units >> PART_BITS) & low, units >> 2 * PART_BITS]).astype(np.float64)
        exact = lambda sums: sum(int(v) << (PART_BITS * k) for k, v in enumerate(sums))
        total, found = exact(parts.sum(axis=1)), []
        for part in draws.spans(blocks, n):
            bits = draws.leading(draws.md5_words(head, part, ":", n)).astype("<u4")
            for block, own in zip(part, bits, strict=True):
                plus = np.zeros((3, 32))
                for at in range(0, n, SIGN_SLOTS):
                    signs = np.unpackbits(own[at : at + SIGN_SLOTS].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
                    plus += parts[:, at : at + SIGN_SLOTS] @ signs.astype(np.float64)
                found += [Decimal(abs(2 * exact(plus[:, k]) - total)) for k in range(min(SIGNS, repetitions - block * SIGNS))]
        return [pa.array(found, pa.decimal128(38, 0))]

    return _drawn(packed, keys, -(-repetitions // SIGNS), keys, f"`null` {EXACT.simpleString()}", flipped)


def _joined_flips(rows: DataFrame, keys: Sequence[str], repetitions: int, **how) -> DataFrame:
    """The same sums for strata of any size, from one row for each slot and block of repetitions."""
    indexed = stage(_index(rows, keys, "source_id", **how), "indexed")
    # One digest carries the signs of a block of repetitions: n x R / 30 rows are made, with a sum per repetition.
    blocks = _repeat(indexed, -(-repetitions // SIGNS), "__block")
    signed = blocks.withColumns({
        "__bits": sign_bits(digest(F.col("__seed"), F.col("__block"), F.col("slot"))), "__h": div(F.col("__u"), HALF),
    }).withColumn("__l", F.col("__u") - F.col("__h") * HALF)
    plus = lambda k: F.shiftright("__bits", k).bitwiseAND(F.lit(1)) == 1
    flip = lambda c, k: F.sum(F.when(plus(k), F.col(c)).otherwise(-F.col(c)))
    sums = signed.groupBy(*keys, "__block").agg(*[flip(c, k).alias(f"{c}_{k}") for k in range(SIGNS) for c in ("__h", "__l")])
    lines = F.array(*[
        F.struct((F.col("__block") * SIGNS + k).alias("rep"), F.col(f"__h_{k}").alias("hi"), F.col(f"__l_{k}").alias("lo")) for k in range(SIGNS)
    ])
    null = sums.select(*keys, F.explode(lines).alias("s")).where(F.col("s.rep") < repetitions)
    return null.select(*keys, _whole(F.col("s.hi"), F.col("s.lo")).alias("null"))


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def stratified_bootstrap(values: DataFrame, value: str, label: str, repetitions: int, seed: int, **how) -> DataFrame:
    """Mean and interval when each label stratum is resampled to its own size."""
    means = bootstrap_means(values, [value], repetitions, seed, strata=[label], **how)
    observed = values.agg(F.avg(value).alias("mean"))
    limits = interval(means, [value]).withColumnsRenamed({f"{value}_ci_low": "ci_low", f"{value}_ci_high": "ci_high"})
    return observed.join(F.broadcast(limits))


def within_label_permutation(
    rows: DataFrame, x: str, y: str, label: str, repetitions: int, seed: int, identity: str = "source_id", pack_rows: int | None = None, **how
) -> DataFrame:
    """One-sided p that the rank correlation is as low as observed when y is permuted within
    labels.

    Permuting within labels keeps the multiset of y, so each side is ranked once and only the sum
    of rank products changes; doubled mid-ranks make that sum an exact integer.
    """
    ranked = average_rank(average_rank(rows.select(identity, label, x, y), [], x, out="rx", **how), [], y, out="ry", **how)
    doubled = ranked.select(
        identity, label, (F.col("rx") * 2).cast("long").alias("rx"), (F.col("ry") * 2).cast("long").alias("ry")
    )
    product = lambda a, b: (a * b).cast("decimal(38,0)")
    packed = _packed(doubled.withColumn("__seed", F.lit(seed)), [label], ["rx", "ry"], identity, pack_rows, "__seed", [F.col(label)])
    if packed is None:
        return _joined_permutation(doubled, label, repetitions, seed, identity, **how)

    # A row holds a label and some repetitions: its slots sorted by their random keys are the permutation.
    def permuted(row: pa.RecordBatch, blocks: range) -> list[pa.Array]:
        head, middle, n = _key_parts(row)
        rx, ry = (_column(row, c).fill_null(0).to_numpy() for c in ("rx", "ry"))
        if int(rx.max()) * int(ry.max()) * n >= 1 << 63:
            rx, ry = rx.astype(object), ry.astype(object)  # whole numbers of any size
        slots, found = np.arange(n, dtype=np.uint64), []
        for part in draws.spans(blocks, n):
            order = draws.leading(draws.md5_words(head, part, middle, n)).astype(np.uint64) << np.uint64(32)
            order |= slots
            order.sort(axis=1)
            order &= np.uint64(0xFFFFFFFF)
            found += [Decimal(int(np.dot(ry[places], rx))) for places in order.view(np.int64)]
        return [pa.array(np.arange(blocks.start, blocks.stop)), pa.array(found, pa.decimal128(38, 0))]

    part = _drawn(packed, [label], repetitions, [], f"rep long, `null` {EXACT.simpleString()}", permuted)
    null = part.groupBy("rep").agg(F.sum("null").alias("null"))
    observed = packed.select(F.explode(F.arrays_zip("rx", "ry")).alias("z")).agg(F.sum(product(F.col("z.rx"), F.col("z.ry"))).alias("observed"))
    return _as_low(null, observed, repetitions)


def _as_low(null: DataFrame, observed: DataFrame, repetitions: int) -> DataFrame:
    return null.join(F.broadcast(observed)).agg(
        ((1 + F.count_if(F.col("null") <= F.col("observed"))) / F.lit(1.0 + repetitions)).alias("p_value")
    )


def _joined_permutation(doubled: DataFrame, label: str, repetitions: int, seed: int, identity: str, **how) -> DataFrame:
    """The same permutations for labels of any size: one row for each slot and repetition, ordered and joined."""
    indexed = stage(_index(doubled, [label], identity, **how), "permuted")
    shuffled = _repeat(indexed.select(label, "slot"), repetitions).withColumn(
        "__key", draw(seed, F.col("rep"), F.col(label), F.col("slot"))
    )
    drawn = running(shuffled, ["rep", label], [F.col("__key").asc(), F.col("slot").asc()], out="place", **how)
    moved = drawn.select(label, "rep", "slot", (F.col("place") - 1).alias("target"))
    sides = attach(moved, indexed.select(label, F.col("slot"), "ry"), [label, "slot"])
    sides = attach(sides, indexed.select(label, F.col("slot").alias("target"), "rx"), [label, "target"])
    product = (F.col("rx") * F.col("ry")).cast("decimal(38,0)")
    null = sides.groupBy("rep").agg(F.sum(product).alias("null"))
    return _as_low(null, indexed.agg(F.sum(product).alias("observed")), repetitions)


def paired_stratified_bootstrap(
    members: DataFrame, pairs: dict[str, tuple[str, str]], repetitions: int, seed: int, **how
) -> DataFrame:
    """Per cohort the B-minus-A difference of equal-source rates in percentage points.

    ``members`` are rows (cohort, source_id, label, <rates>); ``pairs`` maps a metric to its (A, B)
    columns. All metrics share one draw per (cohort, repetition, label, slot).
    """
    columns = [c for pair in pairs.values() for c in pair]
    means = bootstrap_means(
        members, columns, repetitions, seed, keys=["cohort"], strata=["label"], draw_key=["cohort", "label"], **how
    )
    differences = {m: 100.0 * (F.col(b) - F.col(a)) for m, (a, b) in pairs.items()}
    limits = interval(means.select("cohort", *[d.alias(m) for m, d in differences.items()]), list(pairs), ["cohort"])
    observed = members.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("sources"), F.count_distinct("label").alias("label_strata"), *[F.avg(c).alias(c) for c in columns]
    ).select("cohort", "sources", "label_strata", *[d.alias(f"{m}_difference") for m, d in differences.items()])
    return observed.join(limits, "cohort")


def bh_adjust(tests: DataFrame, family: str, p: str, identity: str, out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg within family; NULL or NaN p stays NULL.

    A family is a declared list of tests, so its windows are report-sized.
    """
    usable = _finite(p)
    tests = tests.withColumn("__m", F.count_if(usable).over(Window.partitionBy(family)))
    tests = tests.withColumn("__use", usable)
    within = Window.partitionBy(family, "__use")
    tests = tests.withColumn("__rank", F.row_number().over(within.orderBy(p, identity)))
    tail = within.orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(tail))
    return tests.withColumn(out, F.when(F.col("__use"), adjusted)).drop("__m", "__use", "__rank")


def holm_adjust(tests: DataFrame, family: str, p: str, identity: str, out: str = "holm_p") -> DataFrame:
    """Holm step-down within family."""
    order = Window.partitionBy(family).orderBy(p, identity)
    ranked = tests.withColumns({
        "__m": F.count(F.lit(1)).over(Window.partitionBy(family)), "__rank": F.row_number().over(order)
    })
    running_max = F.max(F.col(p) * (F.col("__m") - F.col("__rank") + 1)).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return ranked.withColumn(out, F.least(F.lit(1.0), running_max)).drop("__m", "__rank")


# ---------------------------------------------------------------- source-level contrasts

# Stage numbers of the two branches and names of the outcomes.
BLOCKS = {1: (1, 2), 2: (4, 5)}
CODES = {0: "class_preserved", 1: "adverse", 2: "corrective", 3: "lateral"}


def _lines(df: DataFrame, lines: list[tuple[str, str, Column]]) -> DataFrame:
    """Long rows (family, test, source_id, contrast), leaving out undefined contrasts."""
    entries = F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(t).alias("test"), c.cast("double").alias("contrast")) for f, t, c in lines
    ])
    return df.select("source_id", F.explode(entries).alias("e")).select(
        F.col("e.family").alias("family"), F.col("e.test").alias("test"), "source_id", F.col("e.contrast").alias("contrast")
    ).where(F.col("contrast").isNotNull())


def source_contrasts(traces: DataFrame, patches: DataFrame, summary: DataFrame, stages: int, metric: int) -> DataFrame:
    """U8: all source-level contrasts as rows (family, test, source_id, contrast).

    Means per (source, outcome, stage) are taken in one conditional aggregation instead of one pass
    per source, outcome and stage; a contrast exists only where both of its sides do.
    """
    primary = traces.where(F.col("metric") == metric)
    trace_means = primary.groupBy("source_id").agg(*[
        F.avg(F.when((F.col("transition_code") == code) & (F.col("stage") == s), F.col("value"))).alias(f"m{code}_{s}")
        for code in CODES for s in range(stages)
    ])
    restored = F.when(F.col("patch_prediction") == F.col("clean_prediction"), 1.0).otherwise(0.0)
    patch_means = patches.groupBy("source_id").agg(*[
        F.avg(F.when((F.col("transition_code") == code) & (F.col("stage") == s), restored)).alias(f"r{code}_{s}")
        for code in CODES if code for pair in BLOCKS.values() for s in pair
    ])
    m, r = (lambda c, s: F.col(f"m{c}_{s}")), (lambda c, s: F.col(f"r{c}_{s}"))
    traced = _lines(trace_means, [
        *[("transition_vs_preserved", f"{name}:{s}", m(code, s) - m(0, s)) for code, name in CODES.items() if code for s in range(stages)],
        *[("global_vs_local_trace", f"{name}:{b}", m(code, a) - m(code, l)) for code, name in CODES.items() for b, (a, l) in BLOCKS.items()],
    ])
    patched = _lines(patch_means, [
        ("global_vs_local_patch", f"{name}:{b}", r(code, a) - r(code, l)) for code, name in CODES.items() if code for b, (a, l) in BLOCKS.items()
    ])
    geometry = _lines(summary, [
        ("geometry", "previous_minus_next", F.col("previous_minus_next_class_change_rate")),
        ("geometry", "late_minus_early", F.col("time_tertile_3_class_change_rate") - F.col("time_tertile_1_class_change_rate")),
        ("geometry", "high_minus_low", F.col("feature_quartile_4_class_change_rate") - F.col("feature_quartile_1_class_change_rate")),
    ])
    return traced.unionByName(patched).unionByName(geometry)


def restoration_contrasts(patches: DataFrame) -> DataFrame:
    """Per (outcome, stage, source): shares of replacements restored to the clean and true class."""
    share = lambda target: F.avg(F.when(F.col("patch_prediction") == F.col(target), 1.0).otherwise(0.0))
    return patches.groupBy("transition_code", "stage", "source_id").agg(
        share("clean_prediction").alias("restored_clean"), share("label").alias("restored_true")
    )


def contrast_family(contrasts: DataFrame, repetitions: int, seed: Column, **how) -> DataFrame:
    """Sign-flip test of every contrast in one job, with q-values inside each family."""
    tested = signflip_test(contrasts, "contrast", repetitions, seed, ["family", "test"], **how)
    return bh_adjust(tested, "family", "p_value", "test")


def margin_association(summary: DataFrame, repetitions: int, seed: int, **how) -> DataFrame:
    """Rank correlation of clean margin and adverse rate on correct sources with its
    within-label permutation p."""
    rows = stage(
        summary.where("clean_correct").select(
            "source_id", "label", "clean_margin", F.try_divide("adverse_unique", "unique_candidates").alias("adverse_rate")
        ),
        "association",
    )
    rho = spearman(rows, [], "clean_margin", "adverse_rate", **how)
    p = within_label_permutation(rows, "clean_margin", "adverse_rate", "label", repetitions, seed, **how)
    return rho.join(F.broadcast(p))
