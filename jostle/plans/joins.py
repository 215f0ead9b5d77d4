"""Many-to-one joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup side is broadcast only when it was measured and found no larger than this.
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
# Bytes of the fixed-size types; anything else is taken as 16.
WIDTHS = {"ByteType": 1, "BooleanType": 1, "ShortType": 2, "IntegerType": 4, "FloatType": 4, "DateType": 4}


def _bytes(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        element = 64 if isinstance(kind.elementType, (T.StringType, T.StructType, T.ArrayType)) else 8
        return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * element + 16
    return F.lit(WIDTHS.get(type(kind).__name__, 8 if isinstance(kind, (T.LongType, T.DoubleType)) else 16))


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of a staged or source-level table; one number reaches the driver."""
    width = F.lit(16)
    for field in df.schema:
        width = width + _bytes(F.col(field.name), field.dataType)
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]


def attach(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: Column | None = None,
    broadcast_bytes: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``facts`` to a unique-keyed ``lookup`` (a staged table or a source-level one).

    The lookup is measured first. Up to ``broadcast_bytes`` it is broadcast, so the facts are not
    shuffled. Beyond that both sides are shuffled on the key plus a salt: the facts get a salt
    from ``spread`` (any expression that varies within a key; default all other columns) and
    each lookup row is repeated once per salt, so a hot key is shared by ``salts`` tasks.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if measured_bytes(lookup) <= limit:
        return facts.join(F.broadcast(lookup), on, how)
    if spread is None:
        spread = F.struct(*[F.col(c) for c in facts.columns if c not in on])
    salted = facts.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")
