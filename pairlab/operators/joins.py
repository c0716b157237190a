"""Joins that keep rows with null keys, and joins to a side with one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import quoted
from ..session import materialize

MAX_BROADCAST_BYTES = 256 * 1024**2
ROW_OVERHEAD = 64
#: Bits of a set's Bloom filter: its size has a fixed bound, 16 MB.
FILTER_BITS = 1 << 27


def join_same(
    df: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    small: bool = False,
) -> DataFrame:
    """Join by equal keys, null being equal to null. The keys are kept once;
    ``small`` broadcasts the side."""
    names = [f"_same_{n}" for n in range(len(keys))]
    renamed = side.select(
        *[quoted(k).alias(n) for k, n in zip(keys, names, strict=True)],
        *[quoted(c) for c in side.columns if c not in keys],
    )
    same = [
        df[quoted_name(k)].eqNullSafe(renamed[n])
        for k, n in zip(keys, names, strict=True)
    ]
    if small:
        renamed = F.broadcast(renamed)
    return df.join(renamed, reduce(Column.__and__, same), how).drop(*names)


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table_bytes(df: DataFrame) -> int:
    """Size of a table's values as text, plus a fixed overhead per row."""
    widths = [
        F.coalesce(F.octet_length(quoted(c).cast("string")), F.lit(0))
        for c in df.columns
    ]
    total = sum(widths, F.lit(ROW_OVERHEAD))
    return df.agg(F.sum(total.cast("bigint")).alias("bytes")).head()["bytes"] or 0


def join_unique(
    df: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    limit: int | None = None,
) -> DataFrame:
    """Join ``side``, which has one row per key, to ``df``; null equals null.

    The side is written once and measured. Up to ``limit`` bytes it is broadcast
    and ``df`` stays in place; beyond, both are shuffled, and adaptive execution
    splits the partitions of ``df`` that a frequent key makes large. The result is
    the same.
    """
    stored = materialize(side)
    limit = MAX_BROADCAST_BYTES if limit is None else limit
    return join_same(df, stored, list(keys), how, table_bytes(stored) <= limit)


def _bloom_filter(keys: DataFrame, key: str) -> DataFrame:
    """``bucket`` and ``bits`` of 32,768 places each: at most ``FILTER_BITS`` in all,
    built by the executors."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return (
        keys.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))
    )


def tag_members(
    df: DataFrame, keys: DataFrame, key: str, name: str, limit: int | None = None
) -> DataFrame:
    """``df`` with a column ``name``: whether ``key`` is among ``keys``, a set of
    distinct values in a column of that name.

    The set is written once and measured. Up to ``limit`` bytes it is broadcast.
    Beyond, rows that its Bloom filter excludes stay where they are, and the others
    are shuffled to the exact join; ``df`` is read twice for that, which costs less
    than moving it. Null keys are no members.
    """
    stored = materialize(keys.select(key))
    limit = MAX_BROADCAST_BYTES if limit is None else limit
    columns = [quoted(c) for c in df.columns]
    marked = stored.select(F.col(key).alias("_member"))
    hit = F.col("_member").isNotNull().alias(name)
    if table_bytes(stored) <= limit:
        near = df.join(F.broadcast(marked), df[key] == marked["_member"], "left")
        return near.select(*columns, hit)
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10)
    sieve = F.broadcast(_bloom_filter(stored, key))
    sieved = (
        df.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": bit})
        .join(sieve, "_bucket", "left")
    )
    mask = F.expr("shiftleft(1, cast(mod(_bit, 8) as int))")
    held = F.coalesce(byte.cast("int").bitwiseAND(mask) != 0, F.lit(False))
    outside = sieved.where(~held).select(*columns, F.lit(False).alias(name))
    inside = sieved.where(held).select(*columns)
    exact = inside.join(marked, inside[key] == marked["_member"], "left")
    return outside.unionByName(exact.select(*columns, hit))
