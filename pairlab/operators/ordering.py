"""Exact ranks without sorting whole rows in one place.

A window without ``partitionBy`` runs in one task, and a global sort moves every
row. Both are avoided here. Rows fall into *ordered buckets*: a prefix of a hash
for seeded orders, sampled range boundaries for natural orders. One map-side
combined count per bucket tells which bucket holds the k-th row, and only the
rows of that bucket are ranked, by their order columns alone. The result is the
k-th order key itself, and whole rows are then kept or dropped by comparing with
it, which needs no shuffle of the rows at all.

Order columns must identify a row; ties beyond them are cut arbitrarily.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.paths import quoted
from ..session import materialize
from .joins import MAX_BROADCAST_BYTES, join_same, table_bytes

Bucket = Callable[[Column], Column]  # order column -> ordered bucket

# 4,096 hash buckets. More would make the histogram of each task almost as long as
# its rows; with these, 1e11 rows leave 2.4e7 keys in a cut bucket, a few GB that
# one task sorts with spilling.
HASH_DIGITS = 3
ROWS_PER_BUCKET = 1_000_000
# Where whole rows move with their keys and may be long (strings, lists).
LONG_ROWS_PER_BUCKET, MAX_LONG_BUCKETS = 16_384, 1024
MAX_BUCKETS = 4096
SAMPLES_PER_BUCKET = 64


def seeded_hash(seed: int, key: Sequence[str]) -> Column:
    """Seeded order of a row: SHA-256 over seed and key, the same in any engine
    and under any partitioning."""
    parts = [F.coalesce(quoted(k).cast("string"), F.lit("")) for k in key]
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256)
    # Never null; saying so spares a null filter that would hash once more.
    return F.coalesce(digest, F.lit(""))


def seeded_order(seed: int, key: Sequence[str]) -> Column:
    """Comparable struct of hash and key."""
    return F.struct(seeded_hash(seed, key).alias("h"), *[quoted(k) for k in key])


def _hash_bucket(order: Column) -> Column:
    return F.substring(order.getField("h"), 1, HASH_DIGITS)


def _one_bucket(order: Column) -> Column:
    return F.lit(0)


def natural_order(key: Sequence[str]) -> Column:
    return F.struct(*[quoted(k) for k in key])


def _literal(row) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in row.asDict().items()])


def range_bucket(
    df: DataFrame, key: Sequence[str], rows: int | None = None, moved: bool = False
) -> Bucket:
    """Ordered bucket number of a row under the natural order of ``key``.

    Small tables get one bucket. Otherwise a sample of the key columns, of at
    most a few hundred thousand keys whatever the table size, gives the
    boundaries; every row is compared with them, so none is lost. The lookup is
    a pure expression of the row: a lost task recomputes the same bucket. Where whole
    rows are ``moved`` by bucket and have columns of any length, buckets are smaller:
    a task reads one or more of them whole.
    """
    keys = df.select(*[quoted(k) for k in key])
    rows = keys.count() if rows is None else rows
    buckets = min(MAX_BUCKETS, ceil(rows / ROWS_PER_BUCKET))
    if moved and not all(_is_short(f.dataType) for f in df.schema):
        own = min(MAX_LONG_BUCKETS, ceil(rows / LONG_ROWS_PER_BUCKET))
        buckets = max(buckets, own)
    if buckets <= 1:
        return _one_bucket
    wanted = buckets * SAMPLES_PER_BUCKET
    fraction = min(1.0, 2 * wanted / rows)
    sample = keys.sample(fraction=fraction, seed=17).distinct().sort(*keys.columns)
    found = sample.collect()
    step = max(1, len(found) // buckets)
    bounds = [_literal(row) for row in found[step::step]]
    if not bounds:
        return _one_bucket
    return lambda order: _bucket_of(order, bounds)


def _is_short(kind: T.DataType) -> bool:
    """A value of a few bytes, whatever the row."""
    return isinstance(kind, _SHORT)


_SHORT = (
    T.NumericType,
    T.BooleanType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.NullType,
)


def _bucket_of(order: Column, bounds: list[Column]) -> Column:
    """How many boundaries lie at or below ``order``, in two short scans: about
    2 * sqrt(n) comparisons instead of n."""
    width = isqrt(len(bounds)) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def below(items: Column) -> Column:
        return F.size(F.filter(items, lambda bound: bound <= order))

    heads = F.array(*[group[0] for group in groups])
    tails = F.array(*[F.array(*group) for group in groups])
    group = below(heads)
    inside = below(F.element_at(tails, F.greatest(group, F.lit(1))))
    return F.when(group == 0, 0).otherwise((group - 1) * width + inside)


def keys_at_each(
    df: DataFrame,
    order: Column,
    bucket: Bucket,
    wanted: Column,
    by: Sequence[str] = (),
) -> DataFrame:
    """The order keys at wanted positions, one row (``name``, ``key``, ``n``) per
    ``by`` group and position.

    ``wanted`` is an array of ``struct<name, k>`` over the group's row count
    ``n``; positions are one-based, those below 1 are not found and those past
    the end give the last key. Reads only order and ``by`` columns. The histogram
    holds at most one row per group and bucket, and the rows ranked are those of
    the buckets that hold a wanted position.
    """
    by = list(by)
    slim = df.select(*[quoted(c) for c in by], order.alias("_o"))
    slim = slim.withColumn("_b", bucket(F.col("_o")))
    counts = slim.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    running = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    position = F.least(F.col("_w.k").cast("bigint"), F.col("n"))
    cuts = (
        counts.withColumn("_upto", F.sum("_c").over(running))
        .withColumn("n", F.sum("_c").over(group))
        .withColumn("_w", F.explode(wanted))
        .withColumn("_k", position - F.col("_upto") + F.col("_c"))
        .where((F.col("_k") > 0) & (F.col("_k") <= F.col("_c")))
        .select(*by, "_b", "n", "_k", F.col("_w.name").alias("name"))
    )
    # Bounded: one row per group and wanted position.
    held = cuts.select(*by, "_b").distinct()
    inside = join_same(slim, held, [*by, "_b"], "left_semi", small=True)
    ranked = Window.partitionBy(*by, "_b").orderBy("_o")
    inside = inside.withColumn("_k", F.row_number().over(ranked).cast("bigint"))
    found = join_same(inside, cuts, [*by, "_b", "_k"], small=True)
    return found.select(*by, "name", F.col("_o").alias("key"), "n")


def key_at(
    df: DataFrame,
    order: Column,
    bucket: Bucket,
    positions: dict[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """``keys_at_each`` for a few named positions, one column per name."""
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), k.cast("bigint").alias("k"))
            for name, k in positions.items()
        ]
    )
    picked = [
        F.max(F.when(F.col("name") == name, F.col("key"))).alias(name)
        for name in positions
    ]
    found = keys_at_each(df, order, bucket, wanted, by)
    return found.groupBy(*by).agg(F.max("n").alias("n"), *picked)


def hash_keys_at(
    df: DataFrame,
    key: Sequence[str],
    seed: int,
    positions: dict[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    order = seeded_order(seed, key)
    return key_at(df, order, _hash_bucket, positions, by)


def attach_cuts(df: DataFrame, cuts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the cut struct ``_cut`` to every row without moving the rows."""
    names = [c for c in cuts.columns if c not in by]
    packed = cuts.select(*by, F.struct(*names).alias("_cut"))
    if by:
        # Bounded: one row per group of a declared, small-cardinality column.
        return join_same(df, packed, list(by), "left", small=True)
    return df.withColumn("_cut", packed.scalar())


def take_seeded(
    df: DataFrame,
    size: Column,
    key: Sequence[str],
    seed: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """The first ``size`` rows (an expression over ``n``) in seeded order, per
    ``by`` group. Exact, no row is moved."""
    cuts = hash_keys_at(df, key, seed, {"last": size}, by)
    marked = attach_cuts(df, cuts, by)
    keep = seeded_order(seed, key) <= F.col("_cut.last")
    return marked.where(keep).select(*[quoted(c) for c in df.columns])


def rows_between(
    df: DataFrame, key: Sequence[str], start: int, stop: int | None
) -> DataFrame:
    """Rows ``start <= position < stop`` (zero-based) in key order."""
    if start < 0 or (stop is not None and stop < start):
        raise ValueError(f"Invalid row range [{start}:{stop}]")
    if stop is not None and stop == start:
        return df.limit(0)
    bucket = range_bucket(df, key)
    positions = {"first": F.lit(start + 1)}
    if stop is not None:
        positions["last"] = F.lit(stop)
    cuts = key_at(df, natural_order(key), bucket, positions)
    marked = attach_cuts(df, cuts, [])
    order = natural_order(key)
    keep = (order >= F.col("_cut.first")) & (F.col("_cut.n") > start)
    if stop is not None:
        keep = keep & (order <= F.col("_cut.last"))
    return marked.where(keep).select(*[quoted(c) for c in df.columns])


def global_index(
    df: DataFrame,
    key: Sequence[str],
    name: str = "row_index",
    by: Sequence[str] = (),
) -> DataFrame:
    """Zero-based position in key order, per ``by`` group.

    One shuffle, on the range bucket; offsets come from a count per bucket. Whole rows
    move, so rows that may be long have buckets of their own, smaller size.
    """
    by = list(by)
    bucket = range_bucket(df, key, moved=True)
    bucketed = df.withColumn("_b", bucket(natural_order(key)))
    inside = Window.partitionBy(*by, "_b").orderBy(*[quoted(k) for k in key])
    ranked = bucketed.withColumn("_r", F.row_number().over(inside))
    columns = [quoted(c) for c in df.columns]
    if bucket is _one_bucket:
        return ranked.select(*columns, (F.col("_r") - 1).cast("bigint").alias(name))
    counts = bucketed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")
    )
    # Without groups at most MAX_BUCKETS rows.
    indexed = join_same(ranked, offsets, [*by, "_b"], small=not by)
    place = (F.col("_off") + F.col("_r") - 1).cast("bigint").alias(name)
    return indexed.select(*columns, place)


def average_ranks(
    df: DataFrame, values: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Rank of each value column within ``by``, ties sharing the mean of their
    ranks, under the names ``values`` maps the columns to. Nulls come first and
    tie with one another; a null group is a group.

    One way for tables of any size. Equal values are counted on the map side first,
    so a value that a third of all rows hold is one row to rank. The distinct values
    then go through one range shuffle: values stay in their order across partitions,
    a running sum ranks them within, and the partitions' totals, one small row each,
    are the offsets. Ranks of all columns of a type are written once and looked up by
    value: by broadcast where their measured size allows, else under a shuffle that
    splits frequent values.
    """
    by = list(by)
    kinds: dict[str, list[str]] = {}
    for value in values:
        kinds.setdefault(df.schema[value].dataType.simpleString(), []).append(value)
    result = df
    for same in kinds.values():
        ranks = materialize(_ranks_of_values(df, same, by))
        # Of all columns together: an upper bound for each.
        small = table_bytes(ranks) <= MAX_BROADCAST_BYTES
        for value in same:
            own = ranks.where(F.col("_column") == value).select(
                *by, F.col("_v").alias(value), F.col("_r").alias(values[value])
            )
            result = join_same(result, own, [*by, value], "left", small)
    return result.select(*[quoted(c) for c in [*df.columns, *values.values()]])


def _ranks_of_values(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """(by, _column, _v, _r): ranks of the distinct values of columns of one type."""
    each = F.array(
        *[F.struct(F.lit(v).alias("_column"), quoted(v).alias("_v")) for v in values]
    )
    keys = [*by, "_column"]
    counts = (
        df.select(*[quoted(c) for c in by], F.inline(each))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    order = [quoted(c) for c in [*keys, "_v"]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Sorted in its partition, a row's id is the partition and the place in it.
    placed = (
        materialize(counts)
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_p", F.shiftright("_id", 33))
    )
    stored = materialize(placed)
    inside = Window.partitionBy(*[quoted(k) for k in keys], "_p").orderBy("_id")
    upto = F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # One row for each partition and each group in it.
    totals = stored.groupBy(*[quoted(k) for k in keys], "_p").agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy(*[quoted(k) for k in keys]).orderBy("_p")
    earlier = F.sum("_s").over(before.rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(
        *[quoted(k) for k in keys], "_p", F.coalesce(earlier, F.lit(0)).alias("_off")
    )
    ranked = join_same(stored.withColumn("_upto", upto), totals, [*keys, "_p"])
    last = F.col("_off") + F.col("_upto")
    rank = (last - (F.col("_c") - 1) / 2).alias("_r")
    return ranked.select(*[quoted(k) for k in keys], "_v", rank)
