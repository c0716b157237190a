"""Seeded subsets and splits with exact counts.

All of them cut one seeded order (see ``ordering``) at a few positions, so a
subset followed by a two- or three-way split still costs one histogram and no
shuffle of rows. The same seed gives the same rows under any partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import quoted
from .joins import join_same
from .ordering import (
    attach_cuts,
    hash_keys_at,
    keys_at_each,
    natural_order,
    range_bucket,
    seeded_hash,
    seeded_order,
    take_seeded,
)

# Names a published split may go by, first match wins.
SPLIT_ALIASES = {
    "train": ("train",),
    "valid": ("validation", "valid", "val"),
    "test": ("test",),
}
HELD_OUT_ALIASES = ("test", "validation")
SPLIT_SEED_OFFSET = {"train": 0, "valid": 1, "test": 2}



def _rows() -> Column:
    return F.col("n")


def cap(size: int | None) -> Column:
    """``min(size, n)``; no size means all rows, negative sizes none."""
    if size is None:
        return _rows()
    return F.least(_rows(), F.lit(max(0, int(size))).cast("bigint"))


def held_out(rows: Column, size: float | int | Column) -> Column:
    """Rows to hold out of ``rows``: a ratio rounds half to even, a count is
    taken as it is, and both sides keep at least one row."""
    if isinstance(size, float):
        if not 0 < size < 1:
            raise ValueError(f"{size} is no ratio between 0 and 1")
        size = F.rint(rows * F.lit(size)).cast("bigint")
    elif isinstance(size, int):
        size = F.lit(size).cast("bigint")
    clamped = F.greatest(F.lit(1), F.least(rows - 1, size)).cast("bigint")
    too_few = F.raise_error(F.lit("A split needs two rows or more"))
    return F.when(rows < 2, too_few).otherwise(clamped)


def _check_ratio(name: str, ratio: float) -> float:
    ratio = float(ratio)
    if not 0 < ratio < 1:
        raise ValueError(f"{name}: {ratio} is no ratio between 0 and 1")
    return ratio


def _label(
    df: DataFrame,
    cuts: Mapping[str, Column],
    key: Sequence[str],
    seed: int,
) -> DataFrame:
    """Label every row with the first cut it lies below; rows beyond the last
    cut are dropped."""
    found = attach_cuts(df, hash_keys_at(df, key, seed, dict(cuts)), [])
    order = seeded_order(seed, key)
    label = F.coalesce(
        *[F.when(order <= F.col("_cut").getField(name), name) for name in cuts]
    )
    rest = [quoted(c) for c in df.columns if c != "split"]
    return found.select(*rest, label.alias("split")).where("split is not null")


def take_subset(
    df: DataFrame, size: int | None, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """At most ``size`` rows in seeded order; ``None`` keeps all. Rows are kept by
    comparison with a cut point, so that no task holds the subset."""
    if size is None:
        return df
    if int(size) <= 0:
        return df.where(F.lit(False))
    return take_seeded(df, cap(size), key, seed)


def shuffled(
    df: DataFrame, key: Sequence[str], seed: int = 42, name: str = "shuffle_key"
) -> DataFrame:
    """Add the column that puts rows in seeded order; sinks sort by it."""
    return df.withColumn(name, seeded_hash(seed, key))


def train_test(
    df: DataFrame, size: float | int, key: Sequence[str], seed: int = 42
) -> DataFrame:
    return _label(df, {"test": held_out(_rows(), size), "train": _rows()}, key, seed)


def train_valid(
    df: DataFrame,
    key: Sequence[str],
    valid_ratio: float = 0.1,
    seed: int = 42,
    max_examples: int | None = None,
) -> DataFrame:
    ratio = _check_ratio("valid_ratio", valid_ratio)
    rows = cap(max_examples)
    return _label(df, {"valid": held_out(rows, ratio), "train": rows}, key, seed)


def train_valid_test(
    df: DataFrame,
    key: Sequence[str],
    valid_ratio: float = 0.05,
    test_ratio: float = 0.05,
    seed: int = 42,
    max_examples: int | None = None,
) -> DataFrame:
    """Test is held out first, then valid from what is left."""
    valid_ratio = _check_ratio("valid_ratio", valid_ratio)
    test_ratio = _check_ratio("test_ratio", test_ratio)
    if valid_ratio + test_ratio >= 1:
        raise ValueError("valid and test ratios leave nothing to train on")
    rows = cap(max_examples)
    test = held_out(rows, test_ratio)
    valid = held_out(rows - test, valid_ratio / (1.0 - test_ratio))
    cuts = {"test": test, "valid": test + valid, "train": rows}
    return _label(df, cuts, key, seed)


def existing_splits(
    df: DataFrame,
    names: Mapping[str, str] | None = None,
    aliases: Mapping[str, Sequence[str]] = SPLIT_ALIASES,
) -> DataFrame:
    """Rename published splits to the wanted ones.

    For each target the configured name comes first, then its aliases; the first
    one that occurs wins, and none occurring is an error. One published split
    may serve several targets.
    """
    names = names or {}
    # Bounded: one element per published split.
    present = df.select(F.collect_set("split")).scalar()
    targets = []
    for target, defaults in aliases.items():
        tried = [names[target]] if names.get(target) else []
        tried += [name for name in defaults if name not in tried]
        missing = F.raise_error(F.lit(f"No published split named any of {tuple(tried)}"))
        chosen = F.coalesce(
            *[F.when(F.array_contains(present, name), name) for name in tried],
            missing.cast("string"),
        )
        targets.append(F.when(F.col("split") == chosen, target))
    rest = [quoted(c) for c in df.columns if c != "split"]
    kept = F.explode(F.array_compact(F.array(*targets)))
    return df.select(*rest, kept.alias("split"))


def cap_splits(
    df: DataFrame,
    sizes: Mapping[str, int | None] | int | None,
    key: Sequence[str],
    seed: int = 42,
) -> DataFrame:
    """At most so many rows per split: one number for all or one per split."""
    if sizes is None or sizes == {}:
        return df
    if isinstance(sizes, Mapping):
        size = _rows()
        for name, value in sizes.items():
            if value is not None:
                size = F.when(F.col("split") == name, cap(value)).otherwise(size)
    else:
        size = cap(sizes)
    return take_seeded(df, size, key, seed, ["split"])


def train_valid_existing_test(
    df: DataFrame,
    key: Sequence[str],
    valid_ratio: float = 0.1,
    seed: int = 42,
    names: Mapping[str, str] | None = None,
    max_examples: int | None = None,
) -> DataFrame:
    """Carve valid out of the published train split and keep the published test
    split; ``max_examples`` caps the train source only."""
    aliases = {"train": SPLIT_ALIASES["train"], "test": HELD_OUT_ALIASES}
    named = existing_splits(df, names, aliases)
    carved = train_valid(
        named.where("split = 'train'"), key, valid_ratio, seed, max_examples
    )
    test = named.where("split = 'test'")
    return carved.unionByName(test.select(*carved.columns))


def split_ratio(split: Mapping, name: str, default: float) -> float:
    """``valid_ratio`` style keys come before ``ratios``, then the default."""
    if f"{name}_ratio" in split:
        return float(split[f"{name}_ratio"])
    ratios = split.get("ratios") or {}
    return float(ratios.get(name, default))


def subset_pairs(
    pairs: DataFrame,
    limits: Mapping[str, int],
    seed: int = 42,
    key: Sequence[str] = ("pair_id",),
) -> DataFrame:
    """Subset per split without replacement; limits of zero or less keep all.

    The seed moves on by one per split, so each split has its own order.
    """
    parts = []
    for split, limit in limits.items():
        rows = pairs.where(F.col("split") == split)
        if limit > 0:
            offset = SPLIT_SEED_OFFSET.get(split, 0)
            rows = take_subset(rows, limit, key, seed + offset)
        parts.append(rows)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def decimate(df: DataFrame, key: Sequence[str], max_points: int = 500) -> DataFrame:
    """Every ``n // max_points``-th row in key order once there are more than
    ``max_points`` rows.

    The wanted positions number fewer than ``2 * max_points``, so their keys are
    found like cut points and the rows fetched by key.
    """
    n = F.col("n")
    step = F.when(n > max_points, F.floor(n / max_points)).otherwise(F.lit(1))
    places = F.sequence(F.lit(1).cast("bigint"), n, step.cast("bigint"))
    wanted = F.transform(places, lambda k: F.struct(k.alias("name"), k.alias("k")))
    found = keys_at_each(df, natural_order(key), range_bucket(df, key), wanted)
    # Bounded by 2 * max_points rows.
    return join_same(df, found.select("key.*"), list(key), "left_semi", small=True)
