"""Sinks: prepared pairs, metadata, score tables and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.filters import check_features


def write_pairs(
    pairs: DataFrame,
    path: str,
    splits: Sequence[str],
    format: str = "json",
    shuffle: bool = False,
) -> dict[str, int]:
    """``{path}/split=.../`` with prompt and completion only; text is UTF-8.
    Returns the rows of each split, counted by the writing tasks.

    Files are in seeded order each. ``shuffle`` also spreads the rows over the
    files by that order, which moves every row once.
    """
    order = [c for c in ("split", "shuffle_key") if c in pairs.columns]
    rows = pairs.repartitionByRange(*order) if shuffle else pairs
    # After the shuffle: its sampling pass runs everything before it once more.
    watch = Observation("rows_per_split")
    counts = [F.count_if(F.col("split") == name).alias(name) for name in splits]
    rows = rows.observe(watch, *counts)
    rows = rows.sortWithinPartitions(*order).select("split", "prompt", "completion")
    rows.write.mode("overwrite").partitionBy("split").format(format).save(path)
    return {name: int(watch.get[name]) for name in splits}


def dataset_metadata(
    stats: DataFrame, dataset_name: str, source_dataset: str, seed: int
) -> DataFrame:
    """One row per dataset: split counts and filter statistics by split."""
    names = [c for c in stats.columns if c != "split"]
    entry = F.struct(*names)
    # Bounded: one element per split.
    by_split = F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("split", entry.alias("stats"))))
    )
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "kept"))))
    return stats.agg(
        F.lit(dataset_name).alias("dataset_name"),
        F.lit(source_dataset).alias("source_dataset"),
        F.lit(seed).alias("seed"),
        counts.alias("split_counts"),
        by_split.alias("filter_stats"),
    )


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.coalesce(1).write.mode("overwrite").json(path)


def write_keyed(df: DataFrame, path: str, by: str | None = "split") -> None:
    """Score and prediction tables, partitioned by split so that a reader of one
    split prunes the others."""
    writer = df.write.mode("overwrite")
    if by is not None and by in df.columns:
        writer = writer.partitionBy(by)
    writer.parquet(path)


def write_features(df: DataFrame, path: str, features: str = "features") -> None:
    """Feature table as ``row_id`` and float vectors, checked for shape."""
    shaped = df.withColumn(features, F.col(features).cast("array<float>"))
    shaped.write.mode("overwrite").parquet(path)
    check_features(df.sparkSession.read.parquet(path), features)


def read_features(
    spark, path: str, rows: int | None = None, features: str = "features"
) -> DataFrame:
    df = spark.read.parquet(path)
    check_features(df, features, rows)
    return df
