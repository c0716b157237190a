"""Row filters with their statistics, and checks on inputs.

Rows are tagged once with the reasons they may be dropped for; the kept rows and
the per-split statistics are two reads of the same tags.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import quoted
from ..functions.text import as_text, prompt_hash, strip
from .joins import join_same, tag_members

#: Off: Spark never holds the features in one place. Set a number to refuse more.
DEFAULT_MAX_FEATURE_BYTES = 0


def limit_or_none(value: int | None) -> int | None:
    """Zero, negative and missing limits mean no limit."""
    if value is None:
        return None
    value = int(value)
    return value if value > 0 else None


@dataclass(frozen=True)
class PairFilters:
    max_prompt_chars: int | None = None
    max_completion_chars: int | None = None
    max_total_chars: int | None = None
    max_seq_length: int | None = None
    min_supervised_tokens: int | None = None

    @property
    def counts_tokens(self) -> bool:
        return self.max_seq_length is not None


def over(col: Column, limit: int | None) -> Column:
    limit = limit_or_none(limit)
    return F.lit(False) if limit is None else col > limit


def exceeds_chars(prompt: Column, completion: Column, limits: PairFilters) -> Column:
    """Length limits in characters."""
    prompt_chars, completion_chars = F.length(prompt), F.length(completion)
    return (
        over(prompt_chars, limits.max_prompt_chars)
        | over(completion_chars, limits.max_completion_chars)
        | over(prompt_chars + completion_chars, limits.max_total_chars)
    )


def prompt_hashes(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """The distinct hashes of normalised prompts."""
    text = as_text(quoted(prompt), df.schema[prompt].dataType)
    return df.select(prompt_hash(text).alias("prompt_hash")).distinct()


def supervision_counts(
    full_length: Column, prompt_length: Column, max_seq_length: int
) -> dict[str, Column]:
    """Tokens left after truncation and how many of them carry supervision."""
    truncated = F.least(full_length, F.lit(int(max_seq_length)))
    return {
        "full_length": full_length,
        "prompt_length": prompt_length,
        "truncated_length": truncated,
        "supervised_tokens": F.greatest(F.lit(0), truncated - prompt_length),
    }


def tag_pairs(
    df: DataFrame,
    filters: PairFilters,
    excluded: DataFrame | None = None,
    full_length: Column | None = None,
    prompt_length: Column | None = None,
) -> DataFrame:
    """Strip prompt and completion and add the columns the filters decide on.

    ``excluded`` is a set of hashes, see :func:`prompt_hashes`. Written once and
    measured, it is broadcast if its size allows. A larger set is joined by hash; a
    Bloom filter of it, of a bounded size, goes ahead, so that only rows it lets
    through are shuffled, and adaptive execution splits a prompt copied very often.
    """
    rest = [quoted(c) for c in df.columns if c not in ("prompt", "completion")]
    tagged = df.select(
        *rest,
        strip(F.coalesce("prompt", F.lit(""))).alias("prompt"),
        strip(F.coalesce("completion", F.lit(""))).alias("completion"),
    )
    if excluded is None:
        tagged = tagged.withColumn("is_excluded", F.lit(False))
    else:
        # Half the size as bytes.
        marked = excluded.select(F.unhex("prompt_hash").alias("_hash"))
        tagged = tagged.withColumn("_hash", F.unhex(prompt_hash(F.col("prompt"))))
        tagged = tag_members(tagged, marked, "_hash", "is_excluded").drop("_hash")
    limits = exceeds_chars(F.col("prompt"), F.col("completion"), filters)
    tagged = tagged.withColumn("over_char_limits", limits)
    if filters.counts_tokens:
        if full_length is None or prompt_length is None:
            raise ValueError("Token supervision needs the two token count columns.")
        # Spark runs a Python counter on every row whatever stands around it: the
        # caller hands it nulls for excluded rows, which it can skip.
        seen = ~F.col("is_excluded")
        counts = supervision_counts(
            F.when(seen, full_length),
            F.when(seen, prompt_length),
            filters.max_seq_length,
        )
        for name in ("full_length", "prompt_length"):
            tagged = tagged.withColumn(name, counts[name])
        left = supervision_counts(
            F.col("full_length"), F.col("prompt_length"), filters.max_seq_length
        )["supervised_tokens"]
        tagged = tagged.withColumn("supervised_tokens", F.when(seen, left))
        least = filters.min_supervised_tokens or 0
        short = F.coalesce(F.col("supervised_tokens") < least, F.lit(False))
        tagged = tagged.withColumn("below_supervision", short)
    else:
        tagged = tagged.withColumn("below_supervision", F.lit(False))
    dropped = (
        F.col("is_excluded") | F.col("over_char_limits") | F.col("below_supervision")
    )
    return tagged.withColumn("is_kept", ~dropped)


def kept_pairs(tagged: DataFrame, keep: Sequence[str] = ("split",)) -> DataFrame:
    names = [*keep, "prompt", "completion"]
    return tagged.where("is_kept").select(*[quoted(c) for c in names])


def stat_columns(filters: PairFilters, rows: Column) -> dict[str, Column]:
    """What is counted and seen of the tagged pairs for which ``rows`` holds. The
    names are fixed: other tools read them."""
    seen = rows & ~F.col("is_excluded")
    prompt_chars, completion_chars = F.length("prompt"), F.length("completion")

    def largest(value: Column) -> Column:
        return F.max(F.when(seen, value)).cast("bigint")

    columns = {
        "seen": F.count_if(rows),
        "kept": F.count_if(rows & F.col("is_kept")),
        "skipped": F.count_if(rows & ~F.col("is_kept")),
        "skipped_excluded_prompt_hash": F.count_if(rows & F.col("is_excluded")),
        "skipped_char_limits": F.count_if(seen & F.col("over_char_limits")),
        "skipped_token_supervision": F.count_if(seen & F.col("below_supervision")),
        "max_prompt_chars_seen": largest(prompt_chars),
        "max_completion_chars_seen": largest(completion_chars),
        "max_total_chars_seen": largest(prompt_chars + completion_chars),
    }
    if filters.counts_tokens:
        full, supervised = F.col("full_length"), F.col("supervised_tokens")
        columns |= {
            "max_sequence_tokens_seen": largest(full),
            "max_prompt_tokens_seen": largest(F.col("prompt_length")),
            "min_supervised_tokens_seen": F.min(F.when(rows, supervised)).cast("bigint"),
            "truncated_examples": F.count_if(seen & (full > filters.max_seq_length)),
            "zero_supervision_examples": F.count_if(seen & (supervised == 0)),
        }
    return columns


def filter_stats(
    tagged: DataFrame,
    filters: PairFilters,
    by: str = "split",
    splits: Sequence[str] = (),
) -> DataFrame:
    """Counts and extremes per split, in one map-side combined aggregation. Each of
    ``splits`` has a row: without pairs its counts are zero and nothing is seen."""
    columns = stat_columns(filters, F.lit(True))
    stats = tagged.groupBy(by).agg(*[c.alias(n) for n, c in columns.items()])
    if not splits:
        return stats
    wanted = tagged.sparkSession.createDataFrame([(s,) for s in splits], f"{by} string")
    # Bounded: one row per split.
    stats = join_same(wanted, stats, [by], "left", small=True)
    counts = [c for c in columns if not c.endswith("_seen")]
    return stats.fillna(0, subset=counts)


def _blank_reason() -> Column:
    no_prompt = strip(F.coalesce("prompt", F.lit(""))) == ""
    no_completion = strip(F.coalesce("completion", F.lit(""))) == ""
    return F.when(no_prompt, "empty prompt").when(no_completion, "empty completion")


def blank_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs unfit for modelling, with the reason."""
    return (
        pairs.withColumn("reason", _blank_reason())
        .where("reason is not null")
        .select("split", "pair_id", "reason")
    )


def check_pairs(
    pairs: DataFrame, splits: Sequence[str] = ("train", "valid", "test")
) -> None:
    """Raise unless every split has rows and no prompt or completion is blank."""
    wanted = pairs.where(F.col("split").isin(*splits))
    blank = F.when(_blank_reason().isNotNull(), F.col("pair_id"))
    checked = wanted.groupBy("split").agg(
        F.min(blank).alias("pair_id"),
        F.min_by(_blank_reason(), blank).alias("reason"),
    )
    found = {row["split"]: row for row in checked.collect()}
    missing = [s for s in splits if s not in found]
    if missing:
        raise ValueError(f"Data splits without records: {missing}")
    for split in splits:
        if found[split]["reason"] is not None:
            raise ValueError(
                f"Data row has {found[split]['reason']}: "
                f"{split} ({found[split]['pair_id']})"
            )


def feature_shape(df: DataFrame, features: str = "features") -> DataFrame:
    """Row count and the smallest and largest vector length, as one row."""
    size = F.size(quoted(features))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(size).alias("min_dim"),
        F.max(size).alias("max_dim"),
    )


def check_features(
    df: DataFrame, features: str = "features", rows: int | None = None
) -> tuple[int, int]:
    """Row count and dimension; raises where vectors differ in length or the row
    count is not the expected one."""
    shape = feature_shape(df, features).head()
    if shape["rows"] and shape["min_dim"] != shape["max_dim"]:
        raise ValueError(
            "Inconsistent feature dimensions: "
            f"{shape['min_dim']} to {shape['max_dim']}"
        )
    if rows is not None and shape["rows"] != rows:
        raise ValueError(f"Expected {rows} feature rows, found {shape['rows']}")
    return shape["rows"], shape["max_dim"] or 0


def check_feature_bytes(
    rows: int, dim: int, limit: int = DEFAULT_MAX_FEATURE_BYTES
) -> None:
    """Guard on unprojected features, four bytes per value; ``limit <= 0`` is off."""
    size = rows * dim * 4
    if 0 < limit < size:
        raise ValueError(
            f"Unprojected features take {size / 1024**3:.2f} GiB "
            f"({rows} x {dim}), limit {limit / 1024**3:.2f} GiB. "
            "Project them first."
        )
