"""Training logs: lines to events, events to run summaries.

Everything is expressions and aggregates, so the same functions serve a batch
table and a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import coerce_float, coerce_int, strip

# The three line formats.
PATTERNS = {
    "train": (
        r"^Iter (\d+): Train loss ([^,]+)"
        r"(?:, Learning Rate ([^,]+))?"
        r"(?:, It/sec ([^,]+), Tokens/sec ([^,]+))?"
        r"(?:, Trained Tokens (\d+))?"
        r"(?:, Peak mem ([^ ]+) GB)?$"
    ),
    "val": r"^Iter (\d+): Val loss ([^,]+)(?:, Val took ([^s]+)s)?$",
    "test": r"^Test loss ([^,]+), Test ppl (.+?)\.?$",
}
FIELDS = {
    "train": (
        "step",
        "train_loss",
        "learning_rate",
        "it_per_sec",
        "tokens_per_sec",
        "trained_tokens",
        "peak_mem_gb",
    ),
    "val": ("step", "val_loss", "val_seconds"),
    "test": ("test_loss", "test_ppl"),
}
WHOLE = ("step", "trained_tokens")
COLUMNS = tuple(dict.fromkeys(name for names in FIELDS.values() for name in names))

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event", T.StringType()),
        *[
            T.StructField(name, T.LongType() if name in WHOLE else T.DoubleType())
            for name in COLUMNS
        ],
        T.StructField("timestamp", T.StringType()),
        T.StructField("source_phase", T.StringType()),
    ]
)


SEPARATOR, MARK = "\x01", "\x02"


def _parts(line: Column) -> Column:
    """Event name and groups of the pattern a line matches, in an array of one;
    an empty array for other lines.

    Each pattern rewrites a matching line to its groups, after which the others
    fail at the first character: three regex calls per line in all. Groups that
    took no part come out empty.
    """
    for event, names in FIELDS.items():
        groups = [f"${at + 1}" for at in range(len(names))]
        found = MARK + SEPARATOR.join([event, *groups])
        line = F.regexp_replace(line, PATTERNS[event], found)
    parts = F.array(F.split(line, SEPARATOR))
    return F.filter(parts, lambda part: F.startswith(part[0], F.lit(MARK)))


def _field(name: str) -> Column:
    """A field from whichever event kind carries it; null on other lines."""
    found = [
        F.when(F.col("event") == event, F.get("_parts", F.lit(names.index(name) + 1)))
        for event, names in FIELDS.items()
        if name in names
    ]
    value = F.nullif(F.coalesce(*found), F.lit(""))
    return coerce_int(value) if name in WHOLE else coerce_float(value)


def parse_log_lines(
    lines: DataFrame, text: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """Train, val and test events with typed fields; other lines are dropped.

    They are dropped by ``explode`` rather than a filter, which the optimizer
    would push below the parsing and so make every line be parsed twice.
    """
    known = lines.select(*keep, F.explode(_parts(strip(F.col(text)))).alias("_parts"))
    known = known.withColumn("event", F.substring_index(F.get("_parts", F.lit(0)), MARK, -1))
    fields = [_field(name).alias(name) for name in COLUMNS]
    return known.select(*keep, "event", *fields)


def _latest(event: str, ordinal: str) -> Column:
    """The fields of the last event of a kind, as one struct."""
    fields = F.struct(*FIELDS[event])
    return F.max_by(fields, F.when(F.col("event") == event, F.col(ordinal)))


def best_validation(ordinal: str = "ordinal") -> Column:
    """Lowest validation loss with its step; the first one wins a tie."""
    usable = (F.col("event") == "val") & F.col("val_loss").isNotNull()
    order = F.when(usable, F.struct("val_loss", ordinal))
    return F.min_by(F.struct("val_loss", "step"), order)


def summarize_events(
    events: DataFrame, by: Sequence[str] = ("run_name",), ordinal: str = "ordinal"
) -> DataFrame:
    """One row per run: last train and test figures, peak memory, best
    validation. A plain aggregation: map-side combined, and usable on a stream."""
    peak = F.max(F.when(F.col("event") == "train", F.col("peak_mem_gb")))
    grouped = events.groupBy(*by).agg(
        _latest("train", ordinal).alias("_train"),
        _latest("test", ordinal).alias("_test"),
        best_validation(ordinal).alias("_val"),
        peak.alias("peak_mem_gb"),
    )
    return grouped.select(
        *by,
        F.col("_train.step").alias("last_train_step"),
        F.col("_train.train_loss").alias("last_train_loss"),
        F.col("_train.learning_rate").alias("last_learning_rate"),
        F.col("_train.it_per_sec").alias("last_it_per_sec"),
        F.col("_train.tokens_per_sec").alias("last_tokens_per_sec"),
        F.col("_train.trained_tokens").alias("trained_tokens"),
        "peak_mem_gb",
        F.col("_val.val_loss").alias("best_val_loss"),
        F.col("_val.step").alias("best_val_step"),
        F.col("_test.test_loss").alias("test_loss"),
        F.col("_test.test_ppl").alias("test_ppl"),
    )


def build_summaries(
    runs: DataFrame,
    metrics: DataFrame,
    sampling: DataFrame | None = None,
    task_eval: DataFrame | None = None,
    key: str = "run_name",
) -> DataFrame:
    """Run metadata with its metrics, sampling and evaluation as structs."""
    result = runs
    parts = {"metrics": metrics, "sampling": sampling, "task_eval": task_eval}
    for name, part in parts.items():
        if part is None:
            continue
        fields = [c for c in part.columns if c != key]
        packed = part.select(key, F.struct(*fields).alias(name))
        result = result.join(packed, key, "left")
    return result
