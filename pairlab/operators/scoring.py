"""Scores per pair: user scorers, token losses, deltas and prediction rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORE_SCHEMA = (
    "pair_id string, split string, score double, "
    "prompt_offset int, sequence_length int, completion_targets int"
)
KEYS = ["pair_id", "split"]


def score_pairs(pairs: DataFrame, make_scorer: Callable[[], Callable]) -> DataFrame:
    """Apply a scorer to every pair.

    ``make_scorer`` runs once per task, so a model is loaded once; the scorer it
    returns maps (prompt, completion) to (score, prompt_offset, sequence_length,
    completion_targets).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            scored = [scorer(p, c) for p, c in zip(frame["prompt"], frame["completion"])]
            names = ["score", "prompt_offset", "sequence_length", "completion_targets"]
            values = pd.DataFrame(scored, columns=names, index=frame.index)
            yield pd.concat([frame[KEYS], values], axis=1)

    return pairs.select(*KEYS, "prompt", "completion").mapInPandas(run, SCORE_SCHEMA)


def extract_features(
    pairs: DataFrame, make_extractor: Callable[[], Callable]
) -> DataFrame:
    """Apply a feature extractor to every pair; vectors are flattened floats."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make_extractor()
        for frame in frames:
            vectors = [
                np.asarray(extractor(p, c), dtype=np.float32).reshape(-1)
                for p, c in zip(frame["prompt"], frame["completion"])
            ]
            yield frame[KEYS].assign(features=vectors)

    schema = "pair_id string, split string, features array<float>"
    return pairs.select(*KEYS, "prompt", "completion").mapInPandas(run, schema)


def completion_scores(losses: DataFrame) -> DataFrame:
    """Mean log-likelihood over the completion tokens of each pair.

    Rows are (pair_id, step, token_loss, prompt_offset) with one-based steps; a
    step belongs to the completion from ``prompt_offset`` on. Pairs without such
    a step have a null score and ``supervised_tokens`` 0.
    """
    counted = F.col("step") >= F.col("prompt_offset")
    tokens = F.count_if(counted)
    total = F.sum(F.when(counted, F.col("token_loss").cast("double")))
    return losses.groupBy("pair_id").agg(
        tokens.alias("supervised_tokens"),
        F.when(tokens > 0, -total / tokens).alias("score"),
    )


def split_unscored(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored pairs and the rejects that have no supervised token."""
    return scores.where("supervised_tokens > 0"), scores.where("supervised_tokens = 0")


def score_deltas(base: DataFrame, adapter: DataFrame) -> DataFrame:
    """Variant minus base score, joined by pair."""
    detail = details_of(base)
    left = base.select(*KEYS, F.col("score").alias("base_score"), *detail)
    right = adapter.select(*KEYS, F.col("score").alias("adapter_score"))
    delta = (F.col("adapter_score") - F.col("base_score")).alias("score_delta")
    return left.join(right, KEYS).select(
        *KEYS, "base_score", "adapter_score", delta, *detail
    )


def unmatched_pairs(base: DataFrame, adapter: DataFrame) -> DataFrame:
    """Pairs scored by one side only."""
    only_base = base.join(adapter, KEYS, "left_anti").select(*KEYS)
    only_adapter = adapter.join(base, KEYS, "left_anti").select(*KEYS)
    return only_base.withColumn("missing_in", F.lit("adapter")).unionByName(
        only_adapter.withColumn("missing_in", F.lit("base"))
    )


def with_baseline(deltas: DataFrame, train: str = "train") -> DataFrame:
    """Add the mean train delta as ``baseline_score_delta``: a one-value
    subquery, not a join."""
    mean = deltas.where(F.col("split") == train).select(F.avg("score_delta")).scalar()
    return deltas.withColumn("baseline_score_delta", mean)


# What a score row may carry besides the score.
DETAILS = ("prompt_offset", "sequence_length", "completion_targets")


def details_of(scores: DataFrame) -> list[str]:
    return [c for c in DETAILS if c in scores.columns]


def predicted_scores(rows: DataFrame) -> DataFrame:
    """Predicted and baseline scores beside the true ones, from rows that hold
    scores, deltas and the predicted delta."""
    base = F.col("base_score")
    columns = [
        *KEYS,
        "base_score",
        "adapter_score",
        "score_delta",
        "predicted_score_delta",
        (base + F.col("predicted_score_delta")).alias("predicted_adapter_score"),
    ]
    if "baseline_score_delta" in rows.columns:
        columns += [
            "baseline_score_delta",
            (base + F.col("baseline_score_delta")).alias("baseline_adapter_score"),
        ]
    return rows.select(*columns, *details_of(rows))


def prediction_rows(deltas: DataFrame, predictions: DataFrame) -> DataFrame:
    """:func:`predicted_scores` of predictions that come as a table of their own,
    joined by pair."""
    predicted = predictions.select(*KEYS, "predicted_score_delta")
    return predicted_scores(deltas.join(predicted, KEYS, "inner"))
