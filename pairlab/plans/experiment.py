"""Whole runs: predict score deltas, compare variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import check_features, check_pairs
from ..operators.krr import LinearKernelModel, fit
from ..operators.metrics import DELTA_METRICS, SCORE_METRICS, evaluate_bundles
from ..operators.projection import project_features
from ..operators.scoring import KEYS, details_of, predicted_scores, with_baseline
from ..operators.splits import subset_pairs
from ..operators.vectors import FEATURES, Chain
from ..session import materialize

SPLITS = ("train", "valid", "test")


@dataclass(frozen=True)
class ExperimentConfig:
    run_name: str = "kernel"
    dataset_name: str = ""
    base_model: str = ""
    backend: str = "lora_ntk"
    method: str = "nystrom"
    ridge_lambda: float = 0.01
    rank: int = 32
    num_landmarks: int = 32
    #: Rows to take of each split; zero takes all.
    limits: Mapping[str, int] = field(default_factory=lambda: dict.fromkeys(SPLITS, 0))
    seed: int = 42
    transformations: Sequence[str] | str | None = None
    transformation_params: Mapping[str, Mapping] | None = None
    threshold: float | None = None
    projection: str | None = None
    projection_components: int | None = None
    task: str = ""
    target: str = "score_delta"
    adapter_path: str = ""


@dataclass(frozen=True)
class ExperimentResult:
    model: LinearKernelModel
    predictions: DataFrame
    metrics: DataFrame
    summary: DataFrame


def _evaluate(predictions: DataFrame) -> DataFrame:
    """Metrics per split of the model and of the train-mean baseline."""
    bundles = {}
    for prefix, guess in (("", "predicted"), ("baseline_", "baseline")):
        bundles[f"{prefix}delta"] = (
            "score_delta",
            f"{guess}_score_delta",
            DELTA_METRICS,
        )
        bundles[f"{prefix}adapter_score"] = (
            "adapter_score",
            f"{guess}_adapter_score",
            SCORE_METRICS,
        )
    measured = evaluate_bundles(predictions, ["split"], bundles)
    gain = F.col("baseline_delta_rmse") - F.col("delta_rmse")
    return measured.withColumn("delta_rmse_gain", gain)


def _check_complete(joined: DataFrame) -> None:
    sides = ("base_score", "adapter_score", "features")
    gaps = joined.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in sides]).head()
    missing = {side: gaps[side] for side in sides if gaps[side]}
    if missing:
        raise ValueError(f"Chosen pairs lack values: {missing}")


def run_experiment(
    pairs: DataFrame,
    base_scores: DataFrame,
    adapter_scores: DataFrame,
    features: DataFrame,
    config: ExperimentConfig = ExperimentConfig(),
) -> ExperimentResult:
    """Fit the score deltas of the train split on the features, predict every
    split, and measure against the mean train delta.

    ``pairs`` has pair_id, split, prompt, completion; scores have pair_id, split,
    score; ``features`` has pair_id, split, features. All are joined by pair.
    """
    chosen = subset_pairs(pairs, config.limits, config.seed)
    check_pairs(chosen, SPLITS)
    chosen = chosen.select(*KEYS)
    chain = Chain.read(
        config.transformations, config.transformation_params, config.threshold
    )
    column = chain.over(F.col("features"))
    vectors = features.join(chosen, KEYS, "left_semi").select(
        *KEYS, column.cast(FEATURES).alias("features")
    )
    vectors = project_features(
        vectors, config.projection, config.projection_components, config.seed
    )
    base = base_scores.select(
        *KEYS, F.col("score").alias("base_score"), *details_of(base_scores)
    )
    adapter = adapter_scores.select(*KEYS, F.col("score").alias("adapter_score"))
    joined = chosen
    for side in (base, adapter, vectors):
        joined = joined.join(side, KEYS, "left")
    delta = F.col("adapter_score") - F.col("base_score")
    # Read by the checks, the fit and the predictions: written once.
    joined = materialize(joined.withColumn("score_delta", delta))
    _check_complete(joined)
    _, dim = check_features(joined)
    joined = with_baseline(joined)
    options = {"ridge_lambda": config.ridge_lambda, "key": ("pair_id",)}
    if config.method.lower() == "nystrom":
        options |= {
            "num_landmarks": config.num_landmarks,
            "rank": config.rank,
            "seed": config.seed,
        }
    model = fit(joined.where("split = 'train'"), config.method, **options)
    predicted = model.predict(joined).drop("features")
    predictions = materialize(predicted_scores(predicted))
    metrics = _evaluate(predictions)
    mean = predictions.select(F.max("baseline_score_delta")).scalar()
    summary = _summary(config, model, metrics, dim, chain, mean)
    return ExperimentResult(model, predictions, metrics, summary)


def _summary(
    config: ExperimentConfig,
    model: LinearKernelModel,
    metrics: DataFrame,
    dim: int,
    chain: Chain,
    train_mean: Column,
) -> DataFrame:
    """One row shaped like the run summaries the reports read."""

    def of(split: str, name: str):
        return F.max(F.when(F.col("split") == split, F.col(name)))

    def bundle(split: str, prefix: str):
        names = [c for c in metrics.columns if c.startswith(f"{prefix}_")]
        if prefix == "delta":
            names.remove("delta_rmse_gain")
        fields = [of(split, c).alias(c.removeprefix(f"{prefix}_")) for c in names]
        return F.struct(*fields)

    evaluation = F.struct(
        *[
            F.struct(
                bundle(split, "delta").alias("delta"),
                bundle(split, "adapter_score").alias("adapter_score"),
                F.struct(bundle(split, "baseline_delta").alias("delta")).alias(
                    "baseline"
                ),
            ).alias(split)
            for split in SPLITS
        ]
    )
    label = chain.label
    measures = [
        of(split, name).alias(f"{split}_{name}")
        for split in ("valid", "test")
        for name in ("baseline_delta_rmse", "delta_rmse_gain", "delta_pearson")
    ]
    adapter = [
        of(split, "adapter_score_pearson").alias(f"{split}_adapter_pearson")
        for split in ("valid", "test")
    ]
    sizes = F.struct(*[of(s, "num_examples").alias(s) for s in SPLITS])
    return metrics.agg(
        F.lit(config.run_name).alias("run_name"),
        F.lit("completed").alias("status"),
        F.lit(config.dataset_name).alias("dataset_name"),
        F.lit(config.base_model).alias("base_model"),
        F.lit(config.backend).alias("backend"),
        F.lit(label).alias("feature_transform_label"),
        F.lit(dim).alias("feature_dim"),
        F.lit(model.method).alias("fit_method"),
        F.lit(config.task).alias("task"),
        F.lit(config.target).alias("target"),
        F.lit(config.adapter_path).alias("adapter_path"),
        F.create_map(
            *[F.lit(x) for k, v in model.details.items() for x in (k, int(v))]
        ).alias("fit_details"),
        F.struct(F.max(train_mean).alias("train_mean_delta")).alias("baseline"),
        sizes.alias("split_sizes"),
        *measures,
        *adapter,
        evaluation.alias("eval"),
    )
