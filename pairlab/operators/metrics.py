"""Numeric agreement metrics as aggregate expressions, and their bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import average_ranks

DELTA_METRICS = ("pearson", "spearman", "rmse", "mae", "sign_accuracy")
SCORE_METRICS = ("pearson", "spearman", "rmse", "mae")


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation, 0.0 where there is no row or a side is constant."""
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    value = F.try_divide(F.covar_pop(x, y), spread)
    return F.coalesce(F.when(~flat, value), F.lit(0.0))


def rmse(x: Column, y: Column) -> Column:
    return F.sqrt(F.avg((x - y) * (x - y)))


def mae(x: Column, y: Column) -> Column:
    return F.avg(F.abs(x - y))


def same_sign(x: Column, y: Column) -> Column:
    """Equal signs; zero only matches zero and NaN matches nothing."""
    known = ~(F.isnan(x) | F.isnan(y))
    return known & (F.signum(x) == F.signum(y))


def sign_accuracy(x: Column, y: Column) -> Column:
    return F.avg(same_sign(x, y).cast("double"))


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def with_ranks(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Average ranks as ``{column}__rank``."""
    return average_ranks(df, {name: f"{name}__rank" for name in columns}, by)


def spearman(x: str, y: str) -> Column:
    """Spearman correlation over columns that ``with_ranks`` has ranked."""
    return pearson(F.col(f"{x}__rank"), F.col(f"{y}__rank"))


def _metric(kind: str, x: str, y: str) -> Column:
    if kind == "spearman":
        return spearman(x, y)
    build = {
        "pearson": pearson,
        "rmse": rmse,
        "mae": mae,
        "sign_accuracy": sign_accuracy,
    }[kind]
    return build(_double(x), _double(y))


def bundle(x: str, y: str, prefix: str, kinds: Sequence[str]) -> list[Column]:
    return [_metric(kind, x, y).alias(f"{prefix}_{kind}") for kind in kinds]


def evaluate_bundles(
    df: DataFrame,
    by: Sequence[str],
    bundles: Mapping[str, tuple[str, str, Sequence[str]]],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Several bundles (prefix to true column, predicted column and metrics) in
    one aggregation; each column is ranked once."""
    names = dict.fromkeys(
        name
        for x, y, kinds in bundles.values()
        if "spearman" in kinds
        for name in (x, y)
    )
    ranked = with_ranks(df, list(names), by)
    measures = [
        measure
        for prefix, (x, y, kinds) in bundles.items()
        for measure in bundle(x, y, prefix, kinds)
    ]
    count = F.count(F.lit(1)).alias("num_examples")
    return ranked.groupBy(*by).agg(count, *measures, *extra)


def evaluate_scores(
    df: DataFrame,
    by: Sequence[str] = (),
    true_delta: str = "score_delta",
    pred_delta: str = "predicted_score_delta",
    true_score: str = "adapter_score",
    pred_score: str = "predicted_adapter_score",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Metric bundle per group: five metrics on the deltas, four on the scores."""
    bundles = {
        "delta": (true_delta, pred_delta, DELTA_METRICS),
        "adapter_score": (true_score, pred_score, SCORE_METRICS),
    }
    return evaluate_bundles(df, by, bundles, extra)


def rmse_gain(baseline: Column, model: Column) -> Column:
    """How much lower the model's RMSE is than the baseline's."""
    return baseline - model
