"""Comparing a full and a subset variant, and the runs they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import nested_text, resolve
from ..functions.text import dataset_key, strip
from .metrics import evaluate_scores, same_sign

KEYS = ["pair_id", "split"]
# Names that mean "nothing was done".
NO_OP_NAMES = ("", "-", "identity", "None", "none")


def comparison_rows(
    base: DataFrame, full: DataFrame, subset: DataFrame
) -> DataFrame:
    """Scores of three models side by side, joined by pair."""
    detail = [
        c
        for c in ("prompt_offset", "sequence_length", "completion_targets")
        if c in base.columns
    ]
    joined = (
        base.select(*KEYS, F.col("score").alias("base_score"), *detail)
        .join(full.select(*KEYS, F.col("score").alias("full_adapter_score")), KEYS)
        .join(subset.select(*KEYS, F.col("score").alias("subset_adapter_score")), KEYS)
    )
    joined = joined.withColumn(
        "full_score_delta", F.col("full_adapter_score") - F.col("base_score")
    ).withColumn(
        "subset_score_delta", F.col("subset_adapter_score") - F.col("base_score")
    )
    match = same_sign(F.col("full_score_delta"), F.col("subset_score_delta"))
    return joined.select(
        *KEYS,
        "base_score",
        "full_adapter_score",
        "subset_adapter_score",
        "full_score_delta",
        "subset_score_delta",
        (F.col("subset_score_delta") - F.col("full_score_delta")).alias("delta_error"),
        match.alias("delta_sign_match"),
        *detail,
    )


def incomplete_pairs(base: DataFrame, full: DataFrame, subset: DataFrame) -> DataFrame:
    """Pairs that not all three models have scored exactly once."""
    sides = {"base": base, "full": full, "subset": subset}
    tagged = None
    for name, side in sides.items():
        rows = side.select(*KEYS, F.lit(name).alias("model"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    counts = [F.count_if(F.col("model") == name).alias(name) for name in sides]
    wrong = " or ".join(f"{name} <> 1" for name in sides)
    return tagged.groupBy(*KEYS).agg(*counts).where(wrong)


def check_comparison(base: DataFrame, full: DataFrame, subset: DataFrame) -> None:
    first = incomplete_pairs(base, full, subset).head()
    if first is not None:
        raise ValueError(f"Comparison inputs differ in their pairs: {first}")


def summarize_comparison(rows: DataFrame, by=()) -> DataFrame:
    """Metric bundle of subset against full, and the mean deltas."""
    gap = F.col("subset_score_delta") - F.col("full_score_delta")
    return evaluate_scores(
        rows,
        by,
        true_delta="full_score_delta",
        pred_delta="subset_score_delta",
        true_score="full_adapter_score",
        pred_score="subset_adapter_score",
        extra=[
            F.avg("full_score_delta").alias("mean_full_score_delta"),
            F.avg("subset_score_delta").alias("mean_subset_score_delta"),
            F.avg(gap).alias("mean_delta_gap"),
        ],
    )


def file_name(path: Column) -> Column:
    trimmed = F.rtrim(F.coalesce(path, F.lit("")), F.lit("/"))
    return F.substring_index(trimmed, "/", -1)


def _string_list(df: DataFrame, *paths: str) -> Column:
    """First non-null list (or single name) among the paths, ``[identity]`` where
    there is none or it is empty."""
    found = []
    for path in paths:
        col, dtype = resolve(df, path)
        if isinstance(dtype, T.ArrayType):
            found.append(col.cast("array<string>"))
        elif isinstance(dtype, T.StringType):
            found.append(F.when(col.isNotNull(), F.array(col)))
    identity = F.array(F.lit("identity"))
    if not found:
        return identity
    names = F.coalesce(*found, identity)
    return F.when(F.size(names) == 0, identity).otherwise(names)


def _first_of(df: DataFrame, kind: str, *paths: str) -> Column:
    return F.coalesce(
        *[nested_text(df, path).try_cast(kind) for path in paths],
        F.lit(None).cast(kind),
    )


def selector_details(df: DataFrame, sampling: str = "sampling") -> list[Column]:
    """Flat columns of the nested sampling details, with their fall-backs."""
    context = f"{sampling}.selector_context"
    pipeline = f"{context}.selector_feature_pipeline"
    timing = f"{context}.selector_timing"
    params, dtype = resolve(df, f"{pipeline}.transformation_params")
    if dtype is None:
        params, dtype = resolve(df, f"{context}.selector_transformation_params")
    if isinstance(dtype, (T.StructType, T.MapType)):
        params = F.coalesce(F.to_json(params), F.lit("{}"))
    elif isinstance(dtype, T.StringType):
        params = F.coalesce(params, F.lit("{}"))
    else:
        params = F.lit("{}")
    name = file_name(nested_text(df, f"{sampling}.selector_path"))
    projection = _first_of(
        df, "string", f"{pipeline}.projection.name", f"{context}.selector_projection"
    )
    columns = [
        F.when(name == "", "-").otherwise(name).alias("selector"),
        _first_of(df, "bigint", f"{sampling}.max_example").alias("max_examples"),
        _string_list(
            df, f"{pipeline}.transformations", f"{context}.selector_transformations"
        ).alias("transformations"),
        params.alias("transformation_params"),
        F.coalesce(projection, F.lit("identity")).alias("projection"),
        _first_of(df, "bigint", f"{pipeline}.raw_feature_dim").alias("raw_feature_dim"),
        _first_of(df, "bigint", f"{pipeline}.transformed_feature_dim").alias(
            "transformed_feature_dim"
        ),
        _first_of(
            df,
            "bigint",
            f"{pipeline}.projection.output_dim",
            f"{context}.selector_projection_components",
        ).alias("projection_dim"),
    ]
    for field in ("selected_train_examples", "original_train_examples"):
        columns.append(_first_of(df, "bigint", f"{sampling}.{field}").alias(field))
    stages = {"selector_total_seconds": "total_seconds"}
    for stage in ("feature_extraction", "transformation", "projection", "kmeans"):
        stages[f"{stage}_seconds"] = f"{stage}_seconds"
    for name, field in stages.items():
        columns.append(_first_of(df, "double", f"{timing}.{field}").alias(name))
    return columns


def selection_method(
    selector: Column,
    transformations: Column,
    projection: Column,
    fallback: Column | None = None,
) -> Column:
    """``random``, ``kmeans`` with projection and transformations joined by
    ``+``, the fall-back, or the selector's file name."""
    active = F.filter(transformations, lambda name: ~name.isin(*NO_OP_NAMES))
    projected = F.when(~projection.isin(*NO_OP_NAMES), F.array(projection)).otherwise(
        F.array().cast("array<string>")
    )
    kmeans = F.array_join(
        F.concat(F.array(F.lit("kmeans")), projected, active), "+"
    )
    plain = F.regexp_replace(selector, r"\.py$", "")
    given = F.lit(None).cast("string") if fallback is None else fallback
    return (
        F.when(selector == "random.py", "random")
        .when(selector == "lora_ntk_kmeans.py", kmeans)
        .otherwise(
            F.coalesce(
                F.nullif(given, F.lit("")),
                F.when(selector != "", plain),
                F.lit("-"),
            )
        )
    )


def runs_for_adapters(adapters: DataFrame, runs: DataFrame) -> DataFrame:
    """For each ``adapter_path`` the run whose ``adapter_dir`` it is: the first in
    path order, null where there is none.

    Runs are reduced to one per directory before the join, so a directory that
    many runs share is no hot key.
    """
    first = (
        runs.where("adapter_dir is not null and adapter_dir <> ''")
        .groupBy(F.rtrim("adapter_dir", F.lit("/")).alias("_dir"))
        .agg(F.min_by("run_name", "run_dir").alias("run_name"))
    )
    wanted = adapters.withColumn("_dir", F.rtrim("adapter_path", F.lit("/")))
    return wanted.join(first, "_dir", "left").drop("_dir")


def _recency() -> Column:
    return F.struct(
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
            for c in ("updated_at", "created_at", "run_name")
        ]
    )


def newest_runs(runs: DataFrame) -> DataFrame:
    """Newest completed run per dataset key and model, map-side combined."""
    usable = (F.lower("status") == "completed") & (
        strip(F.coalesce("adapter_dir", F.lit(""))) != ""
    )
    newest = F.max(F.struct(_recency().alias("at"), "adapter_dir")).alias("newest")
    name = F.coalesce("dataset_name", F.lit(""))
    model = strip(F.coalesce("base_model", F.lit("")))
    return (
        runs.where(usable)
        .groupBy(dataset_key(name).alias("dataset_key"), model.alias("model"))
        .agg(newest)
    )


def resolve_adapters(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest completed run's ``adapter_dir`` for each request (dataset_name,
    base_model). A run without a model serves any model, a request without one
    takes any run.

    The runs are reduced to one per dataset key and model first; each request
    then meets at most two of those rows.
    """
    newest = newest_runs(runs)
    anything = newest.groupBy("dataset_key").agg(F.max("newest").alias("newest"))
    any_model = F.lit("\x00any")
    offers = newest.unionByName(anything.withColumn("model", any_model))
    model = strip(F.coalesce("base_model", F.lit("")))
    asked = F.when(model == "", F.array(any_model)).otherwise(
        F.array(model, F.lit(""))
    )
    wanted = requests.select("dataset_name", "base_model").distinct()
    wanted = wanted.select(
        "*", dataset_key(F.col("dataset_name")).alias("dataset_key"), F.explode(asked).alias("model")
    )
    found = wanted.join(offers, ["dataset_key", "model"], "left")
    return found.groupBy("dataset_name", "base_model").agg(
        F.max("newest").getField("adapter_dir").alias("adapter_dir")
    )
