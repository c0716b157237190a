"""Report tables over run summaries: filters, primary runs, grids and series.

Inputs are one row per run with nested structs; a field the schema lacks reads
as null. Best-of-group is a ``max_by`` aggregation rather than a window, so a
group that holds most runs is reduced on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import nested_number, nested_text, quoted, resolve
from ..functions.text import dataset_key, finite, short_model_name, strip
from .joins import join_unique
from .metrics import mae, rmse, sign_accuracy

# The order methods are shown in; others follow by name.
METHOD_ORDER = (
    "random",
    "kmeans",
    "kmeans+sign",
    "kmeans+thresholded_sign",
    "kmeans+sparse_random",
    "kmeans+sparse_random+sign",
    "kmeans+sparse_random+thresholded_sign",
)
PRIMARY_KEY = ["model_key", "dataset_key", "backend", "feature_label"]


def _text_or(df: DataFrame, path: str, default: str) -> Column:
    return F.coalesce(nested_text(df, path), F.lit(default))


def _filled_or_dash(df: DataFrame, path: str) -> Column:
    return F.coalesce(F.nullif(nested_text(df, path), F.lit("")), F.lit("-"))


def method_position(method: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(m) for m in METHOD_ORDER]), method)
    return F.when(place > 0, place).otherwise(len(METHOD_ORDER) + 1)


def _one_of(value: Column, allowed: Sequence[str] | None) -> Column:
    return value.isin(*allowed) if allowed else F.lit(True)


def dataset_keys(names: Sequence[str] | None) -> list[str]:
    return [
        name.strip().lower().translate(str.maketrans("", "", "-_ "))
        for name in names or []
    ]


def model_key(df: DataFrame) -> Column:
    name = F.nullif(nested_text(df, "base_model"), F.lit(""))
    return strip(F.coalesce(name, F.lit("-")))


def is_completed(df: DataFrame) -> Column:
    return F.lower(_text_or(df, "status", "completed")) == "completed"


def feature_label(df: DataFrame) -> Column:
    """First label present: direct, nested, that of the evaluation, else raw."""
    paths = (
        "feature_transform_label",
        "feature_transform.label",
        "eval.feature_transform.label",
    )
    return F.coalesce(
        *[F.nullif(nested_text(df, p), F.lit("")) for p in paths], F.lit("raw")
    )


def feature_key(label: Column) -> Column:
    """Label reduced to ``raw``, ``thresholded_sign``, ``sign`` or itself."""
    name = F.lower(strip(label))
    return (
        F.when(name.isin("", "raw", "identity"), "raw")
        .when(name.rlike("thresholded[_-]sign"), "thresholded_sign")
        .when((name == "sign") | name.endswith("/ sign"), "sign")
        .otherwise(name)
    )


def train_size(df: DataFrame) -> Column:
    size = nested_number(df, "split_sizes.train")
    return F.coalesce(size, F.lit(0.0)).cast("bigint")


def with_keys(runs: DataFrame) -> DataFrame:
    """Add the columns runs are grouped and filtered by."""
    return (
        runs.withColumn("model_key", model_key(runs))
        .withColumn("dataset_key", dataset_key(_text_or(runs, "dataset_name", "")))
        .withColumn("feature_label", feature_label(runs))
        .withColumn("train_size", train_size(runs))
    )


def filter_kernel_runs(
    runs: DataFrame,
    datasets: Sequence[str] | None = None,
    backends: Sequence[str] | None = None,
    base_models: Sequence[str] | None = None,
) -> DataFrame:
    """Completed runs of the wanted datasets, backends and models; an empty list
    means all."""
    keyed = with_keys(runs)
    models = [m.strip() or "-" for m in base_models or []]
    return keyed.where(
        is_completed(runs)
        & _one_of(F.col("dataset_key"), dataset_keys(datasets))
        & _one_of(_text_or(runs, "backend", ""), backends)
        & _one_of(F.col("model_key"), models)
    )


def mentions_adapter(df: DataFrame, needle: str | None) -> Column:
    """Substring of run name or adapter path, ignoring case."""
    if not needle:
        return F.lit(True)
    found = F.lit(False)
    for path in ("run_name", "adapter_path"):
        text = F.lower(_text_or(df, path, ""))
        found = found | F.contains(text, F.lit(needle.lower()))
    return found


def filter_comparisons(
    comparisons: DataFrame,
    datasets: Sequence[str] | None = None,
    methods: Sequence[str] | None = None,
    base_models: Sequence[str] | None = None,
) -> DataFrame:
    return comparisons.where(
        _one_of(_filled_or_dash(comparisons, "dataset_name"), datasets)
        & _one_of(_filled_or_dash(comparisons, "method"), methods)
        & _one_of(_filled_or_dash(comparisons, "base_model"), base_models)
    )


def best_per_group(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the highest ``order`` in each group, as an aggregation."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[quoted(c) for c in rest])
    best = df.groupBy(*keys).agg(F.max_by(packed, order).alias("_best"))
    return best.select(*keys, "_best.*").select(*[quoted(c) for c in df.columns])


def primary_runs(
    runs: DataFrame,
    datasets: Sequence[str] | None = None,
    backends: Sequence[str] | None = None,
    base_models: Sequence[str] | None = None,
) -> DataFrame:
    """Per model, dataset, backend and feature the run with the most training
    rows, then the higher test correlation, then the later name."""
    kept = filter_kernel_runs(runs, datasets, backends, base_models)
    kept = kept.withColumn("backend", _text_or(kept, "backend", ""))
    score = F.coalesce(
        nested_text(kept, "test_delta_pearson").try_cast("double"),
        F.lit(float("-inf")),
    )
    order = F.struct("train_size", score, _text_or(kept, "run_name", ""))
    return best_per_group(kept, PRIMARY_KEY, order)


def _values(given: Sequence[str] | None, df: DataFrame, column: str) -> Column:
    """The given names, or the distinct ones in ``df`` (a bounded label set)."""
    if given:
        return F.array(*[F.lit(v) for v in given])
    found = df.select(F.array_sort(F.collect_set(column))).scalar()
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("-")))


def comparison_grid(
    runs: DataFrame,
    datasets: Sequence[str] | None = None,
    backends: Sequence[str] | None = None,
    base_models: Sequence[str] | None = None,
) -> DataFrame:
    """Every wanted model, dataset, backend and feature, with the primary run or
    the status ``missing``."""
    chosen = primary_runs(runs, datasets, backends, base_models)
    one = runs.sparkSession.range(1)
    features = chosen.select(F.array_sort(F.collect_set("feature_label"))).scalar()
    raw = F.array(F.lit("raw"))
    grid = (
        one.select(F.explode(_values(base_models, chosen, "model_key")).alias("m"))
        .withColumn("dataset", F.explode(_values(datasets, chosen, "dataset_name")))
        .withColumn("backend", F.explode(_values(backends, chosen, "backend")))
        .select(
            strip(F.col("m")).alias("model_key"),
            "dataset",
            dataset_key(F.col("dataset")).alias("dataset_key"),
            "backend",
            F.explode(F.when(F.size(features) > 0, features).otherwise(raw)).alias(
                "feature_label"
            ),
        )
    )
    cells = chosen.select(*PRIMARY_KEY, *kernel_measures(chosen))
    joined = grid.join(cells, PRIMARY_KEY, "left")
    state = F.when(F.col("run_name").isNull(), "missing").otherwise("completed")
    return joined.withColumn("status", state)


def kernel_measures(df: DataFrame) -> list[Column]:
    return [
        nested_text(df, "run_name").alias("run_name"),
        train_size(df).alias("train_size"),
        nested_text(df, "feature_dim").try_cast("bigint").alias("feature_dim"),
        nested_number(df, "eval.test.delta.pearson").alias("test_delta_pearson"),
        nested_number(df, "eval.test.delta.spearman").alias("test_delta_spearman"),
        nested_number(df, "eval.test.delta.rmse").alias("test_rmse"),
        nested_number(df, "test_baseline_delta_rmse").alias("baseline_rmse"),
        nested_number(df, "test_delta_rmse_gain").alias("rmse_gain"),
        nested_number(df, "eval.test.delta.sign_accuracy").alias("test_sign_accuracy"),
        nested_number(df, "eval.test.adapter_score.pearson").alias(
            "test_adapter_pearson"
        ),
    ]


def fixed_point(value: Column, digits: int = 4) -> Column:
    """Number with fixed decimals, ``-`` where there is none.

    ``format_number`` rounds by the exact binary value, as Python and C do;
    ``format_string`` rounds the shortest decimal form.
    """
    text = F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
    return F.coalesce(text, F.lit("-"))


def run_table(runs: DataFrame) -> DataFrame:
    """Training runs as shown in the run report."""
    value = fixed_point(nested_number(runs, "task_eval.metric_value"), 3)
    name = _text_or(runs, "task_eval.metric_name", "metric")
    evaluated, dtype = resolve(runs, "task_eval")
    task = F.lit("-")
    if dtype is not None:
        task = F.when(evaluated.isNull(), "-").otherwise(F.concat_ws("=", name, value))
    return runs.select(
        _text_or(runs, "run_name", "-").alias("run"),
        short_model_name(nested_text(runs, "base_model")).alias("base_model"),
        _text_or(runs, "dataset_name", "-").alias("dataset"),
        _text_or(runs, "task", "-").alias("task"),
        _text_or(runs, "status", "-").alias("status"),
        fixed_point(nested_number(runs, "metrics.last_train_loss"), 3).alias(
            "last_train_loss"
        ),
        fixed_point(nested_number(runs, "metrics.best_val_loss"), 3).alias(
            "best_val_loss"
        ),
        fixed_point(nested_number(runs, "metrics.test_ppl"), 3).alias("test_ppl"),
        task.alias("task_metric"),
        fixed_point(nested_number(runs, "metrics.peak_mem_gb"), 3).alias("peak_mem_gb"),
        _text_or(runs, "adapter_dir", "-").alias("adapter"),
    )


def kernel_run_table(runs: DataFrame) -> DataFrame:
    return runs.select(
        _text_or(runs, "run_name", "-").alias("run"),
        short_model_name(nested_text(runs, "base_model")).alias("base_model"),
        _text_or(runs, "dataset_name", "-").alias("dataset"),
        _text_or(runs, "backend", "-").alias("backend"),
        feature_label(runs).alias("feature"),
        train_size(runs).alias("train_n"),
        _text_or(runs, "feature_dim", "-").alias("feature_dim"),
        *[
            fixed_point(nested_number(runs, path)).alias(name)
            for name, path in (
                ("valid_delta_pearson", "valid_delta_pearson"),
                ("test_delta_pearson", "test_delta_pearson"),
                ("test_delta_rmse", "eval.test.delta.rmse"),
                ("baseline_rmse", "test_baseline_delta_rmse"),
                ("rmse_gain", "test_delta_rmse_gain"),
            )
        ],
    )


def comparison_table(
    comparisons: DataFrame,
    datasets: Sequence[str] | None = None,
    methods: Sequence[str] | None = None,
    base_models: Sequence[str] | None = None,
) -> DataFrame:
    """Comparisons sorted by dataset, model, subset size, method and time."""
    kept = filter_comparisons(comparisons, datasets, methods, base_models)
    size = nested_number(kept, "selector_details.max_examples")
    order = [
        _filled_or_dash(kept, "dataset_name"),
        _filled_or_dash(kept, "base_model"),
        F.coalesce(size, F.lit(0.0)).cast("bigint"),
        _filled_or_dash(kept, "method"),
        _text_or(kept, "created_at", ""),
    ]
    places = [f"_order{n}" for n in range(len(order))]

    def count(path: str) -> Column:
        text = nested_text(kept, path)
        return F.coalesce(F.nullif(F.nullif(text, F.lit("0")), F.lit("")), F.lit("-"))

    def number(path: str) -> Column:
        return fixed_point(nested_number(kept, path))

    model = F.nullif(nested_text(kept, "base_model"), F.lit(""))
    # The rows' other fields are left behind before anything is sorted.
    shown = kept.select(
        _filled_or_dash(kept, "dataset_name").alias("dataset"),
        short_model_name(model).alias("base_model"),
        _filled_or_dash(kept, "method").alias("method"),
        count("selector_details.max_examples").alias("max_n"),
        count("selector_details.raw_feature_dim").alias("raw_dim"),
        count("selector_details.projection_dim").alias("projection_dim"),
        number("selector_details.selector_total_seconds").alias("selector_sec"),
        _filled_or_dash(kept, "split").alias("split"),
        count("num_examples").alias("examples"),
        number("metrics.delta.pearson").alias("delta_pearson"),
        number("metrics.delta.rmse").alias("delta_rmse"),
        number("metrics.delta.sign_accuracy").alias("sign_acc"),
        number("metrics.adapter_score.pearson").alias("adapter_pearson"),
        number("metrics.adapter_score.rmse").alias("adapter_rmse"),
        number("mean_delta_gap").alias("mean_delta_gap"),
        _filled_or_dash(kept, "subset_run_name").alias("subset_run"),
        *[column.alias(place) for column, place in zip(order, places, strict=True)],
    )
    return shown.orderBy(*places).drop(*places)


def _points(
    comparisons: DataFrame, x_path: str | None, y_path: str, named: bool = True
) -> DataFrame:
    """(method, x, y) with finite numbers; ``named`` drops rows without method."""
    x = F.lit(0.0) if x_path is None else nested_number(comparisons, x_path)
    points = comparisons.select(
        _filled_or_dash(comparisons, "method").alias("method"),
        x.alias("x"),
        nested_number(comparisons, y_path).alias("y"),
    )
    kept = points.where("x is not null and y is not null")
    return kept.where("method <> '-'") if named else kept


def mean_by_method(comparisons: DataFrame, metric: str) -> DataFrame:
    means = (
        _points(comparisons, None, metric)
        .groupBy("method")
        .agg(F.avg("y").alias("value"))
    )
    return means.orderBy(method_position(F.col("method")), "method")


def curve_by_method(comparisons: DataFrame, metric: str) -> DataFrame:
    """Mean per method and subset size."""
    points = _points(comparisons, "selector_details.max_examples", metric)
    return points.groupBy("method", F.col("x").alias("max_examples")).agg(
        F.avg("y").alias("value")
    )


def grid_by_subset_size(
    comparisons: DataFrame, metric: str, methods: Sequence[str] = METHOD_ORDER
) -> DataFrame:
    """Subset sizes down, methods across. Naming the methods keeps the pivot to
    one aggregation."""
    points = _points(comparisons, "selector_details.max_examples", metric)
    pivoted = points.groupBy(F.col("x").alias("max_examples")).pivot(
        "method", list(methods)
    )
    return pivoted.agg(F.avg("y"))


def selector_costs(comparisons: DataFrame) -> DataFrame:
    """Mean selector runtime and projected dimension per method."""
    rows = comparisons.select(
        _filled_or_dash(comparisons, "method").alias("method"),
        nested_number(comparisons, "selector_details.selector_total_seconds").alias(
            "seconds"
        ),
        nested_number(comparisons, "selector_details.projection_dim").alias("dim"),
    )
    kept = rows.where("method <> '-' and (seconds is not null or dim is not null)")
    means = kept.groupBy("method").agg(
        F.avg("seconds").alias("selector_seconds"), F.avg("dim").alias("projection_dim")
    )
    return means.orderBy(method_position(F.col("method")), "method")


def projection_tradeoff(comparisons: DataFrame) -> DataFrame:
    points = _points(
        comparisons,
        "selector_details.projection_dim",
        "metrics.delta.pearson",
        named=False,
    )
    return points.withColumnsRenamed({"x": "projection_dim", "y": "delta_pearson"})


def adapter_label(df: DataFrame) -> Column:
    """Run name up to ``-kernel``, with the feature unless it is raw."""
    name = F.coalesce(F.nullif(nested_text(df, "run_name"), F.lit("")), F.lit("kernel"))
    stem = F.substring_index(name, "-kernel", 1)
    label = feature_label(df)
    return F.when(label == "raw", stem).otherwise(F.concat_ws(" / ", stem, label))


def _krr_rmse(df: DataFrame) -> Column:
    return nested_number(df, "eval.test.delta.rmse")


def _baseline_rmse(df: DataFrame) -> Column:
    return F.coalesce(
        nested_number(df, "baseline.test.delta.rmse"),
        nested_number(df, "test_baseline_delta_rmse"),
    )


def _fit_size(df: DataFrame) -> Column:
    return nested_number(df, "split_sizes.train")


def series_by_train_size(runs: DataFrame, metric: str) -> DataFrame:
    points = runs.select(
        adapter_label(runs).alias("adapter"),
        _fit_size(runs).alias("train_size"),
        nested_number(runs, metric).alias("value"),
    )
    return points.where("train_size is not null and value is not null")


def gain_by_train_size(runs: DataFrame) -> DataFrame:
    points = runs.select(
        adapter_label(runs).alias("adapter"),
        _fit_size(runs).alias("train_size"),
        (_baseline_rmse(runs) - _krr_rmse(runs)).alias("rmse_gain"),
    )
    return points.where("train_size is not null and rmse_gain is not null")


def mean_rmse_by_train_size(runs: DataFrame) -> DataFrame:
    """Mean RMSE per feature and of the baseline: both series from one scan."""
    krr = F.struct(
        F.concat(F.lit("KRR "), feature_label(runs)).alias("series"),
        _krr_rmse(runs).alias("rmse"),
    )
    base = F.struct(
        F.lit("Train-mean baseline").alias("series"), _baseline_rmse(runs).alias("rmse")
    )
    points = runs.select(
        _fit_size(runs).alias("train_size"), F.inline(F.array(krr, base))
    )
    kept = points.where("train_size is not null and rmse is not null")
    return kept.groupBy("series", "train_size").agg(F.avg("rmse").alias("rmse"))


def mean_gain_by_feature(runs: DataFrame) -> DataFrame:
    points = runs.select(
        feature_label(runs).alias("feature"),
        _fit_size(runs).alias("train_size"),
        (_baseline_rmse(runs) - _krr_rmse(runs)).alias("gain"),
    )
    kept = points.where("train_size is not null and gain is not null")
    return kept.groupBy("feature", "train_size").agg(F.avg("gain").alias("rmse_gain"))


def mean_rmse(runs: DataFrame) -> DataFrame:
    """Overall means, two rows, or none unless both exist."""
    means = runs.agg(
        F.avg(_krr_rmse(runs)).alias("krr"), F.avg(_baseline_rmse(runs)).alias("base")
    ).where("krr is not null and base is not null")
    krr = F.struct(F.lit("KRR").alias("series"), F.col("krr").alias("rmse"))
    base = F.struct(
        F.lit("Train-mean baseline").alias("series"), F.col("base").alias("rmse")
    )
    return means.select(F.inline(F.array(krr, base)))


def latest_runs(
    runs: DataFrame,
    train_sizes: Sequence[int],
    features: Sequence[str],
    adapter_contains: str | None = None,
    experiment: str = "experiment",
) -> DataFrame:
    """Latest completed run per experiment, train size and feature key among the
    wanted ones."""
    size = nested_number(runs, "split_sizes.train").cast("bigint")
    keyed = runs.withColumns(
        {"train_size": size, "feature_key": feature_key(feature_label(runs))}
    )
    kept = keyed.where(
        is_completed(keyed)
        & mentions_adapter(keyed, adapter_contains)
        & F.col("train_size").isin(*train_sizes)
        & F.col("feature_key").isin(*features)
    )
    order = F.struct(_text_or(kept, "run_name", ""))
    return best_per_group(kept, [experiment, "train_size", "feature_key"], order)


def rmse_measures(df: DataFrame) -> list[Column]:
    """Gain, baseline RMSE and model RMSE, each falling back on the others."""
    krr = _krr_rmse(df)
    stored_gain = nested_number(df, "test_delta_rmse_gain")
    gain = F.coalesce(stored_gain, _baseline_rmse(df) - krr)
    baseline = F.coalesce(
        nested_number(df, "test_baseline_delta_rmse"),
        nested_number(df, "baseline.test.delta.rmse"),
        nested_number(df, "eval.test.baseline.delta.rmse"),
    )
    return [
        gain.alias("rmse_gain"),
        baseline.alias("baseline_rmse"),
        F.coalesce(krr, baseline - gain).alias("krr_rmse"),
    ]


def scatter_points(df: DataFrame, x: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs of finite numbers."""
    points = df.select(
        *[quoted(c) for c in keep], finite(quoted(x)).alias(x), finite(quoted(y)).alias(y)
    )
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def baseline_from_predictions(
    predictions: DataFrame, means: DataFrame | None = None
) -> DataFrame:
    """Train-mean baseline metrics per run and split from (run_name, split,
    score_delta); ``means`` (run_name, train_mean_delta) holds stored means that
    win over the computed ones."""
    value = finite(F.col("score_delta"))
    finite_rows = predictions.select("run_name", "split", value.alias("score_delta"))
    finite_rows = finite_rows.where("score_delta is not null")
    computed = (
        finite_rows.where("split = 'train'")
        .groupBy("run_name")
        .agg(F.avg("score_delta").alias("_computed"))
    )
    if means is not None:
        computed = (
            means.select("run_name", F.col("train_mean_delta").alias("_stored"))
            .join(computed, "run_name", "full")
            .select("run_name", F.coalesce("_stored", "_computed").alias("_computed"))
        )
    known = computed.withColumnRenamed("_computed", "train_mean_delta").where(
        "train_mean_delta is not null"
    )
    joined = join_unique(finite_rows, known, ["run_name"], "inner")
    true, guess = F.col("score_delta"), F.col("train_mean_delta")
    return joined.groupBy("run_name", "split").agg(
        F.max(guess).alias("train_mean_delta"),
        F.lit(0.0).alias("delta_pearson"),
        F.lit(0.0).alias("delta_spearman"),
        rmse(true, guess).alias("delta_rmse"),
        mae(true, guess).alias("delta_mae"),
        sign_accuracy(true, guess).alias("delta_sign_accuracy"),
    )


def baseline_errors(predictions: DataFrame, means: DataFrame) -> DataFrame:
    """RMSE of the train mean per run and split, from one aggregate over the
    predictions: the variance plus the squared distance of the means. ``means`` as
    in :func:`baseline_from_predictions`."""
    value = finite(F.col("score_delta"))
    moments = predictions.groupBy("run_name", "split").agg(
        F.avg(value).alias("_mean"), F.var_pop(value).alias("_variance")
    )
    moments = moments.where("_mean is not null")
    train = moments.where("split = 'train'")
    known = (
        means.select("run_name", F.col("train_mean_delta").alias("_stored"))
        .join(train.select("run_name", F.col("_mean").alias("_train")), "run_name", "full")
        .select("run_name", F.coalesce("_stored", "_train").alias("_guess"))
    )
    apart = F.col("_mean") - F.col("_guess")
    return moments.join(known, "run_name").select(
        "run_name", "split", F.sqrt(F.col("_variance") + apart * apart).alias("rmse")
    )


def attach_baselines(runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Baseline RMSE and RMSE gain on valid and test, stored values first,
    recomputed from predictions where there are none."""
    stored = nested_number(runs, "baseline.train_mean_delta")
    means = runs.select("run_name", stored.alias("train_mean_delta"))
    errors = baseline_errors(predictions, means)
    by_run = errors.groupBy("run_name").agg(
        *[
            F.max(F.when(F.col("split") == split, F.col("rmse"))).alias(f"_{split}")
            for split in ("valid", "test")
        ]
    )
    joined = runs.join(by_run, "run_name", "left")
    result = {}
    for split in ("valid", "test"):
        baseline = F.coalesce(
            nested_number(runs, f"eval.{split}.baseline.delta.rmse"),
            F.col(f"_{split}"),
        )
        result[f"{split}_baseline_delta_rmse"] = baseline
        model = nested_number(runs, f"eval.{split}.delta.rmse")
        result[f"{split}_delta_rmse_gain"] = baseline - model
    kept = [quoted(c) for c in runs.columns if c not in result]
    return joined.select(*kept, *[col.alias(name) for name, col in result.items()])

