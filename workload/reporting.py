"""Report tables over kernel runs and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import reports

from .registry import query, table


def kernel_runs(spark, sf_dir):
    """One kernel run per order, nested like a run summary with its evaluation."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    price = F.col("o_totalprice")
    status = F.col("o_orderstatus")
    train = (key % 4 + 1) * 16

    def some(condition, value):
        return F.when(condition, value)

    delta = F.struct(
        some(key % 13 > 0, price / 1000000).alias("rmse"),
        (price / 600000).alias("pearson"),
        (price / 700000).alias("spearman"),
        some(key % 17 > 0, price / 800000).alias("sign_accuracy"),
    )
    test = F.struct(
        delta.alias("delta"),
        F.struct((price / 900000).alias("pearson")).alias("adapter_score"),
        F.struct(
            F.struct(some(key % 2 == 0, price / 950000).alias("rmse")).alias("delta")
        ).alias("baseline"),
    )
    valid = F.struct(
        F.struct((price / 1100000).alias("rmse")).alias("delta"),
        F.struct(
            F.struct(some(key % 6 == 0, price / 990000).alias("rmse")).alias("delta")
        ).alias("baseline"),
    )
    direct = (
        F.when(key % 5 == 1, "sign")
        .when(key % 5 == 2, "thresholded_sign(threshold=0.01)")
        .when(key % 5 == 3, "")
        .when(key % 5 == 4, "raw")
    )
    nested = some(key % 5 == 3, F.lit("Identity / sign"))
    evaluated = some(key % 10 == 0, F.lit("Sign "))
    return table(spark, sf_dir, "orders").select(
        F.concat(
            F.concat(F.lit("run"), F.lpad(key.cast("string"), 8, "0")), F.lit("-kernel-n"), train.cast("string")
        ).alias("run_name"),
        F.when(status == "F", "completed")
        .when(status == "O", "Completed")
        .otherwise("failed")
        .alias("status"),
        F.col("o_orderpriority").alias("dataset_name"),
        F.concat(F.lit("org/model_"), (cust % 3).cast("string")).alias("base_model"),
        F.when(cust % 2 == 0, "lora_ntk").otherwise("full_ntk").alias("backend"),
        F.concat(F.lit("adapters/"), "o_orderpriority").alias("adapter_path"),
        F.concat(F.lit("set"), (cust % 5).cast("string")).alias("experiment"),
        (key % 3 * 64).alias("feature_dim"),
        F.struct(train.alias("train")).alias("split_sizes"),
        direct.alias("feature_transform_label"),
        F.struct(nested.alias("label")).alias("feature_transform"),
        some(key % 11 > 0, price / 500000).alias("test_delta_pearson"),
        (price / 400000).alias("valid_delta_pearson"),
        some(key % 3 > 0, price / 850000).alias("test_baseline_delta_rmse"),
        some(key % 4 == 0, price / 10000000).alias("test_delta_rmse_gain"),
        F.struct(
            some(key % 9 == 0, price / 3000000).alias("train_mean_delta"),
            F.struct(
                F.struct(some(key % 7 > 0, price / 870000).alias("rmse")).alias("delta")
            ).alias("test"),
        ).alias("baseline"),
        F.struct(
            test.alias("test"),
            valid.alias("valid"),
            F.struct(evaluated.alias("label")).alias("feature_transform"),
        ).alias("eval"),
    )


KERNEL_RUNS = """
    select *, case direct when '' then coalesce(nested, evaluated, 'raw')
                else coalesce(direct, nested, evaluated, 'raw') end as label
    from (
      select o_orderkey as k, printf('run%08d', o_orderkey) || '-kernel-n'
               || ((o_orderkey % 4 + 1) * 16) as run_name,
             case o_orderstatus when 'F' then 'completed' when 'O' then 'Completed'
               else 'failed' end as status,
             o_orderpriority as dataset_name, 'org/model_' || (o_custkey % 3)
               as base_model,
             case when o_custkey % 2 = 0 then 'lora_ntk' else 'full_ntk' end as backend,
             'set' || (o_custkey % 5) as experiment,
             o_orderkey % 3 * 64 as feature_dim, (o_orderkey % 4 + 1) * 16 as train,
             case o_orderkey % 5 when 1 then 'sign'
               when 2 then 'thresholded_sign(threshold=0.01)' when 3 then ''
               when 4 then 'raw' end as direct,
             case when o_orderkey % 5 = 3 then 'Identity / sign' end as nested,
             case when o_orderkey % 10 = 0 then 'Sign ' end as evaluated,
             case when o_orderkey % 11 > 0 then o_totalprice / 500000 end
               as test_delta_pearson,
             o_totalprice / 400000 as valid_delta_pearson,
             case when o_orderkey % 3 > 0 then o_totalprice / 850000 end as flat_base,
             case when o_orderkey % 4 = 0 then o_totalprice / 10000000 end as flat_gain,
             case when o_orderkey % 9 = 0 then o_totalprice / 3000000 end as stored_mean,
             case when o_orderkey % 7 > 0 then o_totalprice / 870000 end as nested_base,
             case when o_orderkey % 13 > 0 then o_totalprice / 1000000 end as krr,
             o_totalprice / 600000 as pearson, o_totalprice / 700000 as spearman,
             case when o_orderkey % 17 > 0 then o_totalprice / 800000 end as sign_acc,
             o_totalprice / 900000 as adapter_pearson,
             case when o_orderkey % 2 = 0 then o_totalprice / 950000 end as eval_base,
             o_totalprice / 1100000 as valid_rmse,
             case when o_orderkey % 6 = 0 then o_totalprice / 990000 end as valid_base
      from orders)
    """

KEYED = f"""
    select *, regexp_replace(lower(dataset_name), '[-_ ]', '', 'g') as dkey,
           coalesce(nested_base, flat_base) as base,
           case when lower(trim(label)) in ('', 'raw', 'identity') then 'raw'
                when label like '%thresholded_sign%' then 'thresholded_sign'
                when lower(trim(label)) = 'sign' or lower(trim(label)) like '%/ sign'
                  then 'sign'
                else lower(trim(label)) end as fkey
    from ({KERNEL_RUNS})
    """


@query(
    "filter_kernel_runs",
    f"""
    select run_name from ({KEYED}) where lower(status) = 'completed'
      and dkey in ('1urgent', '4notspecified') and backend = 'lora_ntk'
      and base_model in ('org/model_0', 'org/model_2')
    """,
)
def filter_kernel_runs(spark, sf_dir):
    kept = reports.filter_kernel_runs(
        kernel_runs(spark, sf_dir),
        ["1-Urgent", "4 not_specified"],
        ["lora_ntk"],
        ["org/model_0", " org/model_2"],
    )
    return kept.select("run_name")


@query(
    "mentions_adapter",
    f"select run_name from ({KERNEL_RUNS}) where dataset_name = '1-URGENT'",
)
def mentions_adapter(spark, sf_dir):
    runs = kernel_runs(spark, sf_dir)
    return runs.where(reports.mentions_adapter(runs, "S/1-urg")).select("run_name")


@query(
    "feature_labels",
    f"select run_name, label, fkey as feature_key from ({KEYED})",
)
def feature_labels(spark, sf_dir):
    runs = kernel_runs(spark, sf_dir)
    label = reports.feature_label(runs)
    return runs.select(
        "run_name", label.alias("label"), reports.feature_key(label).alias("feature_key")
    )


PRIMARY = f"""
    select * from ({KEYED}) where lower(status) = 'completed'
    qualify row_number() over (partition by base_model, dkey, backend, label
      order by train desc, coalesce(test_delta_pearson, '-inf'::double) desc,
               run_name desc) = 1
    """


@query(
    "primary_runs",
    f"""
    select base_model as model_key, dkey as dataset_key, backend, label as feature_label,
           train::bigint as train_size, run_name
    from ({PRIMARY})
    """,
)
def primary_runs(spark, sf_dir):
    chosen = reports.primary_runs(kernel_runs(spark, sf_dir))
    return chosen.select(*reports.PRIMARY_KEY, "train_size", "run_name")


@query(
    "comparison_grid",
    f"""
    with p as (select * from ({PRIMARY}) where dkey in ('1urgent', 'mmlu')
                 and backend in ('lora_ntk', 'other')),
    grid as (
      select m as model_key, d as dataset, b as backend, f as feature_label
      from (select distinct base_model as m from p),
           (values ('1-URGENT'), ('MMLU')) x(d), (values ('lora_ntk'), ('other')) y(b),
           (select distinct label as f from p))
    select model_key, dataset, regexp_replace(lower(dataset), '[-_ ]', '', 'g')
             as dataset_key, g.backend, feature_label, p.run_name,
           p.train::bigint as train_size, p.feature_dim::bigint as feature_dim,
           p.pearson as test_delta_pearson, p.spearman as test_delta_spearman,
           p.krr as test_rmse, p.flat_base as baseline_rmse, p.flat_gain as rmse_gain,
           p.sign_acc as test_sign_accuracy, p.adapter_pearson as test_adapter_pearson,
           case when p.run_name is null then 'missing' else 'completed' end as status
    from grid g left join p on p.base_model = g.model_key and p.backend = g.backend
      and p.label = g.feature_label
      and p.dkey = regexp_replace(lower(g.dataset), '[-_ ]', '', 'g')
    """,
)
def comparison_grid(spark, sf_dir):
    return reports.comparison_grid(
        kernel_runs(spark, sf_dir), ["1-URGENT", "MMLU"], ["lora_ntk", "other"]
    )


def shown(value: str, digits: int = 4) -> str:
    return f"case when {value} is null then '-' else printf('%.{digits}f', {value}) end"


@query(
    "kernel_run_table",
    f"""
    select run_name as run, replace(base_model, 'org/', '') as base_model,
           dataset_name as dataset, backend, label as feature, train::bigint as train_n,
           feature_dim::varchar as feature_dim,
           {shown('valid_delta_pearson')} as valid_delta_pearson,
           {shown('test_delta_pearson')} as test_delta_pearson,
           {shown('krr')} as test_delta_rmse, {shown('flat_base')} as baseline_rmse,
           {shown('flat_gain')} as rmse_gain
    from ({KERNEL_RUNS})
    """,
)
def kernel_run_table(spark, sf_dir):
    return reports.kernel_run_table(kernel_runs(spark, sf_dir))


ADAPTER = """
    split_part(run_name, '-kernel', 1)
      || case when label = 'raw' then '' else ' / ' || label end
    """


@query(
    "series_by_train_size",
    f"""
    select {ADAPTER} as adapter, train::double as train_size, krr as value
    from ({KERNEL_RUNS}) where krr is not null
    """,
)
def series_by_train_size(spark, sf_dir):
    return reports.series_by_train_size(
        kernel_runs(spark, sf_dir), "eval.test.delta.rmse"
    )


@query(
    "gain_by_train_size",
    f"""
    select {ADAPTER} as adapter, train::double as train_size, base - krr as rmse_gain
    from ({KEYED}) where base - krr is not null
    """,
)
def gain_by_train_size(spark, sf_dir):
    return reports.gain_by_train_size(kernel_runs(spark, sf_dir))


@query(
    "mean_rmse_by_train_size",
    f"""
    select series, train::double as train_size, round(avg(rmse), 9) as rmse from (
      select 'KRR ' || label as series, train, krr as rmse from ({KEYED})
      union all select 'Train-mean baseline', train, base from ({KEYED}))
    where rmse is not null group by series, train
    """,
)
def mean_rmse_by_train_size(spark, sf_dir):
    found = reports.mean_rmse_by_train_size(kernel_runs(spark, sf_dir))
    return found.withColumn("rmse", F.round("rmse", 9))


@query(
    "mean_gain_by_feature",
    f"""
    select label as feature, train::double as train_size,
           round(avg(base - krr), 9) as rmse_gain
    from ({KEYED}) where base - krr is not null group by label, train
    """,
)
def mean_gain_by_feature(spark, sf_dir):
    found = reports.mean_gain_by_feature(kernel_runs(spark, sf_dir))
    return found.withColumn("rmse_gain", F.round("rmse_gain", 9))


@query(
    "mean_rmse",
    f"""
    select 'KRR' as series, round(avg(krr), 9) as rmse from ({KEYED})
    union all select 'Train-mean baseline', round(avg(base), 9) from ({KEYED})
    """,
)
def mean_rmse(spark, sf_dir):
    found = reports.mean_rmse(kernel_runs(spark, sf_dir))
    return found.withColumn("rmse", F.round("rmse", 9))


@query(
    "latest_runs",
    f"""
    select experiment, train::bigint as train_size, fkey as feature_key,
           max(run_name) as run_name
    from ({KEYED}) where lower(status) = 'completed' and train in (16, 48)
      and fkey in ('raw', 'sign') and dataset_name like '%MEDIUM%'
    group by experiment, train, fkey
    """,
)
def latest_runs(spark, sf_dir):
    found = reports.latest_runs(
        kernel_runs(spark, sf_dir), [16, 48], ["raw", "sign"], "medium"
    )
    return found.select("experiment", "train_size", "feature_key", "run_name")


@query(
    "rmse_measures",
    f"""
    select run_name, coalesce(flat_gain, base - krr) as rmse_gain,
           coalesce(flat_base, nested_base, eval_base) as baseline_rmse,
           coalesce(krr, coalesce(flat_base, nested_base, eval_base)
             - coalesce(flat_gain, base - krr)) as krr_rmse
    from ({KEYED})
    """,
)
def rmse_measures(spark, sf_dir):
    runs = kernel_runs(spark, sf_dir)
    return runs.select("run_name", *reports.rmse_measures(runs))


def line_predictions(spark, sf_dir):
    """Predictions of each run: the order's lines, split by return flag."""
    flag = F.col("l_returnflag")
    split = F.when(flag == "A", "train").when(flag == "N", "valid").otherwise("test")
    train = (F.col("l_orderkey") % 4 + 1) * 16
    run = F.concat(
        F.lit("run"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit("-kernel-n"), train.cast("string")
    )
    delta = F.when(F.col("l_quantity") == 50, float("nan")).otherwise(
        F.col("l_discount") - F.col("l_tax")
    )
    return table(spark, sf_dir, "lineitem").select(
        run.alias("run_name"),
        split.alias("split"),
        delta.alias("score_delta"),
        (F.col("l_extendedprice") / 100000).alias("predicted_score_delta"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )


LINE_PREDICTIONS = """
    select l_orderkey as k, case l_returnflag when 'A' then 'train' when 'N' then 'valid'
             else 'test' end as split,
           case when l_quantity <> 50 then l_discount - l_tax end as delta,
           l_extendedprice / 100000 as predicted,
           l_orderkey, l_linenumber, l_partkey
    from lineitem
    """


@query(
    "baseline_metrics",
    f"""
    with p as (select * from ({LINE_PREDICTIONS}) where delta is not null),
    m as (select k, avg(delta) as mean from p where split = 'train' group by k)
    select printf('run%08d', k) || '-kernel-n' || ((k % 4 + 1) * 16) as run_name, split,
           round(max(mean), 9) as train_mean_delta, 0.0::double as delta_pearson,
           0.0::double as delta_spearman, round(sqrt(avg((delta - mean) ** 2)), 9)
             as delta_rmse,
           round(avg(abs(delta - mean)), 9) as delta_mae
    from p join m using (k) group by k, split
    """,
)
def baseline_metrics(spark, sf_dir):
    found = reports.baseline_from_predictions(line_predictions(spark, sf_dir))
    found = found.drop("delta_sign_accuracy")
    for name in ("train_mean_delta", "delta_rmse", "delta_mae"):
        found = found.withColumn(name, F.round(name, 9))
    return found


@query(
    "attach_baselines",
    f"""
    with p as (select * from ({LINE_PREDICTIONS}) where delta is not null),
    r as ({KERNEL_RUNS}),
    m as (select r.k, coalesce(any_value(stored_mean), avg(delta)) as mean
          from r left join p on p.k = r.k and p.split = 'train' group by r.k),
    b as (
      select k, sqrt(avg((delta - mean) ** 2) filter (split = 'valid')) as v,
             sqrt(avg((delta - mean) ** 2) filter (split = 'test')) as t
      from p join m using (k) group by k)
    select run_name, round(coalesce(valid_base, v), 9) as valid_baseline_delta_rmse,
           round(coalesce(valid_base, v) - valid_rmse, 9) as valid_delta_rmse_gain,
           round(coalesce(eval_base, t), 9) as test_baseline_delta_rmse,
           round(coalesce(eval_base, t) - krr, 9) as test_delta_rmse_gain
    from r left join b using (k)
    """,
)
def attach_baselines(spark, sf_dir):
    found = reports.attach_baselines(
        kernel_runs(spark, sf_dir), line_predictions(spark, sf_dir)
    )
    names = [
        f"{split}_{name}"
        for split in ("valid", "test")
        for name in ("baseline_delta_rmse", "delta_rmse_gain")
    ]
    return found.select("run_name", *[F.round(n, 9).alias(n) for n in names])


@query(
    "scatter_points",
    f"""
    select l_orderkey, l_linenumber, l_partkey, delta as score_delta,
           predicted as predicted_score_delta
    from ({LINE_PREDICTIONS}) where delta is not null
    """,
)
def scatter_points(spark, sf_dir):
    return reports.scatter_points(
        line_predictions(spark, sf_dir),
        "score_delta",
        "predicted_score_delta",
        ["l_orderkey", "l_linenumber", "l_partkey"],
    )


def comparisons(spark, sf_dir):
    """One comparison summary per line item."""
    number, price = F.col("l_linenumber"), F.col("l_extendedprice")
    method = (
        F.when(number == 1, "random")
        .when(number == 2, "kmeans")
        .when(number == 3, "kmeans+sign")
        .when(number == 4, "kmeans+sparse_random+sign")
        .when(number == 5, "zeta")
        .when(number == 6, "")
    )
    sizes = F.when(F.col("l_suppkey") % 3 == 0, 128).when(
        F.col("l_suppkey") % 3 == 1, 512
    )
    details = F.struct(
        sizes.alias("max_examples"),
        F.lit(4096).alias("raw_feature_dim"),
        F.when(F.col("l_partkey") % 7 > 0, F.col("l_partkey") % 7 * 256).alias(
            "projection_dim"
        ),
        F.when(F.col("l_partkey") % 5 > 0, price / 1000).alias("selector_total_seconds"),
    )
    metrics = F.struct(
        F.struct(
            F.when(F.col("l_quantity") < 49, F.col("l_discount") * 10).alias("pearson"),
            F.col("l_tax").alias("rmse"),
            (F.col("l_quantity") / 50).alias("sign_accuracy"),
        ).alias("delta"),
        F.struct(
            F.col("l_discount").alias("pearson"), (price / 100000).alias("rmse")
        ).alias("adapter_score"),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset_name"),
        F.concat(F.lit("org/"), "l_linestatus").alias("base_model"),
        method.alias("method"),
        F.lit("test").alias("split"),
        F.col("l_orderkey").alias("num_examples"),
        details.alias("selector_details"),
        metrics.alias("metrics"),
        (F.col("l_discount") - F.col("l_tax")).alias("mean_delta_gap"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("created_at"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias(
            "subset_run_name"
        ),
    )


COMPARISONS = """
    select l_returnflag as dataset_name, 'org/' || l_linestatus as base_model,
           case l_linenumber when 1 then 'random' when 2 then 'kmeans'
             when 3 then 'kmeans+sign' when 4 then 'kmeans+sparse_random+sign'
             when 5 then 'zeta' else '-' end as method,
           case l_suppkey % 3 when 0 then 128 when 1 then 512 end as max_examples,
           case when l_partkey % 7 > 0 then l_partkey % 7 * 256 end as projection_dim,
           case when l_partkey % 5 > 0 then l_extendedprice / 1000 end as seconds,
           case when l_quantity < 49 then l_discount * 10 end as pearson,
           l_tax as rmse, l_quantity / 50 as sign_acc, l_discount as adapter_pearson,
           l_extendedprice / 100000 as adapter_rmse, l_discount - l_tax as gap,
           l_orderkey as num_examples,
           l_orderkey || '-' || l_partkey || '-' || l_suppkey as subset_run_name
    from lineitem
    """


@query(
    "filter_comparisons",
    f"""
    select subset_run_name from ({COMPARISONS})
    where dataset_name in ('A', 'R') and method = '-' and base_model = 'org/F'
    """,
)
def filter_comparisons(spark, sf_dir):
    kept = reports.filter_comparisons(
        comparisons(spark, sf_dir), ["A", "R"], ["-"], ["org/F"]
    )
    return kept.select("subset_run_name")


@query(
    "comparison_table",
    f"""
    select dataset_name as dataset, replace(base_model, 'org/', '') as base_model, method,
           coalesce(max_examples::varchar, '-') as max_n, '4096' as raw_dim,
           coalesce(projection_dim::varchar, '-') as projection_dim,
           {shown('seconds')} as selector_sec, 'test' as split,
           case num_examples when 0 then '-' else num_examples::varchar end as examples,
           {shown('pearson')} as delta_pearson, {shown('rmse')} as delta_rmse,
           {shown('sign_acc')} as sign_acc, {shown('adapter_pearson')} as adapter_pearson,
           {shown('adapter_rmse')} as adapter_rmse, {shown('gap')} as mean_delta_gap,
           subset_run_name as subset_run
    from ({COMPARISONS})
    """,
)
def comparison_table(spark, sf_dir):
    return reports.comparison_table(comparisons(spark, sf_dir))


@query(
    "mean_by_method",
    f"""
    select method, round(avg(pearson), 9) as value from ({COMPARISONS})
    where method <> '-' and pearson is not null group by method
    """,
)
def mean_by_method(spark, sf_dir):
    means = reports.mean_by_method(comparisons(spark, sf_dir), "metrics.delta.pearson")
    return means.withColumn("value", F.round("value", 9))


@query(
    "curve_by_method",
    f"""
    select method, max_examples::double as max_examples,
           round(avg(adapter_rmse), 9) as value
    from ({COMPARISONS}) where method <> '-' and max_examples is not null
    group by method, max_examples
    """,
)
def curve_by_method(spark, sf_dir):
    curve = reports.curve_by_method(
        comparisons(spark, sf_dir), "metrics.adapter_score.rmse"
    )
    return curve.withColumn("value", F.round("value", 9))


@query(
    "grid_by_subset_size",
    f"""
    select max_examples::double as max_examples,
           round(avg(rmse) filter (method = 'random'), 9) as random,
           round(avg(rmse) filter (method = 'kmeans'), 9) as kmeans,
           round(avg(rmse) filter (method = 'zeta'), 9) as zeta
    from ({COMPARISONS}) where method <> '-' and max_examples is not null
    group by max_examples
    """,
)
def grid_by_subset_size(spark, sf_dir):
    methods = ["random", "kmeans", "zeta"]
    grid = reports.grid_by_subset_size(
        comparisons(spark, sf_dir), "metrics.delta.rmse", methods
    )
    return grid.select("max_examples", *[F.round(m, 9).alias(m) for m in methods])


@query(
    "selector_costs",
    f"""
    select method, round(avg(seconds), 6) as selector_seconds,
           round(avg(projection_dim), 6) as projection_dim
    from ({COMPARISONS}) where method <> '-' group by method
    """,
)
def selector_costs(spark, sf_dir):
    costs = reports.selector_costs(comparisons(spark, sf_dir))
    return costs.select(
        "method",
        F.round("selector_seconds", 6).alias("selector_seconds"),
        F.round("projection_dim", 6).alias("projection_dim"),
    )


@query(
    "projection_tradeoff",
    f"""
    select method, projection_dim::double as projection_dim, pearson as delta_pearson
    from ({COMPARISONS}) where projection_dim is not null and pearson is not null
    """,
)
def projection_tradeoff(spark, sf_dir):
    return reports.projection_tradeoff(comparisons(spark, sf_dir))
