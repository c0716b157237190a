"""Comparison of variants and lookup of the runs behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import compare

from .fitting import ORDER_SCORES, bundle_sql, order_scores, ranks_sql, rounded, scores
from .registry import query, table

COMPARED = f"""
    select pair_id, split, base_score, adapter_score as full_adapter_score,
           adapter_score - a * 0.125::double as subset_adapter_score,
           adapter_score - base_score as full_score_delta,
           adapter_score - a * 0.125::double - base_score as subset_score_delta
    from ({ORDER_SCORES})
    """


def three_scores(spark, sf_dir):
    df = order_scores(spark, sf_dir).withColumn(
        "subset_score", F.col("adapter_score") - F.col("a") * 0.125
    )
    names = ("base_score", "adapter_score", "subset_score")
    return [scores(df, name) for name in names]


@query(
    "comparison_rows",
    f"""
    select *, subset_score_delta - full_score_delta as delta_error,
           sign(full_score_delta) = sign(subset_score_delta) as delta_sign_match
    from ({COMPARED})
    """,
)
def comparison_rows(spark, sf_dir):
    return compare.comparison_rows(*three_scores(spark, sf_dir))


@query(
    "incomplete_pairs",
    f"""
    select pair_id, split, 1::bigint as base, 0::bigint as "full", 1::bigint as subset
    from ({COMPARED}) where split = 'valid'
    """,
)
def incomplete_pairs(spark, sf_dir):
    base, full, subset = three_scores(spark, sf_dir)
    return compare.incomplete_pairs(base, full.where("split <> 'valid'"), subset)


NAMES = (
    "full_score_delta",
    "subset_score_delta",
    "full_adapter_score",
    "subset_adapter_score",
)


@query(
    "comparison_summary",
    f"""
    select split, count(*) as num_examples,
           {bundle_sql("full_score_delta", "subset_score_delta", "delta", True)},
           {bundle_sql("full_adapter_score", "subset_adapter_score", "adapter_score",
                       False)},
           round(avg(full_score_delta), 6) as mean_full_score_delta,
           round(avg(subset_score_delta), 6) as mean_subset_score_delta,
           round(avg(subset_score_delta - full_score_delta), 6) as mean_delta_gap
    from (select *, {ranks_sql(NAMES, "split")} from ({COMPARED}))
    group by split
    """,
)
def comparison_summary(spark, sf_dir):
    rows = compare.comparison_rows(*three_scores(spark, sf_dir))
    return rounded(compare.summarize_comparison(rows, ["split"]), ["split"])


def sampled_runs(spark, sf_dir):
    """One training run per part, with nested sampling details."""
    part = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    kind = key % 4
    path = (
        F.when(kind == 0, "selectors/random.py")
        .when(kind == 1, "selectors/lora_ntk_kmeans.py")
        .when(kind == 2, F.concat(F.lit("own/"), F.lower("p_type"), F.lit(".py")))
    )
    names = (
        F.when(size % 3 == 0, F.array(F.lit("sign"), F.lit("identity")))
        .when(size % 3 == 1, F.array().cast("array<string>"))
    )
    pipeline = F.struct(
        names.alias("transformations"),
        F.struct(
            F.struct((size / 64).alias("threshold")).alias("thresholded_sign")
        ).alias("transformation_params"),
        (size * 100).alias("raw_feature_dim"),
        F.when(size % 7 > 0, size * 90).alias("transformed_feature_dim"),
        F.struct(
            F.when(size % 2 == 0, "sparse_random").alias("name"),
            F.when(size % 2 == 0, size * 8).alias("output_dim"),
        ).alias("projection"),
    )
    context = F.struct(
        F.when(size % 6 != 4, pipeline).alias("selector_feature_pipeline"),
        F.lit("thresholded_sign").alias("selector_transformations"),
        F.when(size % 5 == 0, "own_projection").alias("selector_projection"),
        F.lit(16).alias("selector_projection_components"),
        F.struct(
            (F.col("p_retailprice") / 100).alias("total_seconds"),
            (F.col("p_retailprice") / 200).alias("kmeans_seconds"),
            (F.col("p_retailprice") / 400).alias("feature_extraction_seconds"),
            (F.col("p_retailprice") / 800).alias("transformation_seconds"),
            (F.col("p_retailprice") / 1600).alias("projection_seconds"),
        ).alias("selector_timing"),
    )
    sampling = F.struct(
        path.alias("selector_path"),
        F.lit(512).alias("max_example"),
        context.alias("selector_context"),
        F.lit(500).alias("selected_train_examples"),
        (key + 1000).alias("original_train_examples"),
    )
    return part.select("p_partkey", sampling.alias("sampling"), "p_brand")


DETAILS = """
    select p_partkey, p_brand,
           case p_partkey % 4 when 0 then 'random.py' when 1 then 'lora_ntk_kmeans.py'
             when 2 then lower(p_type) || '.py' else '-' end as selector,
           512::bigint as max_examples,
           case when p_size % 6 = 4 or p_size % 3 = 2 then ['thresholded_sign']
                when p_size % 3 = 0 then ['sign', 'identity'] else ['identity'] end
             as names,
           case when p_size % 6 <> 4 and p_size % 2 = 0 then 'sparse_random'
                when p_size % 5 = 0 then 'own_projection' else 'identity' end
             as projection,
           case when p_size % 6 <> 4 then p_size * 100 end::bigint as raw_feature_dim,
           case when p_size % 6 <> 4 and p_size % 2 = 0 then p_size * 8 else 16 end
             ::bigint as projection_dim,
           500::bigint as selected_train_examples,
           (p_partkey + 1000)::bigint as original_train_examples,
           p_retailprice / 100 as selector_total_seconds,
           p_retailprice / 200 as kmeans_seconds,
           case when p_size % 6 <> 4 then '{"thresholded_sign":{"threshold":'
             || (p_size / 64.0)::double || '}}' else '{}' end as transformation_params,
           case when p_size % 6 <> 4 and p_size % 7 > 0 then p_size * 90 end::bigint
             as transformed_feature_dim,
           p_retailprice / 400 as feature_extraction_seconds,
           p_retailprice / 800 as transformation_seconds,
           p_retailprice / 1600 as projection_seconds
    from part
    """


@query(
    "selector_details",
    f"""
    select * exclude (names, p_brand), array_to_string(names, ',') as transformations
    from ({DETAILS})
    """,
)
def selector_details(spark, sf_dir):
    runs = sampled_runs(spark, sf_dir)
    flat = runs.select("p_partkey", *compare.selector_details(runs))
    return flat.withColumn("transformations", F.array_join("transformations", ","))


@query(
    "selection_methods",
    f"""
    select p_partkey, case selector when 'random.py' then 'random'
             when 'lora_ntk_kmeans.py' then array_to_string(['kmeans']
               || case when projection = 'identity' then [] else [projection] end
               || list_filter(names, lambda n: n <> 'identity'), '+')
             else case when p_brand = 'Brand#7' then 'given'
               when selector = '-' then '-' else replace(selector, '.py', '') end end
             as method
    from ({DETAILS})
    """,
)
def selection_methods(spark, sf_dir):
    runs = sampled_runs(spark, sf_dir)
    flat = runs.select("p_partkey", "p_brand", *compare.selector_details(runs))
    given = F.when(F.col("p_brand") == "Brand#7", "given").otherwise("")
    method = compare.selection_method(
        F.col("selector"), F.col("transformations"), F.col("projection"), given
    )
    return flat.select("p_partkey", method.alias("method"))


def training_runs(spark, sf_dir):
    """One training run per order; customers share adapter directories."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run-"), key.cast("string")).alias("run_name"),
        F.concat(F.lit("runs/"), F.lpad(key.cast("string"), 9, "0")).alias("run_dir"),
        F.concat(F.lit("adapters/"), cust.cast("string"), F.lit("/")).alias(
            "adapter_dir"
        ),
        F.when(status == "F", "completed").when(status == "O", "Completed").otherwise(
            "failed"
        ).alias("status"),
        F.col("o_orderpriority").alias("dataset_name"),
        F.when(cust % 4 < 3, F.concat(F.lit("org/model-"), (cust % 4).cast("string")))
        .otherwise("")
        .alias("base_model"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
        F.date_format("o_orderdate", "yyyy").alias("created_at"),
    )


TRAINING_RUNS = """
    select 'run-' || o_orderkey as run_name, printf('runs/%09d', o_orderkey) as run_dir,
           'adapters/' || o_custkey || '/' as adapter_dir,
           case o_orderstatus when 'F' then 'completed' when 'O' then 'Completed'
             else 'failed' end as status,
           o_orderpriority as dataset_name,
           case when o_custkey % 4 < 3 then 'org/model-' || (o_custkey % 4) else '' end
             as base_model,
           strftime(o_orderdate, '%Y-%m-%d') as updated_at,
           strftime(o_orderdate, '%Y') as created_at
    from orders
    """


@query(
    "runs_for_adapters",
    f"""
    select c_custkey, 'adapters/' || c_custkey as adapter_path,
           arg_min(run_name, run_dir) as run_name
    from customer left join ({TRAINING_RUNS})
      on adapter_dir = 'adapters/' || c_custkey || '/'
    group by c_custkey
    """,
)
def runs_for_adapters(spark, sf_dir):
    path = F.concat(F.lit("adapters/"), F.col("c_custkey").cast("string"))
    wanted = table(spark, sf_dir, "customer").select(
        "c_custkey", path.alias("adapter_path")
    )
    return compare.runs_for_adapters(wanted, training_runs(spark, sf_dir))


REQUESTS = """
    select distinct lower(replace(o_orderpriority, ' ', '_')) as dataset_name,
           case when o_custkey % 5 < 4 then 'org/model-' || (o_custkey % 5) else '' end
             as base_model
    from orders
    """


@query(
    "resolve_adapters",
    f"""
    with requests as ({REQUESTS}),
    runs as (select *, regexp_replace(lower(trim(dataset_name)), '[-_ ]', '', 'g') as key
             from ({TRAINING_RUNS}) where lower(status) = 'completed')
    select q.dataset_name, q.base_model, arg_max(r.adapter_dir,
             {{'u': r.updated_at, 'c': r.created_at, 'n': r.run_name}}) as adapter_dir
    from requests q left join runs r
      on r.key = regexp_replace(q.dataset_name, '[-_ ]', '', 'g')
      and (q.base_model = '' or r.base_model = '' or r.base_model = q.base_model)
    group by q.dataset_name, q.base_model
    """,
)
def resolve_adapters(spark, sf_dir):
    cust = F.col("o_custkey")
    model = F.when(cust % 5 < 4, F.concat(F.lit("org/model-"), (cust % 5).cast("string")))
    requests = table(spark, sf_dir, "orders").select(
        F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("_"))).alias(
            "dataset_name"
        ),
        model.otherwise("").alias("base_model"),
    )
    return compare.resolve_adapters(requests.distinct(), training_runs(spark, sf_dir))
