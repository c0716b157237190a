"""Kernel ridge regression and score deltas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairlab.operators import krr, scoring
from pairlab.plans.experiment import ExperimentConfig, run_experiment

from .registry import query, table
from .splitting import ranked
from .vectors import DIM, features

LANDMARKS = f"""
    select vec_id as row_id, embedding::double[] as embedding
    from ({ranked('embeddings', 'vec_id')}) where r <= 32
    """


@query("select_landmarks", f"select row_id from ({LANDMARKS})")
def select_landmarks(spark, sf_dir):
    df = features(spark, sf_dir).select("row_id")
    return krr.select_landmarks(df, 32, ["row_id"])


@query(
    "linear_kernel",
    f"""
    select e.vec_id as row_id,
           (row_number() over (partition by e.vec_id order by l.row_id) - 1)::int
             as landmark,
           round(list_inner_product(e.embedding::double[], l.embedding), 9) as kernel
    from embeddings e cross join ({LANDMARKS}) l
    """,
)
def linear_kernel(spark, sf_dir):
    df = features(spark, sf_dir).select("row_id", "features")
    chosen = krr.select_landmarks(df, 32, ["row_id"])
    points = krr.collect_landmarks(chosen, ["row_id"])
    kernel = krr.linear_kernel(df, points)
    cells = kernel.select("row_id", F.posexplode("kernel").alias("landmark", "kernel"))
    return cells.withColumn("kernel", F.round("kernel", 9))


@query(
    "predict_linear",
    f"""
    select vec_id as row_id, round(list_inner_product(embedding::double[],
             [(j + 1) / {DIM}.0 for j in range({DIM})]::double[]), 9) as predicted
    from embeddings
    """,
)
def predict_linear(spark, sf_dir):
    df = features(spark, sf_dir).select("row_id", "features")
    weights = np.arange(1, DIM + 1)[:, None] / DIM
    model = krr.LinearKernelModel("dual", weights, 0.0)
    found = model.predict(df, names=["predicted"])
    return found.select("row_id", F.round("predicted", 9).alias("predicted"))


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def priced_lines(spark, sf_dir):
    """Two features and a target per line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.array("l_discount", "l_tax").alias("features"),
        (F.col("l_extendedprice") / 100000).alias("score_delta"),
        *LINE_KEY,
        "l_returnflag",
    )


# Ridge on two features in closed form; ``rows`` has a, b, y.
CLOSED_FORM = """
    sums as (
      select sum(a * a) + count(*) * {ridge} as aa, sum(a * b) as ab,
             sum(b * b) + count(*) * {ridge} as bb, sum(a * y) as ay, sum(b * y) as by_
      from rows {where}),
    weights as (
      select (bb * ay - ab * by_) / (aa * bb - ab * ab) as wa,
             (aa * by_ - ab * ay) / (aa * bb - ab * ab) as wb
      from sums)
    """

RIDGE = f"""
    with rows as (select l_discount as a, l_tax as b, l_extendedprice / 100000 as y,
                    l_returnflag from lineitem),
    {CLOSED_FORM.format(ridge=0.01, where="")}
    select l_returnflag, count(*) as n, round(avg(a * wa + b * wb), 6) as predicted,
           round(max(a * wa + b * wb), 6) as highest
    from rows, weights group by l_returnflag
    """


def by_flag(model, rows):
    found = model.predict(rows.select("features", "l_returnflag"), names=["predicted"])
    return found.groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.round(F.avg("predicted"), 6).alias("predicted"),
        F.round(F.max("predicted"), 6).alias("highest"),
    )


@query("fit_dual", RIDGE)
def fit_dual(spark, sf_dir):
    rows = priced_lines(spark, sf_dir)
    return by_flag(krr.fit_dual(rows, ridge_lambda=0.01, key=LINE_KEY), rows)


@query(
    "fit_dual_nonfinite",
    RIDGE.replace("l_discount as a", "case when l_linenumber % 5 > 0 then l_discount else 0.0::double end as a"),
)
def fit_dual_nonfinite(spark, sf_dir):
    """A feature that is NaN in a fifth of the rows counts as zero there."""
    rows = priced_lines(spark, sf_dir)
    known = F.when(F.col("l_linenumber") % 5 > 0, F.get("features", F.lit(0)))
    bad = F.array(known.otherwise(F.lit(float("nan"))), F.get("features", F.lit(1)))
    rows = rows.withColumn("features", bad)
    return by_flag(krr.fit_dual(rows, ridge_lambda=0.01, key=LINE_KEY), rows)


WIDE = 4200


# The ridge's own jitter belongs to the closed form: at few rows some results lie on
# the edge of the sixth digit, where it decides.
@query(
    "fit_dual_wide",
    f"""
    with rows as (select c_nationkey, c_custkey % {WIDE} as feature, c_acctbal / 1000 as y
                  from customer),
    ridge as (select count(*) * 0.01::double as p from rows),
    fitted as (select feature,
                 sum(y) / (count(*) + max(p) + 1e-12::double * greatest(1 + max(p), 1))
                 as predicted from rows, ridge group by feature)
    select c_nationkey, count(*) as n, round(avg(predicted), 6) as predicted,
           round(max(predicted), 6) as highest
    from rows join fitted using (feature) group by c_nationkey
    """,
)
def fit_dual_wide(spark, sf_dir):
    """One feature for each remainder of the key: the ridge has a closed form. A file
    of narrow rows is a few tasks; they are dealt out before they get wide."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.lit(WIDE))
    place = (F.col("c_custkey") % WIDE).cast("int")
    one = F.concat(
        F.slice(zeros, F.lit(1), place),
        F.array(F.lit(1.0).cast("float")),
        F.slice(zeros, F.lit(1), WIDE - 1 - place),
    )
    tasks = 2 * spark.sparkContext.defaultParallelism
    customers = table(spark, sf_dir, "customer").repartition(tasks, "c_custkey")
    rows = customers.select(
        "c_custkey",
        "c_nationkey",
        (F.col("c_acctbal") / 1000).alias("score_delta"),
        one.alias("features"),
    )
    model = krr.fit_dual(rows, ridge_lambda=0.01, key=["c_custkey"])
    found = model.predict(rows, names=["predicted"], keep=["c_nationkey"])
    return found.groupBy("c_nationkey").agg(
        F.count("*").alias("n"),
        F.round(F.avg("predicted"), 6).alias("predicted"),
        F.round(F.max("predicted"), 6).alias("highest"),
    )


# With two features two independent landmarks span everything, so the Nystrom
# solution is the exact one.
@query("fit_nystrom", RIDGE)
def fit_nystrom(spark, sf_dir):
    rows = priced_lines(spark, sf_dir)
    model = krr.fit_nystrom(
        rows, ridge_lambda=0.01, num_landmarks=16, rank=2, key=LINE_KEY
    )
    return by_flag(model, rows)


NYSTROM_FEATURES = 40


@query(
    "fit_nystrom_wide",
    f"""
    with rows as (select c_custkey, c_nationkey, c_custkey % {NYSTROM_FEATURES} as feature,
                    c_acctbal / 997 as y from customer),
    marks as (select distinct c_custkey % {NYSTROM_FEATURES} as feature
              from ({ranked('customer', 'c_custkey')}) where r <= 16),
    fitted as (select feature, sum(y) / (count(*) + (select count(*) from rows) * 0.01)
                 as predicted from rows semi join marks using (feature) group by feature)
    select c_nationkey, count(*) as n,
           round(avg(coalesce(predicted, 0)), 6) as predicted
    from rows left join fitted using (feature) group by c_nationkey
    """,
)
def fit_nystrom_wide(spark, sf_dir):
    """More features than landmarks: features that no landmark has get no weight."""
    one = F.transform(
        F.sequence(F.lit(0), F.lit(NYSTROM_FEATURES - 1)),
        lambda i: (i == F.col("c_custkey") % NYSTROM_FEATURES).cast("float"),
    )
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_nationkey",
        (F.col("c_acctbal") / 997).alias("score_delta"),
        one.alias("features"),
    )
    model = krr.fit_nystrom(
        rows, ridge_lambda=0.01, num_landmarks=16, rank=16, key=["c_custkey"]
    )
    found = model.predict(rows, names=["predicted"])
    return found.groupBy("c_nationkey").agg(
        F.count("*").alias("n"), F.round(F.avg("predicted"), 6).alias("predicted")
    )


def order_scores(spark, sf_dir):
    """Base and variant scores of orders. The variant depends on two features."""
    status = F.col("o_orderstatus")
    split = F.when(status == "F", "train").when(status == "O", "valid")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("pair_id"),
        split.otherwise("test").alias("split"),
        (F.col("o_totalprice") / -100000).alias("base_score"),
        (F.col("o_custkey") % 10 / 10).alias("a"),
        (F.col("o_orderkey") % 7 / 7).alias("b"),
        "o_orderkey",
        F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("prompt"),
        F.col("o_orderstatus").alias("completion"),
    ).withColumn(
        "adapter_score",
        F.col("base_score")
        + F.col("a") * 0.5
        - F.col("b") * 0.25
        + F.col("o_orderkey") % 13 / 100,
    )


ORDER_SCORES = """
    select o_orderkey::varchar as pair_id,
           case o_orderstatus when 'F' then 'train' when 'O' then 'valid' else 'test' end
             as split,
           o_totalprice / -100000 as base_score, (o_custkey % 10) / 10 as a,
           (o_orderkey % 7) / 7 as b,
           o_totalprice / -100000 + (o_custkey % 10) / 10 * 0.5::double
             - (o_orderkey % 7) / 7 * 0.25::double + (o_orderkey % 13) / 100
             as adapter_score
    from orders
    """


def scores(df, name):
    return df.select("pair_id", "split", F.col(name).alias("score"))


def deltas(spark, sf_dir):
    df = order_scores(spark, sf_dir)
    return scoring.score_deltas(scores(df, "base_score"), scores(df, "adapter_score"))


@query(
    "score_deltas",
    f"""
    select pair_id, split, base_score, adapter_score,
           adapter_score - base_score as score_delta
    from ({ORDER_SCORES})
    """,
)
def score_deltas(spark, sf_dir):
    return deltas(spark, sf_dir)


@query(
    "unmatched_pairs",
    f"""
    select pair_id, split, case when split = 'test' then 'adapter' else 'base' end
             as missing_in
    from ({ORDER_SCORES}) where split <> 'train'
    """,
)
def unmatched_pairs(spark, sf_dir):
    df = order_scores(spark, sf_dir)
    base = scores(df, "base_score").where("split <> 'valid'")
    adapter = scores(df, "adapter_score").where("split <> 'test'")
    return scoring.unmatched_pairs(base, adapter)


@query(
    "train_mean_baseline",
    f"""
    with d as (select *, adapter_score - base_score as delta from ({ORDER_SCORES}))
    select pair_id, split, round((select avg(delta) from d where split = 'train'), 9)
             as baseline_score_delta
    from d
    """,
)
def train_mean_baseline(spark, sf_dir):
    found = scoring.with_baseline(deltas(spark, sf_dir))
    value = F.round("baseline_score_delta", 9).alias("baseline_score_delta")
    return found.select("pair_id", "split", value)


@query(
    "prediction_rows",
    f"""
    with d as (select *, adapter_score - base_score as delta from ({ORDER_SCORES})),
    m as (select avg(delta) as mean from d where split = 'train')
    select pair_id, split, base_score, adapter_score, delta as score_delta,
           a * 0.5::double as predicted_score_delta,
           base_score + a * 0.5::double as predicted_adapter_score,
           round(mean, 9) as baseline_score_delta,
           round(base_score + mean, 9) as baseline_adapter_score
    from d, m
    """,
)
def prediction_rows(spark, sf_dir):
    predictions = order_scores(spark, sf_dir).select(
        "pair_id", "split", (F.col("a") * 0.5).alias("predicted_score_delta")
    )
    rows = scoring.prediction_rows(
        scoring.with_baseline(deltas(spark, sf_dir)), predictions
    )
    for name in ("baseline_score_delta", "baseline_adapter_score"):
        rows = rows.withColumn(name, F.round(name, 9))
    return rows


def bundle_sql(x: str, y: str, prefix: str, sign: bool) -> str:
    """Metric bundle over columns whose average ranks end in ``__rank``."""

    def corr(a: str, b: str) -> str:
        return (
            f"coalesce(case when min({a}) = max({a}) or min({b}) = max({b}) "
            f"then 0 else corr({a}, {b}) end, 0)"
        )

    parts = [
        f"round({corr(x, y)}, 6) as {prefix}_pearson",
        f"round({corr(x + '__rank', y + '__rank')}, 6) as {prefix}_spearman",
        f"round(sqrt(avg(({x} - {y}) ** 2)), 6) as {prefix}_rmse",
        f"round(avg(abs({x} - {y})), 6) as {prefix}_mae",
    ]
    if sign:
        parts.append(
            f"round(avg((sign({x}) = sign({y}))::int), 6) as {prefix}_sign_accuracy"
        )
    return ", ".join(parts)


def ranks_sql(names, by: str) -> str:
    """Average ranks within ``by``."""
    return ", ".join(
        f"(rank() over (partition by {by} order by {name}) + count(*) over "
        f"(partition by {by} order by {name} range between unbounded preceding and "
        f"current row)) / 2 as {name}__rank"
        for name in names
    )


def rounded(df, keys, digits=6):
    return df.select(
        *[
            F.round(c, digits).alias(c) if t == "double" and c not in keys else F.col(c)
            for c, t in df.dtypes
        ]
    )


EXPERIMENT_NAMES = (
    "score_delta",
    "predicted_score_delta",
    "adapter_score",
    "predicted_adapter_score",
    "baseline_adapter_score",
)


@query(
    "kernel_experiment",
    f"""
    with scored as ({ORDER_SCORES}),
    rows as (select *, a::float::double as a, b::float::double as b,
               adapter_score - base_score as y
             from (select * replace (a::float::double as a, b::float::double as b)
                   from scored)),
    {CLOSED_FORM.format(ridge=0.05, where="where split = 'train'")},
    predicted as (
      select pair_id, split, base_score, adapter_score, y as score_delta,
             round(a * wa + b * wb, 9) as predicted_score_delta,
             base_score + a * wa + b * wb as predicted_adapter_score,
             (select avg(y) from rows where split = 'train') as baseline_score_delta
      from rows, weights),
    named as (select *, base_score + baseline_score_delta as baseline_adapter_score
              from predicted),
    ranks as (select *, 1.0 as baseline_score_delta__rank,
                {ranks_sql(EXPERIMENT_NAMES, "split")} from named)
    select split, count(*) as num_examples,
           {bundle_sql("score_delta", "predicted_score_delta", "delta", True)},
           {bundle_sql("adapter_score", "predicted_adapter_score", "adapter_score", False)},
           {bundle_sql("score_delta", "baseline_score_delta", "baseline_delta", True)},
           {bundle_sql("adapter_score", "baseline_adapter_score",
                       "baseline_adapter_score", False)},
           round(sqrt(avg((score_delta - baseline_score_delta) ** 2))
             - sqrt(avg((score_delta - predicted_score_delta) ** 2)), 6)
             as delta_rmse_gain
    from ranks group by split
    """,
)
def kernel_experiment(spark, sf_dir):
    df = order_scores(spark, sf_dir)
    vectors = df.select("pair_id", "split", F.array("a", "b").alias("features"))
    config = ExperimentConfig(
        method="dual",
        ridge_lambda=0.05,
        limits=dict.fromkeys(("train", "valid", "test"), 0),
    )
    result = run_experiment(
        df.select("pair_id", "split", "prompt", "completion"),
        scores(df, "base_score"),
        scores(df, "adapter_score"),
        vectors,
        config,
    )
    return rounded(result.metrics, ["split"])
