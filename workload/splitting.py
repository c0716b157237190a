"""Seeded subsets and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import splits
from pairlab.operators.ordering import global_index
from pairlab.operators.selection import scaled_iterations, select_all, select_random

from .registry import query, table

RANKED = """
    select *, row_number() over (order by sha256('{seed}|' || {key}), {key}) as r,
           count(*) over () as n
    from {table}
    """


def ranked(name: str, key: str, seed: int = 42) -> str:
    return RANKED.format(table=name, key=key, seed=seed)


# Published splits by order status, for the strategies that start from them.
ORDER_SPLIT = """
    case o_orderstatus when 'F' then 'train' when 'O' then 'validation' else 'test' end
    """


def published_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    split = F.when(status == "F", "train").when(status == "O", "validation")
    return orders.select("o_orderkey", split.otherwise("test").alias("split"))


@query(
    "take_subset",
    f"select doc_id, lang from ({ranked('documents', 'doc_id')}) where r <= 64",
)
def take_subset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.take_subset(docs, 64, ["doc_id"])


def null_key(name):
    """A key that is null in one row."""
    return F.when(F.col(name) > 0, F.col(name))


@query(
    "take_subset_null_key",
    """
    with keyed as (select doc_id, nullif(doc_id, 0) as key from documents)
    select doc_id from (
      select doc_id, row_number() over (
        order by sha256('42|' || coalesce(key::varchar, '')), key) as r from keyed)
    where r <= 150
    """,
)
def take_subset_null_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", null_key("doc_id").alias("key"))
    return splits.take_subset(docs, 150, ["key"]).select("doc_id")


@query(
    "cap_splits_null_split",
    f"""
    with named as (select o_orderkey, nullif(trim({ORDER_SPLIT}), 'test') as split
                   from orders)
    select o_orderkey, split from (
      select *, row_number() over (partition by split
                 order by sha256('42|' || o_orderkey), o_orderkey) as r from named)
    where split is null or r <= 300
    """,
)
def cap_splits_null_split(spark, sf_dir):
    """Rows without a split have no cap of their own and all stay."""
    named = published_orders(spark, sf_dir)
    split = F.when(F.col("split") != "test", F.col("split"))
    sizes = {"train": 300, "validation": 300}
    return splits.cap_splits(named.withColumn("split", split), sizes, ["o_orderkey"])


@query(
    "shuffle_rows",
    "select o_orderkey, sha256('5|' || o_orderkey) as shuffle_key from orders",
)
def shuffle_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return splits.shuffled(orders, ["o_orderkey"], 5)


@query(
    "split_train_test",
    f"""
    select o_orderkey, case when r <= greatest(1, least(n - 1,
             round_even(n * 0.15, 0))) then 'test' else 'train' end as split
    from ({ranked('orders', 'o_orderkey')})
    """,
)
def split_train_test(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return splits.train_test(orders, 0.15, ["o_orderkey"])


@query(
    "split_ratios",
    f"""
    select event_id, case when r <= t then 'test' when r <= t + greatest(1,
             least(n - t - 1, round_even((n - t) * (0.07 / (1.0 - 0.11)), 0)))
             then 'valid' else 'train' end as split
    from (select *, greatest(1, least(n - 1, round_even(n * 0.11, 0))) as t
          from ({ranked('events', 'event_id', 3)}))
    """,
)
def split_ratios(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    return splits.train_valid_test(events, ["event_id"], 0.07, 0.11, 3)


@query(
    "split_train_valid",
    f"""
    select o_orderkey, case when r <= greatest(1, least(m - 1,
             round_even(m * 0.1, 0))) then 'valid' else 'train' end as split
    from (select *, least(n, 1000) as m from ({ranked('orders', 'o_orderkey')}))
    where r <= m
    """,
)
def split_train_valid(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return splits.train_valid(orders, ["o_orderkey"], 0.1, max_examples=1000)


@query(
    "split_existing",
    f"""
    select o_orderkey, case {ORDER_SPLIT} when 'train' then 'train'
             when 'validation' then 'valid' else 'test' end as split
    from orders
    """,
)
def split_existing(spark, sf_dir):
    return splits.existing_splits(published_orders(spark, sf_dir))


@query(
    "split_existing_renamed",
    f"""
    select o_orderkey, unnest(case {ORDER_SPLIT} when 'validation' then ['train', 'valid']
             when 'test' then ['test'] else []::varchar[] end) as split
    from orders
    """,
)
def split_existing_renamed(spark, sf_dir):
    names = {"train": "validation"}
    return splits.existing_splits(published_orders(spark, sf_dir), names)


@query(
    "split_keep_test",
    f"""
    with train as (
      select o_orderkey, row_number() over (
               order by sha256('42|' || o_orderkey), o_orderkey) as r,
             count(*) over () as n
      from orders where o_orderstatus = 'F')
    select o_orderkey, case when r <= greatest(1, least(m - 1,
             round_even(m * 0.2, 0))) then 'valid' else 'train' end as split
    from (select *, least(n, 700) as m from train) where r <= m
    union all
    select o_orderkey, 'test' from orders where o_orderstatus = 'P'
    """,
)
def split_keep_test(spark, sf_dir):
    return splits.train_valid_existing_test(
        published_orders(spark, sf_dir), ["o_orderkey"], 0.2, max_examples=700
    )


@query(
    "cap_splits",
    f"""
    select o_orderkey, split from (
      select o_orderkey, {ORDER_SPLIT} as split, row_number() over (
               partition by o_orderstatus
               order by sha256('42|' || o_orderkey), o_orderkey) as r
      from orders)
    where r <= case split when 'train' then 300 when 'test' then 0 else 999999999 end
    """,
)
def cap_splits(spark, sf_dir):
    sizes = {"train": 300, "test": 0, "validation": None}
    return splits.cap_splits(published_orders(spark, sf_dir), sizes, ["o_orderkey"])


@query(
    "subset_pairs",
    f"""
    select o_orderkey as pair_id, split from (
      select o_orderkey, case o_orderstatus when 'F' then 'train' when 'O' then 'valid'
               else 'test' end as split,
             row_number() over (partition by o_orderstatus order by sha256(
               (case o_orderstatus when 'F' then '42' when 'O' then '43' else '44' end)
               || '|' || o_orderkey), o_orderkey) as r
      from orders)
    where split = 'test' or r <= case split when 'train' then 512 else 32 end
    """,
)
def subset_pairs(spark, sf_dir):
    named = splits.existing_splits(published_orders(spark, sf_dir))
    pairs = named.withColumnRenamed("o_orderkey", "pair_id")
    return splits.subset_pairs(pairs, {"train": 512, "valid": 32, "test": 0})


@query(
    "select_random",
    f"select vec_id, label from ({ranked('embeddings', 'vec_id', 9)}) where r <= 128",
)
def random_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return select_random(rows, 128, {"seed": 9, "key": ["vec_id"]})


@query("select_identity", "select vec_id, label from embeddings")
def identity_rows(spark, sf_dir):
    return select_all(table(spark, sf_dir, "embeddings").select("vec_id", "label"), 5)


@query(
    "decimate_points",
    """
    select o_orderkey, o_totalprice from (
      select *, row_number() over (order by o_orderkey) - 1 as i,
             count(*) over () as n from orders)
    where i % case when n > 500 then n // 500 else 1 end = 0
    """,
)
def decimate_points(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return splits.decimate(orders, ["o_orderkey"], 500)


@query(
    "global_index",
    """
    select c_custkey, row_number() over (order by c_mktsegment, c_custkey) - 1
             as row_index
    from customer
    """,
)
def indexed_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    return global_index(rows, ["c_mktsegment", "c_custkey"]).drop("c_mktsegment")


@query(
    "global_index_by_null",
    """
    select c_custkey, row_number() over (
             partition by nullif(c_mktsegment, 'BUILDING') order by c_custkey) - 1
             as row_index
    from customer
    """,
)
def indexed_by_null(spark, sf_dir):
    segment = F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")
    rows = table(spark, sf_dir, "customer").select("c_custkey", segment)
    return global_index(rows, ["c_custkey"], by=["segment"]).drop("segment")


@query(
    "subset_iterations",
    """
    with runs as (
      select p_partkey, (p_size * 20)::bigint as base,
             (p_partkey % 97)::bigint as selected
      from part)
    select p_partkey,
           case when selected > 0 then least(base,
             greatest(8, ceil(base * selected / 500.0)::bigint)) else base end as capped,
           case when selected > 0 then
             greatest(1, ceil(base * selected / 50.0)::bigint) else base end as uncapped,
           base as fixed
    from runs
    """,
)
def subset_iterations(spark, sf_dir):
    runs = table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.col("p_size") * 20).cast("bigint").alias("base"),
        (F.col("p_partkey") % 97).alias("selected"),
    )
    base, selected = F.col("base"), F.col("selected")
    return runs.select(
        "p_partkey",
        scaled_iterations("match_full_passes", base, selected, F.lit(500), 8).alias(
            "capped"
        ),
        scaled_iterations(
            "per_example", base, selected, F.lit(50), cap_at_full=False
        ).alias("uncapped"),
        scaled_iterations("fixed", base, selected, F.lit(50)).alias("fixed"),
    )
