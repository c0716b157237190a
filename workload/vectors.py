"""Feature vectors: transformations, projection, assembly, selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairlab.operators import projection, reuse, scoring, selection
from pairlab.operators import vectors as vec
from pairlab.operators.filters import feature_shape
from pairlab.session import shared_path

from .registry import query, table

DIM = 64


def features(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"), "label"
    )


def cells(df):
    """Vectors as (row_id, place, value) rows."""
    return df.select(
        "row_id", F.posexplode("features").alias("place", "value")
    ).withColumn("value", F.col("value").cast("double"))


CELLS = """
    select vec_id as row_id, (unnest(range(len(embedding))))::int as place,
           unnest(embedding)::double as value
    from embeddings
    """


@query("transform_identity", CELLS)
def transform_identity(spark, sf_dir):
    df = features(spark, sf_dir)
    return cells(
        df.withColumn("features", vec.Chain.read(None).over(F.col("features")))
    )


@query(
    "transform_sign",
    f"select row_id, place, sign(value)::double as value from ({CELLS})",
)
def transform_sign(spark, sf_dir):
    df = features(spark, sf_dir)
    return cells(df.withColumn("features", vec.sign(F.col("features"))))


@query(
    "transform_thresholded",
    f"""
    select row_id, place, case when value > 0.05 then 1.0 when value < -0.05 then -1.0
             else 0.0 end::double as value
    from ({CELLS})
    """,
)
def transform_thresholded(spark, sf_dir):
    df = features(spark, sf_dir)
    params = {"thresholded-sign": {"threshold": 0.05}}
    chain = vec.Chain.read("Thresholded-Sign", params)
    return cells(df.withColumn("features", chain.over(F.col("features"))))


@query(
    "transform_chain",
    f"""
    select row_id, place, case when value > 0.01 then 1.0 when value < -0.01 then -1.0
             else 0.0 end::double as value
    from ({CELLS})
    """,
)
def transform_chain(spark, sf_dir):
    df = features(spark, sf_dir)
    column = vec.Chain.read(["identity, thresholded_sign", "sign"]).over(F.col("features"))
    return cells(df.withColumn("features", column))


def _sized(components: int) -> float:
    density = 1 / DIM**0.5
    return (1 / density) ** 0.5 / components**0.5


def _entries(components: int, seed: int, dim: int = DIM) -> str:
    """The entries from their definition: each component's draws, how many features
    each skips, and where that leads."""
    matrix = projection.SparseMatrix(dim, components, seed)
    start, whole = (seed * projection.SEED_STEP) % 2**32, 2**64
    big = "::uhugeint"
    z = f"((c + {start}){big} * {2**32}{big} + i{big} + {projection.MIX_STEP}{big})"
    z = f"({z} % {whole}{big})"
    steps = [f"select c, i, {z}::ubigint as z from range({components}) a(c), draws"]
    for shift, factor in projection.MIX_ROUNDS:
        mixed = f"xor(z, z >> {shift})::uhugeint * {factor}::uhugeint % {whole}::uhugeint"
        steps.append(f"select c, i, ({mixed})::ubigint as z from ({steps[-1]})")
    last = f"select c, i, xor(z, z >> {projection.MIX_LAST}) as z from ({steps[-1]})"
    skip = f"floor(ln(((z >> 11)::double + 0.5) / pow(2, 53)) / ln(1 - {matrix.density!r}))"
    return f"""
    select place::int as feature, c::int as component,
           case when z & 1 = 0 then {matrix.size!r}::double else -{matrix.size!r}::double
             end as value
    from (select c, z, sum({skip} + 1) over (partition by c order by i) - 1 as place
          from (with draws as (select unnest(range({8 * matrix.draws()})) as i) {last}))
    where place < {dim}
    """


def _projected(source: str, components: int, seed: int, dim: int = DIM) -> str:
    """Every row has every component, zero where no entry meets it."""
    return f"""
    with e as ({_entries(components, seed, dim)}), x as ({source}),
    hits as (
      select row_id, component, sum(x.value * e.value) as value
      from x join e on e.feature = x.place group by row_id, component)
    select r.row_id, c::int as place, coalesce(h.value, 0)::float::double as value
    from (select distinct row_id from x) r cross join range({components}) k(c)
    left join hits h on h.row_id = r.row_id and h.component = c
    """


@query("project_features", _projected(CELLS, 16, 42))
def project_features(spark, sf_dir):
    df = features(spark, sf_dir).drop("label")
    return cells(projection.project_features(df, "sparse-random", 16, 42))


WIDTH = 20_000
WIDE_CELLS = f"""
    select s_suppkey as row_id, ((s_suppkey * 7919 + k * 104729) % {WIDTH})::int as place,
           (s_suppkey % 97 + k / 64)::double as value
    from supplier, range(60) t(k)
    """


@query("project_wide", _projected(WIDE_CELLS, 12, 7, WIDTH))
def project_wide(spark, sf_dir):
    """Vectors of 20,000 features, most of them zero."""
    place = (F.col("row_id") * 7919 + F.col("k") * 104729) % WIDTH
    filled = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("row_id"), F.explode(F.expr("sequence(0L, 59L)")).alias("k")
    )
    value = F.struct(
        place.cast("int").alias("place"),
        (F.col("row_id") % 97 + F.col("k") / 64).cast("float").alias("value"),
    )
    held = filled.groupBy("row_id").agg(F.sort_array(F.collect_list(value)).alias("held"))
    # Zeros before each value, and behind the last.
    gaps = F.transform(
        "held",
        lambda x, i: F.concat(
            F.array_repeat(
                F.lit(0.0).cast("float"),
                x["place"] - F.coalesce(F.get("held", i - 1)["place"], F.lit(-1)) - 1,
            ),
            F.array(x["value"]),
        ),
    )
    rest = F.lit(WIDTH - 1) - F.element_at("held", -1)["place"]
    vectors = F.concat(
        F.flatten(gaps), F.array_repeat(F.lit(0.0).cast("float"), rest)
    )
    df = held.select("row_id", vectors.alias("features"))
    return cells(projection.project_features(df, "sparse-random", 12, 7))


SIGNS = f"select row_id, place, sign(value)::double as value from ({CELLS})"


@query("prepare_features", _projected(SIGNS, 8, 5))
def prepare_features(spark, sf_dir):
    prepared = projection.prepare_features(
        features(spark, sf_dir).drop("label"),
        "sign",
        projection="sparse_random",
        components=8,
        seed=5,
    )
    return cells(prepared.features)


@query("project_identity", CELLS)
def project_identity(spark, sf_dir):
    return cells(projection.project_features(features(spark, sf_dir), "identity"))


@query(
    "feature_pipeline",
    f"""
    select {DIM} as raw_feature_dim, 'sign' as transformations,
           {DIM} as transformed_feature_dim, 'sparse_random' as projection,
           {DIM} as projection_dim
    """,
)
def feature_pipeline(spark, sf_dir):
    prepared = projection.prepare_features(
        features(spark, sf_dir), "sign", projection="sparse_random"
    )
    return prepared.description.select(
        "raw_feature_dim",
        F.array_join("transformations", ",").alias("transformations"),
        "transformed_feature_dim",
        "projection",
        "projection_dim",
    )


@query(
    "feature_shape",
    """
    select count(*) as rows, min(len(embedding))::int as min_dim,
           max(len(embedding))::int as max_dim
    from embeddings
    """,
)
def shape(spark, sf_dir):
    return feature_shape(features(spark, sf_dir))


def leaves(spark, sf_dir):
    """Each vector as four named leaves, as a gradient tree would have them."""
    df = features(spark, sf_dir)
    parts = F.array(
        *[
            F.struct(
                F.lit(n).alias("leaf_order"),
                F.lit(f"layers.{n // 2}.{'lora_b' if n % 2 else 'lora_a'}").alias(
                    "leaf_name"
                ),
                F.slice("features", 16 * n + 1, 16).alias("values"),
            )
            for n in range(4)
        ]
    )
    return df.select(F.col("row_id").alias("pair_id"), F.inline(parts))


@query(
    "assemble_features",
    """
    select vec_id as row_id, (unnest(range(32)))::int as place,
           unnest(embedding[17:32] || embedding[49:64])::double as value
    from embeddings
    """,
)
def assemble_features(spark, sf_dir):
    assembled = vec.assemble_features(leaves(spark, sf_dir))
    return cells(assembled.withColumnRenamed("pair_id", "row_id"))


@query(
    "completion_scores",
    """
    select l_orderkey as pair_id, count(*) filter (l_linenumber >= 3)
             as supervised_tokens,
           round(-avg(l_extendedprice / 10000) filter (l_linenumber >= 3), 9) as score
    from lineitem group by l_orderkey
    """,
)
def completion_scores(spark, sf_dir):
    losses = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"),
        F.col("l_linenumber").alias("step"),
        (F.col("l_extendedprice") / 10000).alias("token_loss"),
        F.lit(3).alias("prompt_offset"),
    )
    scores = scoring.completion_scores(losses)
    return scores.withColumn("score", F.round("score", 9))


def text_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"),
        F.col("role").alias("split"),
        F.col("text").alias("prompt"),
        F.col("role").alias("completion"),
    )


def length_scorer():
    def score(prompt, completion):
        offset, length = len(prompt) + 3, len(prompt) + len(completion) + 5
        return -len(completion) / 10, offset, length, max(0, length - offset)

    return score


@query(
    "score_pairs",
    """
    select conv_id || '-' || turn as pair_id, role as split,
           -length(role) / 10.0::double as score,
           (length(text) + 3)::int as prompt_offset,
           (length(text) + length(role) + 5)::int as sequence_length,
           (length(role) + 2)::int as completion_targets
    from conversations
    """,
)
def score_pairs(spark, sf_dir):
    return scoring.score_pairs(text_pairs(spark, sf_dir), length_scorer)


def length_extractor():
    return lambda prompt, completion: [len(prompt), len(completion)]


@query(
    "extract_features",
    """
    select conv_id || '-' || turn as pair_id, role as split,
           length(text)::double as f0, length(role)::double as f1
    from conversations
    """,
)
def extract_features(spark, sf_dir):
    found = scoring.extract_features(text_pairs(spark, sf_dir), length_extractor)
    return found.select(
        "pair_id",
        "split",
        F.col("features")[0].cast("double").alias("f0"),
        F.col("features")[1].cast("double").alias("f1"),
    )


@query(
    "fingerprint_records",
    """
    with h as (
      select sha256(concat_ws('|', length(doc_id::varchar) || ':' || doc_id,
               length(text) || ':' || text, length(lang) || ':' || lang)) as d
      from documents)
    select count(*) as records,
           sum(('0x' || substr(d, 1, 15))::hugeint)::varchar as digest_sum,
           bit_xor(('0x' || substr(d, 16, 15))::bigint) as digest_xor
    from h
    """,
)
def fingerprint_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return reuse.fingerprint(docs, ["doc_id"], ["text", "lang"])


@query(
    "unstored_rows",
    """
    select doc_id, lang from documents where doc_id not in (select doc_id from labels)
    """,
)
def unstored_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return reuse.missing_rows(docs, table(spark, sf_dir, "labels"), ["doc_id"])


CENTRES = f"""
    select label as centre, place, avg(value) as value
    from ({CELLS}) join embeddings on vec_id = row_id
    group by label, place
    """

DISTANCES = f"""
    select row_id, centre, sum((x.value - c.value) ** 2) as distance
    from ({CELLS}) x join ({CENTRES}) c using (place)
    group by row_id, centre
    """


def label_centres(spark, sf_dir):
    """Mean vector of each label: ten labels by 64 features."""
    df = features(spark, sf_dir)
    means = (
        df.select("label", F.posexplode("features").alias("place", "value"))
        .groupBy("label", "place")
        .agg(F.avg("value").alias("value"))
    )
    vectors = means.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("place", "value"))).alias("cells")
    )
    rows = vectors.orderBy("label").select("cells.value").collect()
    return np.array([row["value"] for row in rows])


@query(
    "nearest_rows",
    f"""
    select centre, arg_min(row_id, {{'d': distance, 'i': row_id}}) as row_id,
           round(min(distance), 9) as distance
    from ({DISTANCES}) group by centre
    """,
)
def nearest_rows(spark, sf_dir):
    centres = label_centres(spark, sf_dir)
    found = selection.nearest_rows(features(spark, sf_dir), centres)
    return found.withColumn("distance", F.round("distance", 9))


@query(
    "own_centre",
    f"""
    select row_id, arg_min(centre, distance) as centre,
           round(min(distance), 9) as distance
    from ({DISTANCES}) group by row_id
    """,
)
def own_centre(spark, sf_dir):
    centres = label_centres(spark, sf_dir)
    found = selection.own_centre(features(spark, sf_dir), centres)
    return found.withColumn("distance", F.round("distance", 9))


REPRESENTATIVES = f"""
    with d as ({DISTANCES}),
    nearest as (select distinct row_id from (
      select centre, arg_min(row_id, {{'d': distance, 'i': row_id}}) as row_id
      from d group by centre)),
    spare as (
      select row_id, min(distance) as distance from d
      where row_id not in (select row_id from nearest) group by row_id)
    select row_id from nearest
    union all
    select row_id from (select row_id, row_number() over (order by distance, row_id) as r
      from spare) where r <= 40 - (select count(*) from nearest)
    """


@query("representative_ids", REPRESENTATIVES)
def representative_ids(spark, sf_dir):
    centres = label_centres(spark, sf_dir)
    return selection.representative_ids(features(spark, sf_dir), centres, 40)


@query(
    "representative_rows",
    f"select vec_id as row_id, label from embeddings where vec_id in ({REPRESENTATIVES})",
)
def representative_rows(spark, sf_dir):
    df = features(spark, sf_dir)
    centres = label_centres(spark, sf_dir)
    chosen = selection.representative_ids(df, centres, 40)
    return df.join(F.broadcast(chosen), "row_id", "left_semi").select("row_id", "label")


BUCKETS = 256
CHANGED, ADDED = 7, 11


@query(
    "renew_table",
    f"""
    with docs as (
      select doc_id, length(text) as n, doc_id % 200 as part,
             ('0x' || substr(sha256(length(doc_id::varchar) || ':' || doc_id), 1, 8))
               ::bigint % {BUCKETS} as bucket
      from documents)
    select doc_id, n::int as n,
           (bucket in (select bucket from docs where part in ({CHANGED}, {ADDED})))::int
             as version
    from docs
    """,
)
def renew_table(spark, sf_dir):
    """Lengths of documents, computed once; then some have another text and some are
    new, and only their buckets are computed again."""
    root = shared_path(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.col("doc_id") % 200
    other = F.when(part == CHANGED, F.lit("another text")).otherwise(F.col("text"))
    before = docs.where(part != ADDED).withColumn("text", other)

    def lengths(rows):
        return rows.select("doc_id", F.length("text").alias("n"))

    for rows in (before, docs):
        found = reuse.renew_table(rows, root, lengths, {}, ["doc_id"], ["text"], BUCKETS)
    return found.select("doc_id", "n", "version")


STARTS = 5


def _step(rows: str, centres: str) -> str:
    """SQL for the rows with their nearest of ``centres``."""
    return f"""
    select row_id, x, arg_min(k, d) as k, min(d) as d
    from (select row_id, x, k, list_sum(list_transform(range(1, {DIM} + 1),
            lambda i: (x[i] - c[i]) * (x[i] - c[i]))) as d
          from {rows}, {centres})
    group by row_id, x
    """


def _means(assigned: str) -> str:
    return f"""
    select k, list(m order by i) as c
    from (select k, i, avg(x[i]) as m from {assigned}, range(1, {DIM} + 1) t(i)
          group by k, i)
    group by k
    """


@query(
    "kmeans_steps",
    f"""
    with rows as (select vec_id as row_id, embedding::double[] as x from embeddings),
    c0 as (select row_id as k, x as c from rows where row_id < {STARTS}),
    a1 as ({_step('rows', 'c0')}), c1 as ({_means('a1')}),
    a2 as ({_step('rows', 'c1')}), c2 as ({_means('a2')}),
    a3 as ({_step('rows', 'c2')}), c3 as ({_means('a3')})
    select k::int as centre, i::int - 1 as place, round(c[i], 9) as value,
           round((select sum(d) from a3), 6) as cost
    from c3, range(1, {DIM} + 1) t(i)
    """,
)
def kmeans_steps(spark, sf_dir):
    """Three steps from the first vectors as centres."""
    df = features(spark, sf_dir)
    first = df.where(F.col("row_id") < STARTS).orderBy("row_id").select("features")
    starts = np.array([r["features"] for r in first.collect()], float)[None]
    centres, costs = selection.lloyd(df, starts, max_iter=3, tol=0.0)
    rows = [
        (k, i, float(v), float(costs[0]))
        for k, centre in enumerate(centres[0])
        for i, v in enumerate(centre)
    ]
    made = spark.createDataFrame(rows, "centre int, place int, value double, cost double")
    return made.withColumns(
        {"value": F.round("value", 9), "cost": F.round("cost", 6)}
    )


@query("select_kmeans")
def select_kmeans(spark, sf_dir):
    df = features(spark, sf_dir)
    context = {
        "features": df.select("row_id", "features"),
        "selector_transformations": "sign",
        "selector_projection": "sparse_random",
        "selector_projection_components": 16,
        "kmeans_n_init": 2,
        "kmeans_max_iter": 50,
    }
    return selection.run_selector(
        "lora_ntk_kmeans", df.select("row_id", "label"), 32, context
    )


@query(
    "sample_train",
    """
    with pairs as (
      select vec_id as row_id, case when label < 8 then 'train' when label = 8
               then 'valid' else 'test' end as split
      from embeddings),
    kept as (
      select *, row_number() over (partition by split
        order by sha256('42|' || row_id), row_id) as r from pairs)
    select split, count(*) as original_examples,
           count(*) filter (split <> 'train' or r <= 128) as selected_examples
    from kept group by split
    """,
)
def sample_train(spark, sf_dir):
    label = F.col("label")
    split = F.when(label < 8, "train").when(label == 8, "valid").otherwise("test")
    pairs = features(spark, sf_dir).select("row_id", split.alias("split"))
    sampled = selection.sample_train(pairs, "random", 128)
    return selection.sample_counts(pairs, sampled)
