"""Readers and writers: tables go to the shared folder and come back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.operators import reuse
from pairlab.plans.recipe import prepare
from pairlab.session import shared_path
from pairlab.sources import readers, writers

from .preparing import RECIPE, recipe_of
from .registry import query, table

DOCUMENTS = "select doc_id, lang, text from documents"
DOCUMENT_SCHEMA = "doc_id bigint, lang string, text string"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


@query("read_jsonl", DOCUMENTS)
def read_jsonl(spark, sf_dir):
    path = shared_path(spark)
    documents(spark, sf_dir).write.mode("overwrite").json(path)
    return readers.read_jsonl(spark, path, DOCUMENT_SCHEMA)


def listed(rows):
    """The lines of files that each hold one JSON list, one file for each partition."""

    def lines(batches):
        import pyarrow as pa

        lead = "["
        for batch in batches:
            made = []
            for value in batch["value"].to_pylist():
                made.append(lead + value)
                lead = ","
            yield pa.RecordBatch.from_pydict({"value": made})
        tail = "]" if lead == "," else "[]"
        yield pa.RecordBatch.from_pydict({"value": [tail]})

    return rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(
        lines, "value string"
    )


@query("read_json", DOCUMENTS)
def read_json(spark, sf_dir):
    """Whole documents as JSON lists, written and read back by many tasks."""
    path = shared_path(spark)
    listed(documents(spark, sf_dir)).write.mode("overwrite").text(path)
    return readers.read_json(spark, path, DOCUMENT_SCHEMA)


@query("read_csv", "select doc_id::varchar as doc_id, lang, text from documents")
def read_csv(spark, sf_dir):
    """Texts with line breaks, quotes and commas survive."""
    path = shared_path(spark)
    writer = documents(spark, sf_dir).write.mode("overwrite")
    writer.csv(path, header=True, escape='"', quoteAll=True)
    return readers.read_csv(spark, path)


@query(
    "read_splits",
    """
    select o_orderkey, case o_orderstatus when 'F' then 'train' else 'test' end as split
    from orders where o_orderstatus in ('F', 'O')
    """,
)
def read_splits(spark, sf_dir):
    orders, files = table(spark, sf_dir, "orders"), {}
    for split, status in (("train", "F"), ("test", "O")):
        files[split] = shared_path(spark)
        rows = orders.where(F.col("o_orderstatus") == status).select("o_orderkey")
        rows.write.mode("overwrite").json(files[split])
    return readers.read_splits(spark, "jsonl", files, "o_orderkey bigint")


@query(
    "read_data_files",
    "select doc_id from documents where lang in ('en', 'fr')",
)
def read_data_files(spark, sf_dir):
    """A configuration's folder, and patterns of files in it."""
    root = shared_path(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs.write.mode("overwrite").partitionBy("lang").json(f"{root}/base")
    source = {
        "type": "jsonl",
        "path": root,
        "config": "base",
        "data_files": ["lang=en/*.json", "lang=fr/*.json"],
        "schema": "doc_id bigint",
    }
    return readers.read_source(spark, source)


@query(
    "write_pairs",
    RECIPE
    + """
    select split, prompt, completion from tagged where not excluded and not long
    """,
)
def write_pairs(spark, sf_dir):
    path = shared_path(spark)
    prepare(spark, recipe_of(spark, sf_dir), ["doc_id"]).write(path)
    schema = "split string, prompt string, completion string"
    return spark.read.schema(schema).json(path)


@query("read_predictions", "select lang as prediction, source as reference from documents")
def read_predictions(spark, sf_dir):
    path = shared_path(spark)
    rows = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("prediction"), F.col("source").alias("reference")
    )
    rows.write.mode("overwrite").json(path)
    return readers.read_predictions(spark, path)


def save_files(rows, folder):
    """A text file for each row (run, name, value), written by the tasks."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)

    def save(batches):
        for batch in batches:
            for run, name, value in zip(*batch.to_pydict().values()):
                store.create_dir(f"{root}/{run}")
                with store.open_output_stream(f"{root}/{run}/{name}") as out:
                    out.write(value.encode())
            yield batch.slice(0, 0)

    rows.select("run", "name", "value").mapInArrow(save, rows.schema).count()


@query(
    "read_summaries",
    """
    select s_suppkey::varchar as run_name, s_acctbal as score,
           case when s_suppkey % 3 = 0 then s_nationkey end as eval_nation
    from supplier where s_suppkey % 10 <> 4
    """,
)
def read_summaries(spark, sf_dir):
    """A run folder for each supplier: corrupt summaries are skipped, the evaluation
    beside a summary is joined to it."""
    root = shared_path(spark)
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    suppliers = table(spark, sf_dir, "supplier").withColumn(
        "run", F.col("s_suppkey").cast("string")
    )
    summary = F.to_json(
        F.struct(F.col("run").alias("run_name"), F.col("s_acctbal").alias("score"))
    )
    cut = F.when(F.col("s_suppkey") % 10 == 4, F.substring(summary, 1, 9))
    own = suppliers.select(
        "run", F.lit("summary.json").alias("name"), F.coalesce(cut, summary).alias("value")
    )
    evaluated = suppliers.where(F.col("s_suppkey") % 3 == 0).select(
        "run",
        F.lit("eval.json").alias("name"),
        F.to_json(F.struct(F.col("s_nationkey").alias("nation"))).alias("value"),
    )
    save_files(own.unionByName(evaluated), f"{root}/runs")
    schema = T._parse_datatype_string("run_name string, score double")
    eval_schema = T._parse_datatype_string("nation int")
    found = readers.read_summaries(spark, f"{root}/runs", schema, eval_schema)
    return found.select("run_name", "score", F.col("eval.nation").alias("eval_nation"))


@query("read_or_empty", "select o_orderkey from orders")
def read_or_empty(spark, sf_dir):
    """A table that is there, and one that isn't."""
    schema = T.StructType([T.StructField("o_orderkey", T.LongType())])
    path = shared_path(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    rows.write.mode("overwrite").json(path)
    there = readers.read_or_empty(spark, path, schema)
    return there.unionByName(readers.read_or_empty(spark, f"{path}-none", schema))


@query("write_keyed", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def write_keyed(spark, sf_dir):
    """Written by split; a reader of one split prunes the others."""
    path = shared_path(spark)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("split")
    )
    writers.write_keyed(rows, path)
    return spark.read.parquet(path).where("split = 'F'").drop("split")


@query(
    "stored_features",
    """
    select vec_id as row_id, len(embedding)::int as dim,
           round(list_sum(embedding::double[]), 6) as total
    from embeddings
    """,
)
def stored_features(spark, sf_dir):
    path = shared_path(spark)
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("features")
    )
    writers.write_features(rows, path)
    values = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return writers.read_features(spark, path).select(
        "row_id", F.size("features").alias("dim"), F.round(values, 6).alias("total")
    )


@query("reuse_table", "select doc_id, length(text)::bigint as size from documents")
def reuse_table(spark, sf_dir):
    """Computed for half of the rows, then completed, then read."""
    root = shared_path(spark)
    docs = documents(spark, sf_dir)

    def sizes(rows):
        return rows.select("doc_id", F.length("text").cast("bigint").alias("size"))

    options = {"params": {"what": "size"}, "key": ["doc_id"], "columns": ["text"]}
    digest = reuse.table_digest(docs, ["doc_id"], ["text"], options["params"])
    sizes(docs.where("doc_id % 2 = 0")).write.mode("overwrite").parquet(f"{root}/{digest}")
    reuse.reuse_table(docs, root, sizes, **options)
    return reuse.reuse_table(docs, root, sizes, **options)
