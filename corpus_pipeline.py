"""From raw documents to token ids: each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import pairlab
from pairlab.llm import (
    bpe,
    decontamination,
    jaccard_join,
    queries,
    repeats,
    toxicity,
)
from pairlab.session import materialize

# Python workers need not have this folder.
cloudpickle.register_pickle_by_value(pairlab)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, fitted on the labelled ones, doesn't reject."""
    labels = queries.read(spark, sf_dir, "labels")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later repeated three-line windows."""
    return repeats.drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    items = queries.read(spark, sf_dir, "benchmark")
    return decontamination.drop_contaminated(docs, items)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text."""
    return bpe.encode(docs, queries.vocabulary(), ids=True)


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_copies),
    ("decontamination", decontaminate),
    ("bpe", encode),
]
#: SQL has no classifier and no BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each one's result written to the
    shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
