from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairlab.llm import common


def test_pick_is_exact_and_takes_the_first(spark):
    df = spark.range(1).select(
        F.lit(1).alias("TEXT"), F.lit("a").alias("text"), F.lit("b").alias("text")
    )
    assert common.pick(df, text="text").head().text == "a"


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)]
    edges += [(100 + k, 101 + k) for k in range(30)] + [(5, 5)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.root for r in common.components(spark, df).collect()}
    assert found == {x: root(x) for x in up}
    assert common.components(spark, df.limit(0)).count() == 0


def test_merged(spark):
    spans = [(5, 7), (1, 3), (2, 4), (4, 5), (9, 10), (1, 2)]
    df = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int>>")
    row = df.select(common.merged(F.col("s")).alias("m")).head()
    assert [tuple(x) for x in row.m] == [(1, 7), (9, 10)]
