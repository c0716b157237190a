"""Membership in small and in large sets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairlab.operators import joins


@pytest.mark.parametrize("limit, bits", [(None, 1 << 27), (0, 1 << 27), (0, 1 << 16)])
def test_members_are_tagged(spark, monkeypatch, limit, bits):
    """A small filter lets strangers through; the join behind it is exact."""
    monkeypatch.setattr(joins, "FILTER_BITS", bits)
    rnd = random.Random(bits)
    members = {f"k{rnd.randrange(40_000)}" for _ in range(9_000)}
    rows = [(f"k{rnd.randrange(40_000)}" if k % 9 else "k7", k) for k in range(4_000)]
    rows += [(None, -1), ("", -2)]
    df = spark.createDataFrame(rows, "key string, n bigint")
    keys = spark.createDataFrame([(m,) for m in members], "key string")
    found = joins.tag_members(df, keys, "key", "known", limit)
    assert found.columns == ["key", "n", "known"]
    got = {r["n"]: r["known"] for r in found.collect()}
    assert got == {n: k in members for k, n in rows}


def test_only_candidates_are_shuffled(spark):
    keys = spark.range(1000).select((F.col("id") * 1000).alias("key"))
    df = spark.range(100_000).select(F.col("id").alias("key"))
    found = joins.tag_members(df, keys, "key", "known", 0)
    assert found.where("known").count() == 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_an_empty_set(spark):
    df = spark.createDataFrame([("a",)], "key string")
    for limit in (None, -1):
        found = joins.tag_members(df, df.limit(0), "key", "known", limit)
        assert [tuple(r) for r in found.collect()] == [("a", False)]
