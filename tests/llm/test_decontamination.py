from __future__ import annotations

import random
import time

import pytest
from brute_force import item_copies
from pyspark.sql import functions as F

from pairlab.llm import decontamination as d


def rows_of(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} bigint, text string")


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=n))) for k, n in enumerate([8, 15, 30, 30, 60])]
    docs = []
    for k in range(40):
        own = rnd.choices(vocabulary, k=rnd.randint(0, 80))
        if k % 2:
            item = items[k % 5][1].split()
            if k % 3 == 0:
                item[0] = "changed"
            if k % 7 == 0:
                item[len(item) // 2] = "changed"
            at = rnd.randint(0, len(own))
            own[at:at] = item
        docs.append((k, " ".join(own).upper() if k % 4 == 1 else "\n".join(own)))
    docs.append((100, items[2][1] + " " + items[2][1]))
    return docs, items


def test_against_brute_force(spark, planted):
    docs, items = planted
    found = d.contaminated(rows_of(spark, docs, "doc_id"), rows_of(spark, items, "item_id"))
    got = {(r.doc_id, r.item_id): (r.similarity, r.position) for r in found.collect()}
    want = item_copies(docs, items)
    assert got.keys() == want.keys() and len(want) > 15
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_index_finds_all_within_radius(spark):
    rnd = random.Random(2)
    item = rnd.getrandbits(63)
    near = []
    for k in range(300):
        fp = item
        for bit in rnd.sample(range(63), k % (d.RADIUS + 1)):
            fp ^= 1 << bit
        near.append((k, fp))
    items = spark.createDataFrame([(1, 10, item)], "item_id bigint, m int, item_fp bigint")
    windows = spark.createDataFrame(near, "k int, fp bigint").withColumn(
        "block", F.explode(F.array(*[F.lit(b) for b in range(d.BLOCKS)]))
    )
    met = windows.withColumn("value", d._block(F.col("fp"), F.col("block"))).join(
        d.block_index(items), ["block", "value"]
    )
    assert met.select("k").distinct().count() == 300


@pytest.mark.parametrize("longest", [200, 300, 70_000])
def test_simhash_by_definition(spark, longest):
    rnd = random.Random(longest)
    hashes = [rnd.getrandbits(64) - (1 << 63) for _ in range(37)] * 2 + [5, 5, 5]
    want = sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )
    row = spark.createDataFrame([(hashes,)], "h array<bigint>")
    assert row.select(d.simhash(F.col("h"), longest).alias("f")).head().f % (1 << 64) == want


def test_odd_rows(spark, odd_documents, no_documents):
    items = [(1, "One two three four five six seven"), (2, None), (3, ""), (4, "word")]
    items += [(None, "two three four five six"), (1, "One two three four five six seven")]
    benchmark = rows_of(spark, items, "item_id").withColumn("h", F.lit(1))
    found = d.contaminated(odd_documents, benchmark).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    assert got == {(1, 1): 1.0, (None, 1): 1.0, (6, 4): 1.0, (1, None): 1.0, (None, None): 1.0}
    kept = d.drop_contaminated(odd_documents, benchmark)
    assert kept.columns == odd_documents.columns
    # The row without an id and a text stays: it holds no copy of an item.
    left = [r.doc_id for r in kept.collect()]
    assert sorted(left, key=lambda x: -1 if x is None else x) == [None, 2, 3, 4, 5, 7]
    assert d.contaminated(no_documents, benchmark).count() == 0
    assert d.contaminated(odd_documents, benchmark.limit(0)).count() == 0
    assert d.drop_contaminated(odd_documents, benchmark.limit(0)).count() == 10


def test_rows_are_judged_by_their_own_text(spark):
    item = "One two three four five six seven"
    rows = [(None, item), (None, "clean text stays"), (None, ""), (3, item)]
    rows += [(3, "other words of three"), (3, f"so {item}"), (4, item.upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = d.drop_contaminated(docs, benchmark).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(
        [(None, "clean text stays"), (None, ""), (3, "other words of three")], key=repr
    )


def test_no_python_in_plan(spark, planted):
    docs, items = planted
    found = d.contaminated(rows_of(spark, docs, "doc_id"), rows_of(spark, items, "item_id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert "NestedLoop" not in plan


@pytest.mark.parametrize("seed", range(6))
def test_common_weight_by_definition(spark, seed):
    """Few and many different values, once and often."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(40):
        kinds = rnd.choice([1, 2, 30, 300])
        w, i = ([rnd.randrange(kinds) for _ in range(rnd.randrange(1, 120))] for _ in "wi")
        rows.append((w, i))
    df = spark.createDataFrame(rows, "w array<bigint>, i array<bigint>")
    found = df.select("w", "i", d.common_weight(F.col("w"), F.col("i")).alias("n")).collect()
    for r in found:
        assert r.n == sum(min(r.w.count(h), r.i.count(h)) for h in set(r.i))


def test_long_items_are_compared_in_time(spark):
    """Two arrays of 20,000 hashes: all different, in pairs, and all equal."""
    for kinds in (20_000, 10_000, 1):
        one = [k % kinds for k in range(20_000)]
        df = spark.createDataFrame([(one, one[::-1])], "w array<bigint>, i array<bigint>")
        began = time.time()
        assert df.select(d.common_weight(F.col("w"), F.col("i")).alias("n")).head().n == 20_000
        assert time.time() - began < 20
