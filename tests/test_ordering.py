from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlab.operators import ordering, splits


def rows(spark, n, partitions=3):
    return spark.range(n, numPartitions=partitions).withColumn("v", F.col("id") % 7)


def by_hash(n, seed):
    def order(i):
        return hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()

    return sorted(range(n), key=order)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("size", [0, 1, 40, 99, 100, 5000])
def test_subset_is_the_head_of_the_seeded_order(spark, size):
    expected = sorted(by_hash(100, 42)[:size])
    assert ids(splits.take_subset(rows(spark, 100), size, ["id"])) == expected


def test_subset_does_not_depend_on_partitioning(spark):
    one = splits.take_subset(rows(spark, 300, 1), 50, ["id"], 3)
    many = splits.take_subset(rows(spark, 300, 17), 50, ["id"], 3)
    assert ids(one) == ids(many)


@settings(
    max_examples=12, deadline=None, suppress_health_check=list(HealthCheck)
)
@given(n=st.integers(3, 60), valid=st.integers(1, 45), test=st.integers(1, 45))
def test_three_way_split_counts(spark, n, valid, test):
    valid, test = valid / 100, test / 100
    found = splits.train_valid_test(rows(spark, n), ["id"], valid, test)
    parts = {}
    for row in found.collect():
        parts.setdefault(row["split"], set()).add(row["id"])
    tests = max(1, min(n - 1, round(n * test)))
    left = n - tests
    valids = max(1, min(left - 1, round(left * (valid / (1.0 - test)))))
    assert len(parts["test"]) == tests
    assert len(parts["valid"]) == valids
    assert len(parts.get("train", ())) == left - valids
    assert set.union(*parts.values()) == set(range(n))


def test_split_needs_two_rows(spark):
    with pytest.raises(Exception, match="needs two rows"):
        splits.train_test(rows(spark, 1), 0.5, ["id"]).collect()
    with pytest.raises(ValueError):
        splits.train_test(rows(spark, 5), 1.5, ["id"])
    with pytest.raises(ValueError):
        splits.train_valid_test(rows(spark, 9), ["id"], 0.5, 0.5)


def test_absolute_test_count(spark):
    found = splits.train_test(rows(spark, 10), 3, ["id"])
    assert found.where("split = 'test'").count() == 3


def test_missing_split_is_an_error(spark):
    df = rows(spark, 5).withColumn("split", F.lit("train"))
    with pytest.raises(Exception, match="No published split named"):
        splits.existing_splits(df).collect()


def test_first_alias_wins(spark):
    names = F.element_at(F.array(*map(F.lit, ("train", "val", "valid", "test"))), F.col("id").cast("int") + 1)
    df = spark.range(4).withColumn("split", names)
    found = {r["id"]: r["split"] for r in splits.existing_splits(df).collect()}
    assert found == {0: "train", 2: "valid", 3: "test"}


def test_caps_are_per_split(spark):
    df = rows(spark, 50).withColumn("split", F.when(F.col("id") < 30, "a").otherwise("b"))
    found = splits.cap_splits(df, {"a": 4, "b": 100}, ["id"]).groupBy("split").count()
    assert {r["split"]: r["count"] for r in found.collect()} == {"a": 4, "b": 20}


def test_global_index_over_many_buckets(spark, small_buckets):
    df = rows(spark, 500, 5).withColumn("s", (F.col("id") * 37 % 11).cast("string"))
    found = small_buckets.global_index(df, ["s", "id"]).collect()
    expected = sorted(found, key=lambda r: (r["s"], r["id"]))
    assert [r["row_index"] for r in expected] == list(range(500))


def test_long_rows_move_in_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering, "LONG_ROWS_PER_BUCKET", 20)
    key = F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("k")
    short = spark.range(500).select("id", key)
    assert ordering.range_bucket(short, ["k", "id"], moved=True) is ordering._one_bucket
    long = short.withColumn("text", F.repeat(F.lit("x"), F.col("id").cast("int")))
    bucket = ordering.range_bucket(long, ["k", "id"], moved=True)
    sizes = long.groupBy(bucket(ordering.natural_order(["k", "id"]))).count().collect()
    assert len(sizes) >= 20 and max(r["count"] for r in sizes) <= 60
    found = ordering.global_index(long, ["k", "id"]).collect()
    expected = sorted(found, key=lambda r: (-1 if r["k"] is None else r["k"], r["id"]))
    assert [r["row_index"] for r in expected] == list(range(500))
    assert all(len(r["text"]) == r["id"] for r in found)


def test_global_index_per_group(spark, small_buckets):
    df = rows(spark, 200)
    found = small_buckets.global_index(df, ["id"], by=["v"]).collect()
    assert all(r["row_index"] == r["id"] // 7 for r in found)


def test_row_range(spark, small_buckets):
    df = rows(spark, 200)
    assert ids(small_buckets.rows_between(df, ["id"], 30, 90)) == list(range(30, 90))
    assert ids(small_buckets.rows_between(df, ["id"], 150, None)) == list(range(150, 200))
    assert ids(small_buckets.rows_between(df, ["id"], 190, 900)) == list(range(190, 200))
    assert ids(small_buckets.rows_between(df, ["id"], 300, 310)) == []
    assert ids(small_buckets.rows_between(df, ["id"], 5, 5)) == []


def test_decimate(spark, small_buckets):
    assert ids(splits.decimate(rows(spark, 230), ["id"], 50)) == list(range(0, 230, 4))
    assert ids(splits.decimate(rows(spark, 50), ["id"], 50)) == list(range(50))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_average_rank_of_a_hot_value(spark, small_buckets, by):
    """A third of all rows share one value; both paths give the same ranks."""
    value = F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 17 % 50).cast("double"))
    df = spark.range(300).select("id", value.alias("x"), (F.col("id") % 2).alias("g"))
    many = small_buckets.average_ranks(df, {"x": "r"}, by)
    found = {r["id"]: r["r"] for r in many.collect()}
    frame = df.toPandas()
    grouped = frame.groupby("g")["x"] if by else frame["x"]
    ranks = grouped.rank(method="average")
    assert found == dict(zip(frame["id"], ranks))


def test_seeded_hash_is_plain_sha256(spark):
    got = spark.range(1).select(ordering.seeded_hash(7, ["id"]).alias("h")).head()["h"]
    assert got == hashlib.sha256(b"7|0").hexdigest()


def test_large_tables_rank_several_columns(spark, small_buckets):
    half = F.when(F.col("id") % 2 == 0, 1.0)
    df = spark.range(240).select(
        "id", half.otherwise(F.col("id") / 3).alias("x"), (F.col("id") % 5).alias("y")
    )
    found = small_buckets.average_ranks(df, {"x": "rx", "y": "ry"}).toPandas()
    assert len(found) == 240
    assert (found["rx"] == found["x"].rank()).all()
    assert (found["ry"] == found["y"].rank()).all()


def nulls(spark, n=40):
    """A fourth of the groups and of the values null."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 4 > 0, F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 7).cast("double")).alias("x"),
    )


@pytest.mark.parametrize("buckets", [20, 1_000_000])
def test_null_groups_and_values_have_ranks(spark, monkeypatch, buckets):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", buckets)
    found = ordering.average_ranks(nulls(spark), {"x": "r"}, ["g"]).toPandas()
    frame = nulls(spark).toPandas().fillna(-1.0)
    want = frame.groupby("g")["x"].rank(method="average")
    got = found.sort_values("id")["r"].to_numpy()
    assert (got == want.to_numpy()).all()


@pytest.mark.parametrize("buckets", [5, 1_000_000])
def test_null_groups_keep_their_rows(spark, monkeypatch, buckets):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", buckets)
    found = ordering.global_index(nulls(spark), ["id"], by=["g"]).toPandas()
    want = found.sort_values("id").groupby("g", dropna=False).cumcount()
    assert len(found) == 40
    assert (found.sort_values("id")["row_index"].to_numpy() == want.to_numpy()).all()


def test_caps_keep_rows_of_a_null_split(spark):
    df = nulls(spark).withColumn("split", F.when(F.col("id") % 4 > 0, "a"))
    assert splits.cap_splits(df, 100, ["id"]).count() == 40
    found = splits.cap_splits(df, 3, ["id"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in found} == {"a": 3, None: 3}


@pytest.mark.parametrize("size", [255, 256, 257, 300])
def test_subset_with_a_null_key(spark, size):
    key = F.when(F.col("id") > 0, F.col("id")).alias("k")
    df = spark.range(300).select("id", key)
    assert splits.take_subset(df, size, ["k"]).count() == size
