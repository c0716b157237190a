from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import filters, projection, selection
from pairlab.operators import vectors as vec


def table(spark, matrix):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(matrix)]
    df = spark.createDataFrame(rows, "row_id int, features array<double>")
    return df.withColumn("features", F.col("features").cast("array<float>"))


def matrix(df):
    rows = df.orderBy("row_id").select("features").collect()
    return np.array([r["features"] for r in rows])


def test_thresholded_sign(spark):
    df = table(spark, [[0.02, -0.02, 0.005, -0.005, float("nan"), 0.01]])
    found = df.withColumn("features", vec.Chain.read("thresholded-sign").over(F.col("features")))
    assert matrix(found).tolist() == [[1, -1, 0, 0, 0, 0]]
    params = {"thresholded_sign": {"threshold": 0.1}}
    wide = table(spark, [[0.05, -0.05, 0.2, -0.2]])
    found = wide.withColumn("features", vec.Chain.read(["Thresholded_Sign"], params).over(F.col("features")))
    assert matrix(found).tolist() == [[0, 0, 1, -1]]
    with pytest.raises(ValueError, match="cannot be negative"):
        vec.thresholded_sign(F.col("features"), -1)


def test_names_and_params():
    assert vec.Chain.read(None).names == ("identity",)
    assert vec.Chain.read(" sign, Thresholded-Sign,").names == ("sign", "thresholded_sign")
    assert vec.Chain.read([]).names == ("identity",)
    assert vec.Chain.read(None, None, 0.5).params == {"thresholded_sign": {"threshold": 0.5}}
    given = {"thresholded-sign": {"threshold": 0.1}}
    assert vec.Chain.read(None, given, 0.5).params == {"thresholded_sign": {"threshold": 0.1}}
    assert vec.Chain.read("identity").label == "raw"
    assert vec.Chain.read("sign,thresholded_sign", given).label == "sign+thresholded_sign(threshold=0.1)"
    assert vec.Chain.read("thresholded_sign").label == "thresholded_sign"


def test_wrong_parameters_are_named(spark):
    for params in ({"sign": {"power": 2}}, {"sign": 3}, {"sign": {"threshold": 1}}):
        with pytest.raises((ValueError, TypeError)):
            vec.Chain.read("sign", params).over(F.col("features"))
    with pytest.raises(ValueError, match="cannot be negative"):
        vec.Chain.read("thresholded_sign", None, -1).over(F.col("features"))


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="No transformation named"):
        vec.Chain.read("cube").over(F.col("features"))
    with pytest.raises(ValueError, match="No projection named"):
        projection.project_features(table(spark, [[1]]), "pca")


def dense(spark, dim, k, seed):
    """The matrix draw by draw."""
    result, matrix = np.zeros((dim, k)), projection.SparseMatrix(dim, k, seed)
    for c in range(k):
        at, i = 0, 0
        while True:
            key = (((c + seed * 1_000_003 % 2**32) << 32) + i) % 2**64
            z = int(projection._mixed(np.array([key], np.uint64))[0])
            uniform = ((z >> 11) + 0.5) / 2**53
            at += int(np.floor(np.log(uniform) / np.log1p(-matrix.density))) if dim > 1 else 0
            if at >= dim:
                break
            result[at, c] = matrix.size * (-1 if z & 1 else 1)
            at, i = at + 1, i + 1
    return result


def test_projection_is_the_matrix_product(spark, monkeypatch):
    points = np.random.default_rng(0).normal(size=(20, 30))
    df = table(spark, points)
    expected = matrix(df) @ dense(spark, 30, 6, 9)
    whole = matrix(projection.project_features(df, "sparse_random", 6, 9))
    assert np.allclose(whole, expected, atol=1e-5)
    monkeypatch.setattr(projection, "BATCH_VALUES", 42)
    monkeypatch.setattr(projection, "HELD_ENTRIES", 3)
    monkeypatch.setattr(projection.SparseMatrix, "draws", lambda self: 2)
    blocked = matrix(projection.project_features(df, "sparse_random", 6, 9))
    assert np.allclose(blocked, whole, atol=1e-6)


def test_projection_keeps_distances_roughly(spark):
    found = dense(spark, 400, 300, 1)
    assert (found != 0).mean() == pytest.approx(1 / 20, rel=0.1)
    norms = np.linalg.norm(np.eye(400) @ found, axis=1)
    assert norms.mean() == pytest.approx(1, abs=0.1)


def test_a_million_features(spark):
    """Nothing of the matrix is held, collected or limited."""
    points = np.zeros((3, 1_000_000), np.float32)
    points[0, ::7], points[1, 5], points[2] = 1, 2, 0.5
    df = table(spark, points)
    found = matrix(projection.project_features(df, "sparse_random", 32, 3))
    entries = projection.SparseMatrix(1_000_000, 32, 3)
    features, signs, starts = entries.entries(0, 32)
    expected = np.add.reduceat(points[:, features] * signs, starts, axis=1) * entries.size
    assert np.allclose(found, expected, atol=1e-3)
    assert len(features) == pytest.approx(32_000, rel=0.05)


def test_default_components(spark):
    assert projection.default_components(3) == 3
    assert projection.default_components(5000) == 1024
    assert matrix(projection.project_features(table(spark, np.eye(3)), "sparse_random", 2)).shape == (3, 2)


def test_memory_guard(spark):
    df = table(spark, np.eye(4))
    with pytest.raises(ValueError, match="Project them first"):
        projection.prepare_features(df, max_bytes=10)
    projection.prepare_features(df, max_bytes=0)
    projection.prepare_features(df, projection="sparse_random", components=2, max_bytes=10)
    filters.check_feature_bytes(4, 4, 64)


def test_assemble(spark):
    rows = [
        ("p", 2, "m.lora_b", [3.0, 4.0]),
        ("p", 1, "m.lora_a", [9.0]),
        ("p", 0, "k.lora_b", [1.0, 2.0]),
        ("q", 0, "m.lora_a", [5.0]),
    ]
    df = spark.createDataFrame(rows, "pair_id string, leaf_order int, leaf_name string, values array<float>")
    found = vec.assemble_features(df.where("pair_id = 'p'")).head()
    assert found["features"] == [1.0, 2.0, 3.0, 4.0]
    every = {r["pair_id"]: r["features"] for r in vec.assemble_features(df, "all").collect()}
    assert every == {"p": [1.0, 2.0, 9.0, 3.0, 4.0], "q": [5.0]}
    with pytest.raises(Exception, match="No leaf of this pair"):
        vec.assemble_features(df).collect()


def ids(df):
    return sorted(r["row_id"] for r in df.collect())


def test_kmeans_takes_one_row_from_each_side(spark):
    df = table(spark, [[0.0], [0.1], [10.0], [10.1]])
    found = ids(selection.select_by_kmeans(df, df, 2, n_init=3, max_iter=20))
    assert len(found) == 2
    assert found[0] in (0, 1) and found[1] in (2, 3)


@pytest.mark.parametrize("band", [1, 4])
def test_lloyd_moves_all_runs(spark, monkeypatch, band):
    """Against plain steps; bands of centres leave no nearer one out."""
    monkeypatch.setattr(selection, "GUESSED", band)
    monkeypatch.setattr(selection, "GROUP_ROWS", 16)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 3)) * rng.choice([0.1, 1, 9], (300, 1))).astype(np.float32)
    starts = np.stack([x[:12], x[40:52], x[90:102]]).astype(float)
    found, costs = selection.lloyd(table(spark, x), starts, 4, 0.0)
    for run, centres in enumerate(starts):
        for _ in range(4):
            d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
            near, cost = d.argmin(axis=1), d.min(axis=1).sum()
            centres = np.array([x[near == k].mean(axis=0, dtype=float) if (near == k).any() else centres[k] for k in range(12)])
        assert np.allclose(found[run], centres, atol=1e-5) and costs[run] == pytest.approx(cost, rel=1e-6)


def test_equal_rows_still_give_centres(spark):
    df = table(spark, [[1.0, 2.0]] * 5)
    assert selection.kmeans_centres(df, 2, n_init=2).tolist() == [[1.0, 2.0]] * 2


def test_kmeans_edges(spark):
    df = table(spark, [[0.0], [1.0], [2.0]])
    assert ids(selection.select_by_kmeans(df, df, 3)) == [0, 1, 2]
    assert ids(selection.select_by_kmeans(df, df, None)) == [0, 1, 2]
    assert ids(selection.select_by_kmeans(df, df, 0)) == []
    with pytest.raises(ValueError, match="Project them first"):
        selection.select_by_kmeans(df, df, 2, max_bytes=4)


def test_representatives_are_filled_up(spark):
    """Two centres share their nearest row, so the next closest row fills in."""
    df = table(spark, [[0.0], [1.0], [5.0], [1.5]])
    centres = np.array([[0.9], [1.1], [5.0]])
    assert ids(selection.representative_ids(df, centres, 3)) == [1, 2, 3]


def test_nearest_rows_ties_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(size=(60, 4)), np.ones((3, 4))])
    centres = np.vstack([rng.normal(size=(7, 4)), np.ones((1, 4))])
    df = table(spark, points).repartition(5)
    points = matrix(df)
    full = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    for chunk in (10**6, 20):
        monkeypatch.setattr(selection, "CHUNK_VALUES", chunk)
        near = {r["centre"]: r["row_id"] for r in selection.nearest_rows(df, centres).collect()}
        assert near == dict(enumerate(full.argmin(axis=0)))
        own = {r["row_id"]: r["centre"] for r in selection.own_centre(df, centres).collect()}
        assert own == dict(enumerate(full.argmin(axis=1)))


def test_selectors(spark):
    df = spark.range(20).withColumnRenamed("id", "row_id")
    assert ids(selection.run_selector("identity", df, 3)) == list(range(20))
    assert len(ids(selection.run_selector("random", df, 5, {"seed": 1}))) == 5
    assert ids(selection.run_selector("random", df, 0)) == []
    assert ids(selection.run_selector(lambda rows, max_example: rows.where("row_id < 2"), df, 3)) == [0, 1]
    with pytest.raises(ValueError, match="gave NoneType"):
        selection.run_selector(lambda rows, max_example: None, df, 3)


def test_sampled_train(spark):
    pairs = spark.range(10).select(F.col("id").alias("row_id"), F.when(F.col("id") < 8, "train").otherwise("test").alias("split"))
    found = selection.sample_train(pairs, "random", 3)
    counts = {r["split"]: (r["original_examples"], r["selected_examples"]) for r in selection.sample_counts(pairs, found).collect()}
    assert counts == {"train": (8, 3), "test": (2, 2)}


@pytest.mark.parametrize(
    ("policy", "base", "selected", "original", "options", "expected"),
    [
        ("match_full_exposure", 1000, 128, 2000, {}, 64),
        ("per_example", 1000, 1, 2000, {"min_iters": 50}, 50),
        ("match_full_passes", 100, 300, 100, {}, 100),
        ("match_full_passes", 100, 300, 100, {"cap_at_full": False}, 300),
        ("none", 100, 1, 100, {}, 100),
        ("per_example", 100, 0, 100, {}, 100),
    ],
)
def test_scaled_iterations(spark, policy, base, selected, original, options, expected):
    values = [F.lit(v).cast("bigint") for v in (base, selected, original)]
    made = selection.scaled_iterations(policy, *values, **options)
    assert spark.range(1).select(made).head()[0] == expected


def test_bad_policies():
    for policy, options in (("double", {}), ("per_example", {"min_iters": 0})):
        with pytest.raises(ValueError, match="scaling policy|min_iters"):
            selection.scaled_iterations(policy, None, None, None, **options)
