from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import krr
from pairlab.plans.experiment import ExperimentConfig, run_experiment


def table(spark, x, *targets, partitions=3):
    rows = [(i, [float(v) for v in row], *[float(t[i]) for t in targets]) for i, row in enumerate(x)]
    names = ", ".join(f"y{n} double" for n in range(len(targets)))
    df = spark.createDataFrame(rows, f"pair_id int, features array<double>, {names}")
    return df.repartition(partitions)


def predicted(model, df, count=1):
    names = [f"p{n}" for n in range(count)]
    rows = model.predict(df, names=names).orderBy("pair_id").collect()
    return np.array([[r[n] for n in names] for r in rows])


def dual_solution(x, y, ridge):
    """The textbook dual fit on the full kernel."""
    n = len(x)
    system = x @ x.T + n * ridge * np.eye(n)
    jitter = 1e-12 * max(np.trace(system) / n, 1.0)
    return x @ x.T @ np.linalg.solve(system + jitter * np.eye(n), y)


def test_identity_kernel_recovers_targets(spark):
    target = np.array([1.0, -1.0, 0.5, 2.0])
    df = table(spark, np.eye(4), target)
    model = krr.fit_dual(df, ["y0"], ridge_lambda=1e-6)
    assert np.allclose(predicted(model, df)[:, 0], target, atol=1e-4)


def test_primal_equals_dual_for_several_targets(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 6)), rng.normal(size=(80, 2))
    df = table(spark, x, *y.T, partitions=5)
    model = krr.fit_dual(df, ["y0", "y1"], ridge_lambda=0.1)
    assert np.allclose(predicted(model, df, 2), dual_solution(x, y, 0.1), atol=1e-9)


@pytest.mark.parametrize(("rows", "dim"), [(12, 50), (50, 12), (40, 40)])
def test_conjugate_gradients_equal_the_dual(spark, monkeypatch, rows, dim):
    monkeypatch.setattr(krr, "MAX_SOLVE", 5)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(rows, dim)), rng.normal(size=(rows, 2))
    df = table(spark, x, *y.T)
    model = krr.fit_dual(df, ["y0", "y1"], ridge_lambda=0.05)
    assert np.allclose(predicted(model, df, 2), dual_solution(x, y, 0.05), atol=1e-7)


def test_hard_systems_are_sketched(spark, monkeypatch):
    """Few strong directions across the features, which scaling alone doesn't see."""
    monkeypatch.setattr(krr, "MAX_SOLVE", 5)
    rng = np.random.default_rng(4)
    mix = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    x = rng.normal(size=(90, 60)) * np.logspace(2, -2, 60) @ mix
    y = rng.normal(size=(90, 1))
    df = table(spark, x, *y.T)
    model = krr.fit_dual(df, ["y0"], ridge_lambda=1e-3)
    assert model.details["sketched"] and model.details["residual"] <= krr.CG_TOLERANCE
    assert model.details["steps"] <= krr.PLAIN_STEPS + 40
    assert np.allclose(predicted(model, df), dual_solution(x, y, 1e-3), atol=1e-6)


def test_features_of_very_different_size(spark, monkeypatch):
    """Orthogonal features are solved by their scales alone."""
    monkeypatch.setattr(krr, "MAX_SOLVE", 5)
    x = np.vstack([np.diag(np.logspace(-4, 4, 12))] * 2)
    y = np.random.default_rng(6).normal(size=(24, 1))
    df = table(spark, x, *y.T)
    model = krr.fit_dual(df, ["y0"], ridge_lambda=1e-2)
    assert not model.details["sketched"] and model.details["steps"] <= 2
    assert np.allclose(predicted(model, df), dual_solution(x, y, 1e-2), atol=1e-9)


def test_bad_values_leave_the_others(spark, monkeypatch):
    """A row with NaN counts as zero there, the same in all three fits."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    target = x @ rng.normal(size=6)
    dirty = x.copy()
    dirty[7, 2], dirty[9, 0] = np.nan, np.nan
    df, clean = table(spark, dirty, target), np.nan_to_num(dirty)
    want = dual_solution(clean, target[:, None], 0.1)
    for most in (4096, 2):
        monkeypatch.setattr(krr, "MAX_SOLVE", most)
        model = krr.fit_dual(df, ["y0"], ridge_lambda=0.1)
        assert np.allclose(predicted(model, df), want, atol=1e-7)
    monkeypatch.setattr(krr, "MAX_SOLVE", 4096)
    model = krr.fit_nystrom(df, ["y0"], 0.1, 60, 60)
    assert np.allclose(predicted(model, df), want, atol=1e-6)


@pytest.mark.parametrize(("dim", "solve"), [(8, 10), (30, 10)])
def test_more_landmarks_than_the_driver_solves(spark, monkeypatch, dim, solve):
    """Landmarks that stay on the executors give the same components."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(70, dim)) * np.logspace(1, -1, dim)
    y = rng.normal(size=(70, 1))
    df = table(spark, x, *y.T)
    want = predicted(krr.fit_nystrom(df, ["y0"], 0.1, 40, 6), df)
    monkeypatch.setattr(krr, "MAX_SOLVE", solve)
    model = krr.fit_nystrom(df, ["y0"], 0.1, 40, 6)
    assert model.details["num_landmarks"] == 40 and model.details["rank"] == 6
    assert np.allclose(predicted(model, df), want, atol=1e-6)


def nystrom_solution(x, y, points, rank, ridge):
    values, vectors = np.linalg.eigh(points @ points.T)
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    values = np.maximum(values, max(1e-12, 1e-10 * max(values.max(), 1.0)))
    phi = x @ points.T @ (vectors / np.sqrt(values))
    system = phi.T @ phi + len(x) * ridge * np.eye(rank)
    return phi @ np.linalg.solve(system, phi.T @ y)


@pytest.mark.parametrize("rank", [1, 3, 8, 99])
def test_nystrom_against_numpy(spark, rank):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 10)), rng.normal(size=(60, 1))
    df = table(spark, x, y[:, 0])
    chosen = krr.select_landmarks(df, 8, ["pair_id"], seed=4)
    places = sorted(r["pair_id"] for r in chosen.collect())
    model = krr.fit_nystrom(df, ["y0"], 0.1, 8, rank, seed=4)
    expected = nystrom_solution(x, y, x[places], min(rank, 8), 0.1)
    assert np.allclose(predicted(model, df), expected, atol=1e-8)
    assert (model.details["rank"], model.details["num_landmarks"]) == (min(rank, 8), 8)


def test_nystrom_with_more_landmarks_than_rows(spark):
    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    df = table(spark, x, np.array([1.0, 2.0, 3.0]))
    model = krr.fit(df, "Nystrom", targets=["y0"], num_landmarks=32, rank=2)
    assert np.isfinite(predicted(model, df)).all() and model.details["num_landmarks"] == 3


def test_landmark_counts(spark):
    df = table(spark, np.eye(4), np.ones(4))
    for count in (0, 5):
        with pytest.raises(ValueError, match="Cannot take"):
            krr.select_landmarks(df, count, ["pair_id"])
    with pytest.raises(ValueError, match="No kernel method"):
        krr.fit(df, "svm")


def test_kernel_is_tamed(spark):
    df = table(spark, [[float("nan"), 1.0], [1e308, 1e308]], np.ones(2))
    found = krr.linear_kernel(df, np.array([[1.0, 1.0], [10.0, 10.0]])).orderBy("pair_id")
    kernels = [r["kernel"] for r in found.collect()]
    assert kernels[0] == [0.0, 0.0]
    assert kernels[1][1] == 1e12


SPLITS = ("train", "valid", "test")


def experiment_tables(spark, n=90):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        x = rng.normal(size=3)
        base = float(rng.normal())
        delta = float(x @ [0.5, -1.0, 2.0] + 0.01 * rng.normal())
        rows.append((f"p{i:03d}", SPLITS[i % 3], "p", "c", base, base + delta, x.tolist()))
    schema = "pair_id string, split string, prompt string, completion string, base double, variant double, features array<double>"
    df = spark.createDataFrame(rows, schema)
    scores = [df.select("pair_id", "split", F.col(c).alias("score")) for c in ("base", "variant")]
    return df.drop("base", "variant", "features"), *scores, df.select("pair_id", "split", "features")


@pytest.mark.parametrize("method", ["dual", "nystrom"])
def test_experiment(spark, method):
    config = ExperimentConfig(run_name="r", method=method, ridge_lambda=1e-4, limits={"train": 0, "valid": 10, "test": 20})
    result = run_experiment(*experiment_tables(spark), config)
    rows = {r["split"]: r for r in result.metrics.collect()}
    assert {s: rows[s]["num_examples"] for s in SPLITS} == {"train": 30, "valid": 10, "test": 20}
    assert rows["test"]["delta_pearson"] > 0.99
    assert rows["test"]["delta_rmse_gain"] > 0
    assert rows["test"]["baseline_delta_pearson"] == 0.0
    found = result.predictions.where("split = 'train'").toPandas()
    assert found["baseline_score_delta"].iloc[0] == pytest.approx(found["score_delta"].mean())
    summary = result.summary.head()
    assert summary["split_sizes"].asDict() == {"train": 30, "valid": 10, "test": 20}
    assert summary["test_delta_pearson"] == pytest.approx(rows["test"]["delta_pearson"])
    baseline = summary["eval"]["test"]["baseline"]["delta"]
    assert baseline["rmse"] == pytest.approx(rows["test"]["baseline_delta_rmse"])
    assert (summary["feature_transform_label"], summary["feature_dim"]) == ("raw", 3)
    mean = found["score_delta"].mean()
    assert summary["baseline"]["train_mean_delta"] == pytest.approx(mean)
    assert summary["fit_details"]["rows"] == 30


def test_experiment_takes_all_rows_by_default(spark):
    result = run_experiment(*experiment_tables(spark, 450), ExperimentConfig())
    assert result.predictions.count() == 450


def test_experiment_with_transforms(spark):
    config = ExperimentConfig(transformations="sign", projection="sparse_random", projection_components=2, limits=dict.fromkeys(SPLITS, 0))
    summary = run_experiment(*experiment_tables(spark), config).summary.head()
    assert (summary["feature_transform_label"], summary["feature_dim"]) == ("sign", 2)


def test_incomplete_inputs(spark):
    pairs, base, variant, features = experiment_tables(spark)
    config = ExperimentConfig(limits=dict.fromkeys(SPLITS, 0))
    with pytest.raises(ValueError, match="base_score"):
        run_experiment(pairs, base.where("pair_id <> 'p003'"), variant, features, config)
    with pytest.raises(ValueError, match="features"):
        run_experiment(pairs, base, variant, features.where("pair_id <> 'p004'"), config)
    blank = pairs.withColumn("prompt", F.when(F.col("pair_id") == "p002", " ").otherwise("p"))
    with pytest.raises(ValueError, match="empty prompt: test \\(p002\\)"):
        run_experiment(blank, base, variant, features, config)


def test_wide_rows_of_zeros_are_written_by_their_other_cells(spark, monkeypatch):
    monkeypatch.setattr(krr, "MAX_SOLVE", 5)
    random = np.random.default_rng(3)
    x = random.normal(size=(80, 40))
    x[:50] *= random.random((50, 40)) < 0.05
    x[0] = 0.0
    x[1], x[2, 7], x[2, 8] = 0.0, np.nan, np.inf
    x[1, 39] = 2.0
    y = random.normal(size=(80, 2))
    df = table(spark, x, y[:, 0], y[:, 1])
    known = krr.tame(x)
    known[2, 8] = 0.0  # as in the written rows below
    own = df.select(F.col("features").alias("x"), "pair_id")
    held = {r["pair_id"]: r for r in krr._packed(own, 40).collect()}
    assert len(held) == 80
    for k, row in enumerate(x):
        some = held[k]
        if (row != 0).sum() * krr.SPARSE > 40:
            assert some["at"] is None and some["x"] == pytest.approx(row, nan_ok=True)
        else:
            assert some["at"] == np.flatnonzero(row).tolist()
            assert some["x"] == pytest.approx(row[row != 0], nan_ok=True)
    x[2, 8] = 0.0
    df = table(spark, x, y[:, 0], y[:, 1])
    model = krr.fit_dual(df, ["y0", "y1"], 0.1)
    assert model.details["rows"] == 80
    system = known.T @ known + 8.0 * np.eye(40)
    assert model.weights == pytest.approx(np.linalg.solve(system, known.T @ y), abs=1e-8)
    found = model.predict(df, names=["p", "q"], keep=["pair_id"])
    assert found.columns == ["pair_id", "p", "q"]
    for row in found.collect():
        assert [row["p"], row["q"]] == pytest.approx(known[row["pair_id"]] @ model.weights)


def test_row_counts_of_many_tasks_are_exact(spark, monkeypatch):
    """Sums of Summarizer may end a rounding below the whole number."""
    monkeypatch.setattr(krr, "_sum_rows", lambda _: {0: np.ones(3), -1: np.array([14998.999999999998, 3.0])})
    df = table(spark, np.ones((4, 2)), np.ones(4))
    assert krr.normal_equations(df, ["y0"]).rows == 14999
