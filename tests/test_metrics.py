from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlab.operators import metrics, textmetrics

RELAXED = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))


def table(spark, pairs):
    return spark.createDataFrame([(float(x), float(y)) for x, y in pairs], "x double, y double")


def measured(spark, pairs):
    df = table(spark, pairs)
    bundles = {"m": ("x", "y", metrics.DELTA_METRICS)}
    return metrics.evaluate_bundles(df, [], bundles).head()


def test_bundle_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=200), 1)
    y = np.round(x + rng.normal(size=200), 1)
    found = measured(spark, zip(x, y))

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert found["m_pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert found["m_spearman"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert found["m_rmse"] == pytest.approx(np.sqrt(((x - y) ** 2).mean()))
    assert found["m_mae"] == pytest.approx(np.abs(x - y).mean())
    assert found["m_sign_accuracy"] == pytest.approx((np.sign(x) == np.sign(y)).mean())


def test_constant_and_single_rows_give_zero_correlation(spark):
    for pairs in ([(1, 5), (2, 5), (3, 5)], [(1, 2)], [(0.1, 1)] * 3):
        found = measured(spark, pairs)
        assert (found["m_pearson"], found["m_spearman"]) == (0.0, 0.0)


def test_no_rows(spark):
    found = measured(spark, [])
    assert (found["m_pearson"], found["m_spearman"], found["m_rmse"]) == (0.0, 0.0, None)


def test_signs(spark):
    pairs = [(0, 0), (0, 1), (-1, -2), (float("nan"), float("nan")), (float("nan"), 1)]
    df = table(spark, pairs).select(metrics.sign_accuracy(F.col("x"), F.col("y")))
    assert df.head()[0] == pytest.approx(2 / 5)


WORDS = st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=12)


def lcs(left, right):
    grid = np.zeros((len(left) + 1, len(right) + 1), dtype=int)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            grid[i + 1, j + 1] = grid[i, j] + 1 if a == b else max(grid[i, j + 1], grid[i + 1, j])
    return int(grid[-1, -1])


def f1(shared, n, m):
    if n == m == 0:
        return 1.0
    return 0.0 if shared == 0 else 2 * (shared / n) * (shared / m) / (shared / n + shared / m)


@RELAXED
@given(st.lists(st.tuples(WORDS, WORDS), min_size=10, max_size=30))
def test_overlap_and_lcs_against_brute_force(spark, pairs):
    rows = [(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, prediction string, reference string")
    found = textmetrics.score_texts(df, ["token_f1", "rouge_l_f1"]).collect()
    for row in found:
        a, b = pairs[row["i"]]
        shared = sum((Counter(a) & Counter(b)).values())
        assert row["token_f1"] == pytest.approx(f1(shared, len(a), len(b)))
        assert row["rouge_l_f1"] == pytest.approx(f1(lcs(a, b), len(a), len(b)))


def test_lcs_of_long_texts():
    left = [str(i % 97) for i in range(3000)]
    right = [str(i % 89) for i in range(2500)]
    codes = [np.array([int(w) for w in words]) for words in (left, right)]
    assert textmetrics._lcs(*codes) == lcs(left, right)
    assert textmetrics._lcs(codes[0], codes[0]) == 3000


def scored(spark, metric, prediction, reference):
    df = spark.createDataFrame([(prediction, reference)], "prediction string, reference string")
    return textmetrics.score_texts(df, [metric]).head()[metric]


@pytest.mark.parametrize(
    ("metric", "prediction", "reference", "expected"),
    [
        ("exact_match", " Hello\n World ", "hello world", 1.0),
        ("exact_match", "a", "b", 0.0),
        ("conala_exact_match", "X", "x", 1.0),
        ("gsm8k_answer_accuracy", "so 1,234", "#### 1234", 1.0),
        ("gsm8k_answer_accuracy", "42", "42.0", 0.0),
        ("gsm8k_answer_accuracy", "none", "none", 0.0),
        ("sql_exact_match", "SELECT 1;", "select  1", 1.0),
        ("sql_exact_match", "select 1 ;", "select 1", 0.0),
        ("token_f1", "", "", 1.0),
        ("token_f1", "a", "!", 0.0),
        ("token_f1", "été a", "été b", 0.5),
        ("rouge_l_f1", "the cat sat", "the cat sat", 1.0),
        ("rouge_l_f1", "...", "", 1.0),
    ],
)
def test_text_metrics(spark, metric, prediction, reference, expected):
    assert scored(spark, metric, prediction, reference) == expected


def test_evaluation(spark):
    rows = [("the answer is 4", "4"), ("5", "6")]
    df = spark.createDataFrame(rows, "prediction string, reference string")
    options = {"name": "math", "metrics": ["gsm8k_answer_accuracy", "rouge_l_f1"]}
    found = textmetrics.evaluate_texts(df, options).head()
    assert (found["evaluation"], found["num_examples"]) == ("math", 2)
    assert (found["metric_name"], found["metric_value"]) == ("gsm8k_answer_accuracy", 0.5)
    with pytest.raises(Exception, match="no predictions"):
        textmetrics.evaluate_texts(df.limit(0), options).collect()


@pytest.mark.parametrize(
    ("options", "message"),
    [
        ({"metrics": ["bleu"]}, "bleu is none of"),
        ({"metrics": []}, "needs a list"),
        ({"metrics": ["token_f1"], "primary_metric": "exact_match"}, "not among"),
        ({"k": 1}, "does not know"),
    ],
)
def test_bad_evaluations(options, message):
    with pytest.raises(ValueError, match=message):
        textmetrics.evaluation_from(options)
