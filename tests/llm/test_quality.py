from __future__ import annotations

from collections import Counter

from brute_force import words
from pyspark.sql import functions as F

from pairlab.llm import quality

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {
        k + j
        for k, g in enumerate(zip(w, w[1:], w[2:]))
        if grams[g] > 1
        for j in range(3)
    }
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (
        len(w),
        sum(map(len, w)),
        symbols,
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_counts(spark, odd_documents):
    texts = ["a b c a b c", "a a a a a", "a b c x a b c a", "x\nx\n\n \nx", "# a | b"]
    texts += ["a b c d a b c d", "é 漢字 é\x0bb", "a\x85b\xa0c", "|||", "a b"]
    more = spark.createDataFrame(
        [(100 + k, t) for k, t in enumerate(texts)], "doc_id bigint, text string"
    )
    rows = odd_documents.select("doc_id", "text").union(more).collect()
    want = sorted(((r.doc_id, *counts(r.text)) for r in rows), key=repr)
    both = odd_documents.unionByName(more, allowMissingColumns=True)
    found = quality.measures(both).select("doc_id", *COUNTS).collect()
    assert sorted(map(tuple, found), key=repr) == want


def test_verdicts(spark, no_documents):
    clean = " ".join(f"word{k} and{k}" for k in range(60))
    rows = [(1, clean), (2, "a b c " * 40), (3, "short"), (4, "%%% " + clean + " end")]
    rows += [(5, clean.replace(" ", "!! ")), (6, clean.replace(" ", " | ")), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in quality.judge(df).collect()}
    assert [k for k in found if found[k].kept] == [1, 4]
    assert [k for k in found if found[k].base_failed] == [2, 3, 7]
    assert quality.judge(no_documents).count() == 0


def test_order_is_rejections_by_cost(spark):
    sample = spark.range(1000).select(F.col("id").alias("x"))
    rules = {
        "never": F.col("x") < 0,
        "often": F.col("x") > 10,
        "costly": (F.col("x") > 10)
        & (F.aggregate(F.sequence(F.lit(1), F.lit(20_000)), F.lit(0), lambda a, x: F.greatest(a, x)) > 0),
    }
    assert quality.rule_order(sample, rules) == ["often", "costly", "never"]


def test_order_never_decides(spark):
    rules = quality.default_rules()
    rows = [(k, " ".join(f"word{chr(97 + j // 8)}{chr(97 + j % 8)}{'%' * (k % 3)}" for j in range(60))) for k in range(20)]
    df = quality.measures(spark.createDataFrame(rows, "doc_id bigint, text string"))
    kept = [
        df.where(quality.cascade(rules, order).isNull()).count()
        for order in (list(rules), list(rules)[::-1])
    ]
    assert kept[0] == kept[1] == 7


def test_later_rules_are_not_evaluated(spark):
    rules = {"first": F.col("x") >= 0, "second": F.raise_error(F.lit("asked")).isNull()}
    chain = quality.cascade(rules, ["first", "second"])
    assert spark.range(3).select(F.col("id").alias("x")).select(chain).count() == 3
    found = spark.range(3).select(F.col("id").alias("x")).select(chain.alias("r"))
    assert {r.r for r in found.collect()} == {"first"}
