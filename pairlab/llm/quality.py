"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, pick

#: Rows on which costs and rejections are estimated. They decide the order in which
#: rules are asked, never a verdict.
SAMPLE_ROWS = 500

# Thresholds of the base rules.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not once for each element of
    the functions inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """What stands between blanks (space and U+0009 to U+000D); null for null and
    for texts without a word."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed != "", F.split(trimmed, BLANKS))


def count_duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def count_repeated_words(tokens: Column, span: int = 3) -> Column:
    """Words inside windows of ``span`` words that the text holds at least twice.

    Windows are hashed and sorted with their positions, so that equal ones are
    neighbours; the union of their positions is then summed in order.
    """

    def hashed(array: Column) -> Column:
        return F.transform(
            F.slice(array, 1, F.greatest(F.size(array) - (span - 1), F.lit(0))),
            lambda x, i: F.struct(
                F.xxhash64(x, *[F.get(array, i + k) for k in range(1, span)]).alias("h"),
                i.alias("p"),
            ),
        )

    def repeated(rows: Column) -> Column:
        same = F.filter(
            rows,
            lambda x, i: F.coalesce(F.get(rows, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(rows, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    def covered(places: Column) -> Column:
        steps = F.transform(
            F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))),
            lambda x, i: F.least(x - F.get(places, i), F.lit(span)),
        )
        total = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
        return F.when(F.size(places) > 0, total + span).otherwise(0)

    return let(
        let(let(tokens, hashed), lambda x: let(F.sort_array(x), repeated)), covered
    )


def measures(df: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the base counts: n_words, word_chars (code points in
    words), n_symbols (of ``#*$%&|<>``), n_dup_lines (lines with a word, equal to
    an earlier one), n_repeat_words (in three-word windows found twice or more)."""
    rows = pick(df, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text"
    )
    counted = rows.select(
        "doc_id",
        "text",
        let(
            words(F.col("text")),
            lambda w: F.struct(
                F.size(w).alias("n_words"),
                F.length(F.array_join(w, "")).alias("word_chars"),
                count_repeated_words(w).alias("n_repeat_words"),
            ),
        ).alias("counts"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        count_duplicate_lines(F.col("text")).alias("n_dup_lines"),
    )

    def number(value: Column) -> Column:
        return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)).cast("bigint")

    return counted.select(
        "doc_id",
        "text",
        number(F.col("counts.n_words")).alias("n_words"),
        number(F.col("counts.word_chars")).alias("word_chars"),
        number(F.col("n_symbols")).alias("n_symbols"),
        number(F.col("n_dup_lines")).alias("n_dup_lines"),
        number(F.col("counts.n_repeat_words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )


def default_rules() -> dict[str, Column]:
    """What each rule rejects, over the columns of :func:`measures`."""
    text, n = F.col("text"), F.col("n_words")
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n),
        "line_copies": 100 * F.col("n_dup_lines")
        > 30 * F.size(F.split(text, "\n")),
        "shouting": 5 * F.regexp_count(text, F.lit("!!")) > n,
        "no_letters": 2 * F.regexp_count(text, F.lit(r"\p{L}")) < F.length(text),
    }


def rule_order(
    sample: DataFrame, rules: Mapping[str, Column], rounds: int = 2
) -> list[str]:
    """Rules by rejections per second on a sample, the best first. Each is run on
    its own over the whole sample; the quicker of ``rounds`` runs counts."""
    gain = {}
    for name, rejects in rules.items():
        seconds, hits = float("inf"), 0
        for _ in range(rounds):
            start = time.perf_counter()
            row = sample.agg(F.count_if(F.coalesce(rejects, F.lit(False)))).head()
            seconds, hits = min(seconds, time.perf_counter() - start), row[0]
        gain[name] = hits / max(seconds, 1e-6)
    return sorted(rules, key=lambda name: (-gain[name], name))


def cascade(rules: Mapping[str, Column], order: list[str]) -> Column:
    """The first rule in ``order`` that rejects a row, else null. Later rules are
    not evaluated once one has rejected."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in order:
        chain = chain.when(rules[name], F.lit(name))
    return chain


def judge(
    df: DataFrame,
    rules: Mapping[str, Column] | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every row.

    Rows that the base rules fail are rejected at once; the others pass through
    ``rules`` in the order found on up to ``sample_rows`` rows. A row is kept if no
    rule rejects it, whatever the order. Null texts count as texts without words;
    a rule that is null for a row doesn't reject it. Rows keep their number, so
    repeated and null ``doc_id`` stay; an empty table gives an empty result.
    """
    rules = dict(default_rules() if rules is None else rules)
    rows = pick(df, doc_id="doc_id", text="text")
    # take() reads as few partitions as it needs; limit() would gather as many rows
    # from each of them.
    sample = df.sparkSession.createDataFrame(rows.take(sample_rows), rows.schema)
    order = rule_order(measures(sample).where(~base_failed()), rules)
    return measures(rows).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        F.when(base_failed(), False)
        .otherwise(cascade(rules, order).isNull())
        .alias("kept"),
    )
