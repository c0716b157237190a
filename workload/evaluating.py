"""Numeric and text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import text
from pairlab.operators import metrics, textmetrics

from .fitting import bundle_sql, ranks_sql, rounded
from .preparing import TURN_PAIRS, turn_pairs
from .registry import query, table
from .rendering import BLANKS

# Line items as true and predicted values. The prediction of one flag is made
# constant so that the zero-variance rule is met.
LINES = """
    select l_returnflag, l_extendedprice / 1000 as x,
           case when l_returnflag = 'N' then 25.0 else l_quantity end as y,
           l_discount - 0.05 as dx, l_tax - 0.04 as dy
    from lineitem
    """


def lines(spark, sf_dir):
    flag = F.col("l_returnflag")
    constant = F.when(flag == "N", 25.0).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(
        flag,
        (F.col("l_extendedprice") / 1000).alias("x"),
        constant.alias("y"),
        (F.col("l_discount") - 0.05).alias("dx"),
        (F.col("l_tax") - 0.04).alias("dy"),
    )


def per_flag(spark, sf_dir, value):
    grouped = lines(spark, sf_dir).groupBy("l_returnflag")
    return grouped.agg(F.round(value, 9).alias("value"))


def flag_sql(value: str) -> str:
    return f"""
    select l_returnflag, round({value}, 9) as value from ({LINES})
    group by l_returnflag
    """



@query(
    "pearson",
    flag_sql(
        "case when min(x) = max(x) or min(y) = max(y) then 0.0 else corr(x, y) end"
    ),
)
def pearson(spark, sf_dir):
    return per_flag(spark, sf_dir, metrics.pearson(F.col("x"), F.col("y")))


@query(
    "spearman",
    f"""
    select l_returnflag, round(case when min(x__rank) = max(x__rank)
             or min(y__rank) = max(y__rank) then 0.0 else corr(x__rank, y__rank) end, 9)
             as value
    from (select *, {ranks_sql(["x", "y"], "l_returnflag")} from ({LINES}))
    group by l_returnflag
    """,
)
def spearman(spark, sf_dir):
    ranked = metrics.with_ranks(lines(spark, sf_dir), ["x", "y"], ["l_returnflag"])
    grouped = ranked.groupBy("l_returnflag")
    return grouped.agg(F.round(metrics.spearman("x", "y"), 9).alias("value"))


@query(
    "spearman_with_nulls",
    """
    with rows as (
      select nullif(l_returnflag, 'R') as flag,
             case when l_linenumber % 3 > 0 then l_quantity end as x, l_extendedprice as y
      from lineitem),
    ranked as (
      select flag,
             (rank() over (partition by flag order by x nulls first) + count(*) over (
               partition by flag order by x nulls first
               range between unbounded preceding and current row)) / 2 as x_rank,
             (rank() over (partition by flag order by y) + count(*) over (
               partition by flag order by y
               range between unbounded preceding and current row)) / 2 as y_rank
      from rows)
    select flag, count(*) as pairs, round(corr(x_rank, y_rank), 9) as value
    from ranked group by flag
    """,
)
def spearman_with_nulls(spark, sf_dir):
    """Null values tie for the first ranks, and the null group is a group."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.nullif("l_returnflag", F.lit("R")).alias("flag"),
        F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity")).alias("x"),
        F.col("l_extendedprice").alias("y"),
    )
    ranked = metrics.with_ranks(rows, ["x", "y"], ["flag"])
    return ranked.groupBy("flag").agg(
        F.count("*").alias("pairs"),
        F.round(metrics.spearman("x", "y"), 9).alias("value"),
    )


@query("rmse", flag_sql("sqrt(avg((x - y) ** 2))"))
def rmse(spark, sf_dir):
    return per_flag(spark, sf_dir, metrics.rmse(F.col("x"), F.col("y")))


@query("mae", flag_sql("avg(abs(x - y))"))
def mae(spark, sf_dir):
    return per_flag(spark, sf_dir, metrics.mae(F.col("x"), F.col("y")))


@query("sign_accuracy", flag_sql("avg((sign(dx) = sign(dy))::int)"))
def sign_accuracy(spark, sf_dir):
    return per_flag(spark, sf_dir, metrics.sign_accuracy(F.col("dx"), F.col("dy")))


@query(
    "average_ranks",
    """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber,
           (rank() over (order by l_quantity) + count(*) over (order by l_quantity
             range between unbounded preceding and current row)) / 2 as quantity_rank
    from lineitem
    """,
)
def average_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )
    ranked = metrics.average_ranks(rows, {"l_quantity": "quantity_rank"})
    return ranked.drop("l_quantity")


@query(
    "score_metrics",
    f"""
    select l_returnflag, count(*) as num_examples,
           {bundle_sql("dx", "dy", "delta", True)},
           {bundle_sql("x", "y", "adapter_score", False)}
    from (select *, {ranks_sql(["x", "y", "dx", "dy"], "l_returnflag")} from ({LINES}))
    group by l_returnflag
    """,
)
def score_metrics(spark, sf_dir):
    found = metrics.evaluate_scores(
        lines(spark, sf_dir), ["l_returnflag"], "dx", "dy", "x", "y"
    )
    return rounded(found, ["l_returnflag"])


COLLAPSED = (
    "regexp_replace(trim(lower(%s), '" + BLANKS + r"'), '" + text.BLANK_CLASS
    + "+', ' ', 'g')"
)


@query(
    "normalize_words",
    f"select doc_id, {COLLAPSED % 'text'} as norm from documents",
)
def normalize_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query(
    "normalize_sql",
    f"""
    select page_id, rtrim({COLLAPSED % "(html || ' ;; ')"}, ';') as norm from pages
    """,
)
def normalize_sql(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    shown = F.concat("html", F.lit(" ;; "))
    return pages.select("page_id", text.normalize_sql(shown).alias("norm"))


WORDS = f"regexp_extract_all({COLLAPSED}, '[\\pL\\pN_]+')"


@query(
    "split_words",
    f"""
    select doc_id, len(w) as n, array_to_string(w, ' ') as words
    from (select doc_id, {WORDS % 'text'} as w from documents)
    """,
)
def split_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", text.words(F.col("text")).alias("w"))
    return found.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n"),
        F.array_join("w", " ").alias("words"),
    )


@query(
    "last_numbers",
    r"""
    select page_id, replace(regexp_extract_all(html,
             '-?\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?')[-1], ',', '') as number
    from pages
    """,
)
def last_numbers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.last_number(F.col("html")).alias("number"))


# Answers to compare: an event's value against a rounded or exact statement.
ANSWERS = """
    select event_id, 'so ' || event_id || ', about ' || value || '!' as prediction,
           case when event_type = 'click' then 'none'
                when event_type = 'view' then (floor(value))::bigint || '.0'
                else '#### ' || value end as reference
    from events
    """


def answers(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    stated = (
        F.when(kind == "click", F.lit("none"))
        .when(kind == "view", F.concat(F.floor(value).cast("string"), F.lit(".0")))
        .otherwise(F.concat(F.lit("#### "), value.cast("string")))
    )
    guess = F.concat(
        F.lit("so "), F.col("event_id").cast("string"), F.lit(", about "),
        value.cast("string"), F.lit("!"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", guess.alias("prediction"), stated.alias("reference")
    )


@query(
    "answer_accuracy",
    rf"""
    with n as (
      select event_id, replace(regexp_extract_all(prediction,
               '-?[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?')[-1], ',', '') as p,
             replace(regexp_extract_all(reference,
               '-?[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?')[-1], ',', '') as r
      from ({ANSWERS}))
    select event_id, coalesce((p = r)::int, 0)::double as gsm8k_answer_accuracy from n
    """,
)
def answer_accuracy(spark, sf_dir):
    scored = textmetrics.score_texts(answers(spark, sf_dir), ["gsm8k_answer_accuracy"])
    return scored.select("event_id", "gsm8k_answer_accuracy")


def answered_turns(spark, sf_dir):
    return turn_pairs(spark, sf_dir).withColumnsRenamed(
        {"prompt": "prediction", "completion": "reference"}
    )


PAIRED = f"select *, prompt as prediction, completion as reference from ({TURN_PAIRS})"


@query(
    "exact_match",
    f"""
    select a.page_id, (({COLLAPSED % "a.url"}) = ({COLLAPSED % "upper(' ' || a.url)"}))
             ::int::double as exact_match,
           (({COLLAPSED % "a.url"}) = ({COLLAPSED % "a.html"}))::int::double as unequal
    from pages a
    """,
)
def exact_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    shown = F.upper(F.concat(F.lit(" "), "url"))
    return pages.select(
        "page_id",
        textmetrics.exact_match(F.col("url"), shown).alias("exact_match"),
        textmetrics.exact_match(F.col("url"), F.col("html")).alias("unequal"),
    )


@query(
    "sql_exact_match",
    """
    select page_id, coalesce((lower(url) = lower(case
             when page_id % 3 = 0 then url || ' limit 1'
             when page_id % 3 = 1 then url else 'None' end))::int, 0)::double
             as sql_exact_match
    from pages
    """,
)
def sql_exact_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    shown = F.concat(F.lit("\n"), F.upper("url"), F.lit(";; "))
    third = F.col("page_id") % 3
    other = F.when(third == 0, F.concat("url", F.lit(" limit 1")))
    other = other.when(third == 1, F.col("url"))
    return pages.select(
        "page_id",
        textmetrics.sql_exact_match(shown, other).alias("sql_exact_match"),
    )


TOKEN_F1 = f"""
    pairs as (select conv_id, turn, split, {WORDS % 'prediction'} as p,
                {WORDS % 'reference'} as r from ({PAIRED})),
    counts as (
      select conv_id, turn, w, count(*) filter (side = 'p') as np,
             count(*) filter (side = 'r') as nr
      from (select conv_id, turn, 'p' as side, unnest(p) as w from pairs
            union all select conv_id, turn, 'r', unnest(r) from pairs)
      group by conv_id, turn, w),
    shared as (select conv_id, turn, sum(least(np, nr)) as s from counts
               group by conv_id, turn),
    f1 as (
      select conv_id, turn, split, case when len(p) = 0 and len(r) = 0 then 1.0
               when len(p) = 0 or len(r) = 0 or s = 0 then 0.0
               else 2.0 * (s::double / len(p)) * (s::double / len(r))
                 / (s::double / len(p) + s::double / len(r)) end::double as token_f1
      from pairs left join shared using (conv_id, turn))
    """


@query(
    "token_f1",
    f"with {TOKEN_F1} select conv_id, turn, round(token_f1, 9) as token_f1 from f1",
)
def token_f1(spark, sf_dir):
    scored = textmetrics.score_texts(answered_turns(spark, sf_dir), ["token_f1"])
    return scored.select("conv_id", "turn", F.round("token_f1", 9).alias("token_f1"))


# Row by row of the usual table: a row is a list, and each word of one text makes the
# next row from the last one and from the places where the other text has that word.
LCS = f"""
    pairs as (select conv_id, turn, {WORDS % 'prediction'} as p,
                {WORDS % 'reference'} as r from ({PAIRED})),
    marked as (
      select conv_id, turn, len(p) as np, len(r) as nr,
        list_transform(range(0, len(r) + 1), lambda j: 0) as zeros,
        list_transform(p, lambda w: list_transform(r, lambda v: (v = w)::int)) as hits
      from pairs),
    lcs as (
      select conv_id, turn, np, nr, list_last(list_reduce(list_prepend(zeros, hits),
        lambda row, hit: list_reduce(list_prepend([0],
          list_transform(range(1, nr + 1), lambda j: [row[j], row[j + 1], hit[j]])),
          lambda made, x: list_append(made, case when x[3] = 1 then x[1] + 1
            else greatest(x[2], list_last(made)) end))))::int as lcs
      from marked)
    """


@query(
    "rouge_l",
    f"""
    with {LCS}
    select conv_id, turn, round(case when np = 0 and nr = 0 then 1.0
             when np = 0 or nr = 0 or lcs = 0 then 0.0
             else 2.0 * (lcs::double / np) * (lcs::double / nr)
               / (lcs::double / np + lcs::double / nr) end::double, 9) as rouge_l_f1
    from lcs
    """,
)
def rouge_l(spark, sf_dir):
    scored = textmetrics.score_texts(answered_turns(spark, sf_dir), ["rouge_l_f1"])
    return scored.select(
        "conv_id", "turn", F.round("rouge_l_f1", 9).alias("rouge_l_f1")
    )


@query("lcs_turns", f"with {LCS} select conv_id, turn, lcs from lcs")
def lcs_turns(spark, sf_dir):
    """Longest common word sequence of a question and its answer."""
    said = [text.words(F.col(name)) for name in ("prediction", "reference")]
    return answered_turns(spark, sf_dir).select(
        "conv_id", "turn", textmetrics.lcs_length(*said).alias("lcs")
    )


@query("lcs_length")
def lcs_length(spark, sf_dir):
    """Longest common word sequence of whole documents and their sorted words."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", text.words(F.col("text")).alias("w"))
    return found.select(
        "doc_id", textmetrics.lcs_length("w", F.array_sort("w")).alias("lcs")
    )


@query(
    "evaluate_texts",
    f"""
    with {TOKEN_F1},
    exact as (select conv_id, turn, (({COLLAPSED % 'prediction'}) =
                ({COLLAPSED % 'reference'}))::int::double as exact_match
              from ({PAIRED}))
    select split, 'turns' as evaluation, count(*) as num_examples,
           'token_f1' as metric_name, round(avg(token_f1), 9) as metric_value,
           round(avg(token_f1), 9) as token_f1, round(avg(exact_match), 9) as exact_match
    from f1 join exact using (conv_id, turn) group by split
    """,
)
def evaluate_texts(spark, sf_dir):
    evaluation = {"name": "turns", "metrics": ["token_f1", "exact_match"]}
    found = textmetrics.evaluate_texts(
        answered_turns(spark, sf_dir), evaluation, ["split"]
    )
    return rounded(found, ["split"], 9)
