"""Pairs, filters and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import filters
from pairlab.operators.mapping import format_records
from pairlab.operators.ordering import rows_between
from pairlab.plans.recipe import append_rows, prepare
from pairlab.sources.readers import pairs_from_rows, read_source
from pairlab.sources.writers import dataset_metadata

from .registry import query, table
from .rendering import BLANKS


@query(
    "scan_source",
    """
    select doc_id, lang, n_chars from documents
    """,
)
def scan_source(spark, sf_dir):
    source = {"type": "parquet", "path": f"{sf_dir}/documents.parquet"}
    return read_source(spark, source).select("doc_id", "lang", "n_chars")


@query(
    "slice_source",
    """
    select event_id, event_type from (
      select *, row_number() over (order by event_id) - 1 as i from events)
    where i >= 500 and i < 900
    """,
)
def slice_source(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return rows_between(events, ["event_id"], 500, 900).select("event_id", "event_type")


@query(
    "pair_records",
    """
    select printf('train-%06d', row_number() over (order by lang, doc_id) - 1)
             as pair_id,
           'train' as split, text as prompt, coalesce(quality::varchar, '')
             as completion
    from documents left join labels using (doc_id)
    """,
)
def pair_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    rows = docs.select(
        "lang", "doc_id", F.col("text").alias("prompt"), F.col("quality").alias("completion")
    )
    return pairs_from_rows(rows, ["lang", "doc_id"])


APPENDED = f"""
    with first as (
      select 'train' as split, 0 as source_no, doc_id as id from documents),
    extra as (
      select case when e.event_type = 'view' then 'valid' else 'train' end as split,
             e.event_type, event_id,
             row_number() over (partition by event_type
               order by sha256('7|' || event_id), event_id) as r
      from events e)
    select split, source_no, count(*) as n, sum(id)::bigint as ids from (
      select * from first
      union all select 'train', 1, event_id from extra
        where event_type = 'click' and r <= 100
      union all select 'train', 2, event_id from extra where event_type = 'error')
    group by all
    """


@query("append_sources", APPENDED)
def append_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    events = table(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    clicks = events.where("event_type = 'click'").select("id")
    errors = events.where("event_type = 'error'").select("id")
    rows = append_rows(
        docs.withColumn("split", F.lit("train")),
        {"train": [(clicks, 100), (errors, None)]},
        ("train", "valid"),
        ["id"],
        seed=7,
    )
    # The order of appended rows within a source is seeded by the same key.
    return rows.groupBy("split", F.col("_source_no").alias("source_no")).agg(
        F.count("*").alias("n"), F.sum("id").alias("ids")
    )


def document_pairs(spark, sf_dir):
    mapping = {"prompt_template": "{text}", "completion_template": "{lang}: {source}"}
    docs = table(spark, sf_dir, "documents")
    return format_records(docs, mapping, ["doc_id", "lang"]).withColumnRenamed(
        "lang", "split"
    )


def toxic_prompts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    return docs.join(toxic, "doc_id", "left_semi").select(F.col("text").alias("prompt"))


DOCUMENT_PAIRS = f"""
    select doc_id, lang as split, trim(text, '{BLANKS}') as prompt,
           lang || ': ' || source as completion
    from documents
    """

TOXIC_HASHES = f"""
    select distinct sha256(trim(text, '{BLANKS}')) as h
    from documents join labels using (doc_id) where toxic = 1
    """


@query(
    "char_limits",
    f"""
    select doc_id, split, length(prompt) as prompt_chars from ({DOCUMENT_PAIRS})
    where length(prompt) <= 4000 and length(completion) <= 9
      and length(prompt) + length(completion) <= 3900
    """,
)
def char_limits(spark, sf_dir):
    limits = filters.PairFilters(4000, 9, 3900)
    tagged = filters.tag_pairs(document_pairs(spark, sf_dir), limits)
    return tagged.where("is_kept").select(
        "doc_id", "split", F.length("prompt").cast("bigint").alias("prompt_chars")
    )


@query(
    "excluded_prompts",
    f"""
    select doc_id, split from ({DOCUMENT_PAIRS})
    where sha256(prompt) not in ({TOXIC_HASHES})
    """,
)
def excluded_prompts(spark, sf_dir):
    excluded = filters.prompt_hashes(toxic_prompts(spark, sf_dir))
    pairs = document_pairs(spark, sf_dir)
    tagged = filters.tag_pairs(pairs, filters.PairFilters(), excluded)
    return tagged.where("is_kept").select("doc_id", "split")


@query("exclusion_set", f"select h as prompt_hash from ({TOXIC_HASHES})")
def exclusion_set(spark, sf_dir):
    return filters.prompt_hashes(toxic_prompts(spark, sf_dir))


def turn_pairs(spark, sf_dir):
    """User turn as prompt, the assistant's answer as completion."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("prompt")
    )
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")
    )
    split = F.when(F.col("turn") < 2, "first").otherwise("later")
    return asked.join(answered, ["conv_id", "turn"]).withColumn("split", split)


TURN_PAIRS = """
    select u.conv_id, u.turn, u.text as prompt, a.text as completion,
           case when u.turn < 2 then 'first' else 'later' end as split
    from conversations u join conversations a
      on a.conv_id = u.conv_id and a.turn = u.turn + 1
    where u.role = 'user' and a.role = 'assistant'
    """


# Characters stand for tokens: 5 for the frame, 3 for the generation prompt.
def lengths(prompt, completion):
    return F.length(prompt) + F.length(completion) + 5, F.length(prompt) + 8


TOKENS = f"""
    select *, length(p) + length(c) + 5 as full_length, length(p) + 8 as prompt_length,
           least(length(p) + length(c) + 5, 400) as truncated_length,
           greatest(0, least(length(p) + length(c) + 5, 400) - length(p) - 8)
             as supervised_tokens
    from (select *, trim(prompt, '{BLANKS}') as p, trim(completion, '{BLANKS}') as c
          from ({TURN_PAIRS}))
    """


@query(
    "supervision_counts",
    f"""
    select conv_id, turn, full_length, prompt_length, truncated_length,
           supervised_tokens
    from ({TOKENS})
    """,
)
def supervision_counts(spark, sf_dir):
    pairs = filters.tag_pairs(turn_pairs(spark, sf_dir), filters.PairFilters())
    full, prompt = lengths(F.col("prompt"), F.col("completion"))
    counts = filters.supervision_counts(full, prompt, 400)
    return pairs.select(
        "conv_id", "turn", *[c.cast("bigint").alias(n) for n, c in counts.items()]
    )


TOKEN_LIMITS = filters.PairFilters(
    max_prompt_chars=700, max_seq_length=400, min_supervised_tokens=60
)


def tagged_turns(spark, sf_dir):
    full, prompt = lengths(F.col("prompt"), F.col("completion"))
    pairs = turn_pairs(spark, sf_dir)
    return filters.tag_pairs(pairs, TOKEN_LIMITS, None, full, prompt)


@query(
    "supervised_pairs",
    f"""
    select conv_id, turn from ({TOKENS})
    where supervised_tokens >= 60 and length(p) <= 700
    """,
)
def supervised_pairs(spark, sf_dir):
    return tagged_turns(spark, sf_dir).where("is_kept").select("conv_id", "turn")


@query(
    "filter_stats",
    f"""
    select split, count(*) as seen,
           count(*) filter (not long and not short) as kept,
           count(*) filter (long or short) as skipped,
           0::bigint as skipped_excluded_prompt_hash,
           count(*) filter (long) as skipped_char_limits,
           count(*) filter (short) as skipped_token_supervision,
           max(length(p)) as max_prompt_chars_seen,
           max(length(c)) as max_completion_chars_seen,
           max(length(p) + length(c)) as max_total_chars_seen,
           max(full_length) as max_sequence_tokens_seen,
           max(prompt_length) as max_prompt_tokens_seen,
           min(supervised_tokens) as min_supervised_tokens_seen,
           count(*) filter (full_length > 400) as truncated_examples,
           count(*) filter (supervised_tokens = 0) as zero_supervision_examples
    from (select *, length(p) > 700 as long, supervised_tokens < 60 as short
          from ({TOKENS}))
    group by split
    """,
)
def filter_stats(spark, sf_dir):
    return filters.filter_stats(tagged_turns(spark, sf_dir), TOKEN_LIMITS)


@query(
    "blank_pairs",
    """
    select lang as split, doc_id::varchar as pair_id,
           case when toxic is null then 'empty prompt' else 'empty completion' end
             as reason
    from documents left join labels using (doc_id)
    where toxic is null or quality = 0
    """,
)
def blank_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    pairs = docs.select(
        F.col("lang").alias("split"),
        F.col("doc_id").cast("string").alias("pair_id"),
        F.coalesce(F.col("toxic").cast("string"), F.lit(" 　\n")).alias("prompt"),
        F.when(F.col("quality") == 0, "\t").otherwise("x").alias("completion"),
    )
    return filters.blank_pairs(pairs)


def recipe_of(spark, sf_dir):
    """Documents to pairs: computed field, filters, exclusion, ratio split."""
    return {
        "dataset_name": "documents",
        "source": {"data": table(spark, sf_dir, "documents")},
        "split": {"strategy": "ratios", "seed": 42, "ratios": {"valid": 0.1, "test": 0.2}},
        "mapping": {
            "prompt_template": "[{lang}] {text}",
            "completion_template": "{source}",
        },
        "filters": {
            "max_prompt_chars": 8000,
            "exclude_prompt_hashes": {"sources": [excluded_records(spark, sf_dir)]},
        },
    }


def excluded_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    prompt = F.concat(F.lit("["), "lang", F.lit("] "), "text")
    return docs.join(toxic, "doc_id", "left_semi").select(prompt.alias("prompt"))


RECIPE = f"""
    with ranked as (
      select *, row_number() over (order by sha256('42|' || doc_id), doc_id) as r,
             count(*) over () as n
      from documents),
    cuts as (
      select *, greatest(1, least(n - 1, round_even(n * 0.2, 0)))::bigint as t
      from ranked),
    split_rows as (
      select *, case when r <= t then 'test' when r <= t + greatest(1, least(n - t - 1,
               round_even((n - t) * (0.1 / (1.0 - 0.2)), 0)))::bigint then 'valid'
               else 'train' end as split
      from cuts),
    pairs as (
      select doc_id, split, '[' || lang || '] ' || trim(text, '{BLANKS}') as prompt,
             source as completion
      from split_rows),
    excluded as (
      select distinct sha256(trim('[' || lang || '] ' || text, '{BLANKS}')) as h
      from documents join labels using (doc_id) where toxic = 1),
    tagged as (
      select *, sha256(prompt) in (select h from excluded) as excluded,
             length(prompt) > 8000 as long
      from pairs)
    """


@query(
    "prepared_pairs",
    RECIPE
    + """
    select split, prompt, completion from tagged where not excluded and not long
    """,
)
def prepared_pairs(spark, sf_dir):
    prepared = prepare(spark, recipe_of(spark, sf_dir), ["doc_id"])
    return prepared.pairs().select("split", "prompt", "completion")


@query(
    "prepared_stats",
    RECIPE
    + """
    select split, count(*) as seen, count(*) filter (not excluded and not long) as kept,
           count(*) filter (excluded or long) as skipped,
           count(*) filter (excluded) as skipped_excluded_prompt_hash,
           count(*) filter (not excluded and long) as skipped_char_limits,
           0::bigint as skipped_token_supervision,
           max(length(prompt)) filter (not excluded) as max_prompt_chars_seen,
           max(length(completion)) filter (not excluded) as max_completion_chars_seen,
           max(length(prompt) + length(completion)) filter (not excluded)
             as max_total_chars_seen
    from tagged group by split
    """,
)
def prepared_stats(spark, sf_dir):
    return prepare(spark, recipe_of(spark, sf_dir), ["doc_id"]).stats()


STORED = {
    "seen": "count(*) filter (split = '{0}')",
    "kept": "count(*) filter (split = '{0}' and not excluded and not long)",
    "skipped_excluded_prompt_hash": "count(*) filter (split = '{0}' and excluded)",
    "skipped_char_limits": "count(*) filter (split = '{0}' and not excluded and long)",
    "max_total_chars_seen": (
        "max(length(prompt) + length(completion)) "
        "filter (split = '{0}' and not excluded)"
    ),
}
STORED_SQL = ",\n".join(
    f"{sql.format(split)} as {split}_{name}"
    for split in ("train", "valid", "test")
    for name, sql in STORED.items()
)


@query(
    "dataset_metadata",
    RECIPE
    + f"""
    select 'documents' as dataset_name, 'unknown' as source_dataset, 42 as seed,
           0::bigint as none_seen, 0::bigint as none_kept,
           count(*) filter (not excluded and not long) as rows, {STORED_SQL}
    from tagged
    """,
)
def metadata(spark, sf_dir):
    """What is stored of each split, and of one without pairs."""
    prepared = prepare(spark, recipe_of(spark, sf_dir), ["doc_id"])
    splits = (*prepared.splits, "none")
    stats = filters.filter_stats(prepared.tagged, prepared.filters, splits=splits)
    row = dataset_metadata(stats, "documents", "unknown", 42)
    counts, stored = F.col("split_counts"), F.col("filter_stats")
    columns = [
        stored[split][name].alias(f"{split}_{name}")
        for split in prepared.splits
        for name in STORED
    ]
    kept = F.aggregate(
        F.map_values(counts), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    return row.select(
        "dataset_name",
        "source_dataset",
        "seed",
        stored["none"]["seen"].alias("none_seen"),
        counts["none"].alias("none_kept"),
        kept.alias("rows"),
        *columns,
    )
