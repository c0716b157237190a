"""Normalising values and the mapping language."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions import text
from pairlab.functions.paths import nested_number, nested_text
from pairlab.operators import mapping

from .registry import query, table

BLANKS = text.BLANKS


@query(
    "normalize_text",
    f"""
    select doc_id, coalesce(trim(text, '{BLANKS}'), '') as text_norm,
           coalesce(trim(lang || '  ', '{BLANKS}'), '') as lang_norm
    from documents
    """,
)
def normalize_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        text.as_text(F.col("text"), T.StringType()).alias("text_norm"),
        text.as_text(F.concat("lang", F.lit("  ")), T.StringType()).alias("lang_norm"),
    )


@query(
    "stringify_values",
    """
    select p_partkey, p_size::varchar as size_text,
           (p_retailprice * 20000)::varchar as price_text,
           case when p_size > 25 then 'True' else 'False' end as large_text
    from part
    """,
)
def stringify_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        text.as_text(F.col("p_size"), T.IntegerType()).alias("size_text"),
        text.as_text(F.col("p_retailprice") * 20000, T.DoubleType()).alias(
            "price_text"
        ),
        text.as_text(F.col("p_size") > 25, T.BooleanType()).alias("large_text"),
    )


@query(
    "render_templates",
    f"""
    select doc_id, '{{' || lang || '}} from ' || source || ':' || chr(10)
             || trim(text, '{BLANKS}') as prompt,
           'Length ' || n_chars as completion
    from documents
    """,
)
def render_templates(spark, sf_dir):
    recipe = {
        "prompt_template": "{{{lang}}} from {source}:\n{text}",
        "completion_template": "Length {n_chars}",
    }
    return mapping.format_records(table(spark, sf_dir, "documents"), recipe, ["doc_id"])


def labelled_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query(
    "conditional_parts",
    f"""
    with rows as (
      select d.doc_id, d.lang, d.source, trim(d.text, '{BLANKS}') as text,
             l.quality::varchar as quality, l.toxic::varchar as toxic
      from documents d left join labels l using (doc_id)
    )
    select doc_id,
           array_to_string(list_filter([
             'Language: ' || lang,
             case when quality is not null then 'Quality: ' || quality end,
             case when quality is not null or toxic is not null then 'Rated.' end,
             case when lang <> '' and toxic is not null then 'Toxic: ' || toxic end,
             text], lambda p: p is not null and p <> ''), chr(10)) as prompt,
           source as completion
    from rows
    """,
)
def conditional_parts(spark, sf_dir):
    recipe = {
        "prompt_parts": [
            "Language: {lang}",
            {"template": "Quality: {quality}", "when_field": "quality"},
            {"template": "Rated.", "when_any": ["quality", "toxic"]},
            {"template": "Toxic: {toxic}", "when_all": ["lang", "toxic"]},
            {"template": "never {lang}", "when_field": "no_such_column"},
            "{text}",
        ],
        "prompt_joiner": "\n",
        "completion_template": "{source}",
    }
    return mapping.format_records(labelled_documents(spark, sf_dir), recipe, ["doc_id"])


@query(
    "joined_parts",
    f"""
    select p_partkey,
           array_to_string(list_filter([p_name, case when p_size > 25
             then p_brand else '' end, p_type], lambda p: p <> ''),
             chr(10) || chr(10)) as prompt
    from part
    """,
)
def joined_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brand = F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("")
    parts = [F.col("p_name"), brand, F.col("p_type")]
    return part.select("p_partkey", mapping.join_parts(parts, "\n\n").alias("prompt"))


def nested_parts(spark, sf_dir):
    """Parts as nested records: a list, a struct and a map."""
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        F.array("p_name", "p_brand", "p_type").alias("tags"),
        F.struct("p_size", F.struct("p_retailprice").alias("price")).alias("info"),
        F.create_map(F.lit("brand"), "p_brand").alias("extra"),
        "p_size",
    )


@query(
    "nested_paths",
    """
    select p_partkey, p_name as first_tag, p_type as last_tag,
           null::varchar as ninth_tag, null::varchar as no_tag,
           p_size::varchar as size, p_retailprice::varchar as price,
           p_brand as brand, null::varchar as unknown
    from part
    """,
)
def nested_paths(spark, sf_dir):
    df = nested_parts(spark, sf_dir)
    paths = {
        "first_tag": "tags.0",
        "last_tag": "tags.-1",
        "ninth_tag": "tags.8",
        "no_tag": "tags.name",
        "size": "info.p_size",
        "price": "info.price.p_retailprice",
        "brand": "extra.brand",
        "unknown": "info.nothing.here",
    }
    found = [nested_text(df, path).alias(name) for name, path in paths.items()]
    return df.select("p_partkey", *found)


@query(
    "json_paths",
    """
    select event_id, json_extract_string(props, '$.k') as k,
           null::varchar as missing
    from events
    """,
)
def json_paths(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    events = events.withColumn("props", F.parse_json("props"))
    return events.select(
        "event_id",
        nested_text(events, "props.k").alias("k"),
        nested_text(events, "props.none.0").alias("missing"),
    )


@query(
    "nested_numbers",
    """
    select event_id, try_cast(json_extract_string(props, '$.k') as double) as k,
           value, null::double as missing, null::double as not_a_number
    from events
    """,
)
def nested_numbers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    events = events.withColumn("props", F.parse_json("props"))
    paths = {"k": "props.k", "value": "value", "missing": "props.x.y"}
    found = [nested_number(events, path).alias(name) for name, path in paths.items()]
    odd = nested_number(events, "event_type").alias("not_a_number")
    return events.select("event_id", *found, odd)


@query(
    "first_non_empty",
    f"""
    select d.doc_id,
           coalesce(l.toxic::varchar, l.quality::varchar,
             case when d.n_chars > 300 then d.source end, d.lang) as chosen
    from documents d left join labels l using (doc_id)
    """,
)
def first_non_empty(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir).withColumns(
        {
            "blank": F.lit(" \t"),
            "empty": F.array().cast("array<string>"),
            "long": F.when(F.col("n_chars") > 300, F.struct("source")),
        }
    )
    paths = ["nothing", "blank", "empty", "toxic", "quality", "long.source", "lang"]
    return docs.select("doc_id", mapping.first_non_empty(docs, paths).alias("chosen"))


@query(
    "choices_from_columns",
    """
    select p_partkey, 'A. ' || p_name || chr(10) || 'B. ' || p_brand || chr(10)
             || 'C. ' || p_size as choices
    from part
    """,
)
def choices_from_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    choices = mapping.format_choices(part, ["p_name", "p_brand", "p_size"])
    return part.select("p_partkey", choices.alias("choices"))


@query(
    "choices_from_lists",
    f"""
    with rows as (
      select doc_id, string_split(text, chr(10)) as lines from documents
    )
    select doc_id, array_to_string(list_transform(lines, lambda t, i:
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', ((i - 1) % 26 + 1)::int, 1)
             || ') ' || trim(t, '{BLANKS}')), ' | ') as choices,
           array_to_string(list_transform(lines, lambda t, i:
             (i * 10)::varchar || '. ' || trim(t, '{BLANKS}')), chr(10)) as labelled
    from rows
    """,
)
def choices_from_lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    docs = docs.select("doc_id", lines.alias("lines")).withColumn(
        "q",
        F.struct(
            "lines",
            F.transform("lines", lambda _, i: ((i + 1) * 10).cast("string")).alias(
                "numbers"
            ),
            F.lit("no list").alias("title"),
        ),
    )
    return docs.select(
        "doc_id",
        mapping.format_choices(
            docs, "q.lines", "q.title", "{label}) {text}", " | "
        ).alias("choices"),
        mapping.format_choices(docs, "q.lines", "q.numbers").alias("labelled"),
    )


@query(
    "lookup_labels",
    """
    select doc_id, case quality when 0 then 'bad' when 1 then 'good' else '' end
             as quality,
           case toxic when 0 then 'clean' else '' end as toxic
    from labels
    """,
)
def lookup_labels(spark, sf_dir):
    df = table(spark, sf_dir, "labels")
    return df.select(
        "doc_id",
        mapping.lookup_index(df, "quality", labels=["bad", "good"]).alias("quality"),
        mapping.lookup_index(df, "toxic", labels=["clean"]).alias("toxic"),
    )


@query(
    "lookup_letters",
    """
    select n_nationkey,
           case when n_nationkey < 26 then chr(65 + n_nationkey) else '' end as letter,
           upper(substr(n_name, 1, 1)) as own_letter
    from nation
    """,
)
def lookup_letters(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    df = df.withColumn("initial", F.lower(F.substring("n_name", 1, 1)))
    return df.select(
        "n_nationkey",
        mapping.lookup_index(df, "n_nationkey", as_letter=True).alias("letter"),
        mapping.lookup_index(df, "initial", as_letter=True).alias("own_letter"),
    )


@query(
    "lookup_items",
    """
    select p_partkey, coalesce([p_name, p_brand, p_type][p_size - 10], '') as item,
           case when p_size - 11 between 0 and 2
             then coalesce([p_name, p_brand, p_type][p_size - 10], '') else '' end
             as from_text,
           case when p_retailprice < 903
             then [p_name, p_brand, p_type][floor(p_retailprice - 900)::int + 1]
             else '' end as from_price
    from (select * replace (case when p_size < 11 then 99 else p_size end as p_size)
          from part)
    """,
)
def lookup_items(spark, sf_dir):
    df = nested_parts(spark, sf_dir)
    at = F.col("p_size") - 11
    df = df.withColumns(
        {
            "at": at,
            "text": F.concat(F.lit(" "), at.cast("string"), F.lit(" ")),
            "real": F.col("info.price.p_retailprice") - 900,
        }
    )
    return df.select(
        "p_partkey",
        mapping.lookup_index(df, "at", list="tags").alias("item"),
        mapping.lookup_index(df, "text", list="tags").alias("from_text"),
        mapping.lookup_index(df, "real", list="tags").alias("from_price"),
    )


@query(
    "computed_overlay",
    f"""
    select d.doc_id,
           coalesce(l.quality::varchar, d.lang) || ' / ' || d.lang as prompt,
           case l.quality when 0 then 'bad' when 1 then 'good' else '' end
             as completion
    from documents d left join labels l using (doc_id)
    """,
)
def computed_overlay(spark, sf_dir):
    recipe = {
        "computed_fields": {
            # ``source`` is hidden; ``grade`` still reads the raw ``quality``.
            "source": {"first_non_empty": ["quality", "lang"]},
            "quality": {"first_non_empty": ["lang"]},
            "grade": {"lookup_index": {"index": "quality", "labels": ["bad", "good"]}},
        },
        "prompt_template": "{source} / {quality}",
        "completion_template": "{grade}",
    }
    return mapping.format_records(labelled_documents(spark, sf_dir), recipe, ["doc_id"])


@query(
    "prompt_hashes",
    f"""
    select doc_id, sha256(trim(text, '{BLANKS}')) as prompt_hash from documents
    """,
)
def prompt_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", text.prompt_hash(text.strip(F.col("text"))).alias("prompt_hash")
    )


@query(
    "key_names",
    """
    select page_id,
           regexp_replace(lower(trim(url)), '[-_ ]', '', 'g') as dataset_key,
           trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '-') as slug,
           case when url = '' then '-' else regexp_extract(url, '[^/]*$') end
             as short_name
    from pages
    """,
)
def key_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.dataset_key(url).alias("dataset_key"),
        text.slug(url).alias("slug"),
        text.short_model_name(url).alias("short_name"),
    )


@query(
    "coerce_numbers",
    """
    select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k,
           case when value > 100 then null else value end as value,
           null::bigint as word
    from events
    """,
)
def coerce_numbers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    shown = F.when(F.col("value") > 100, "NaN").otherwise(
        F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("\n"))
    )
    k = F.concat(F.get_json_object("props", "$.k"), F.lit(" "))
    return events.select(
        "event_id",
        text.coerce_int(k).alias("k"),
        text.coerce_float(shown).alias("value"),
        text.coerce_int(F.col("event_type")).alias("word"),
    )
