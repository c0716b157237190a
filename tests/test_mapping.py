from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairlab.functions.paths import nested_text
from pairlab.operators import mapping


def one(spark, columns, recipe):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()])
    return tuple(mapping.format_records(row, recipe).head())


def value(spark, columns, make):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()])
    return row.select(make(row).alias("r")).head()["r"]


def test_conditional_parts_and_first_non_empty(spark):
    recipe = {
        "computed_fields": {"question": {"first_non_empty": ["rewritten", "intent"]}},
        "prompt_parts": [
            "Q: {question}",
            {"template": "Context: {context}", "when_field": "context"},
        ],
        "completion_template": "{response}",
    }
    columns = {
        "intent": F.lit("plain"),
        "rewritten": F.lit(" better "),
        "context": F.lit("  "),
        "response": F.lit("done"),
    }
    assert one(spark, columns, recipe) == ("Q: better", "done")
    columns["context"] = F.lit("here")
    assert one(spark, columns, recipe) == ("Q: better\n\nContext: here", "done")


def test_choices_from_a_struct(spark):
    choices = F.struct(
        F.array(F.lit("Red "), F.lit("Green")).alias("text"),
        F.array(F.lit("X"), F.lit("Y")).alias("label"),
        F.array(F.lit("X")).alias("few"),
    )
    columns = {"choices": choices}

    def shown(label):
        return lambda df: mapping.format_choices(df, "choices.text", label)

    assert value(spark, columns, shown("choices.label")) == "X. Red\nY. Green"
    assert value(spark, columns, shown("choices.few")) == "A. Red\nB. Green"
    assert value(spark, columns, shown(None)) == "A. Red\nB. Green"


def test_choices_of_nulls_and_non_lists(spark):
    columns = {"t": F.lit("text"), "n": F.lit(None).cast("array<string>")}
    assert value(spark, columns, lambda df: mapping.format_choices(df, "t")) == ""
    assert value(spark, columns, lambda df: mapping.format_choices(df, "n")) == ""
    assert value(spark, columns, lambda df: mapping.format_choices(df, ["t", "gone"])) == "A. text\nB. "


def test_letters_start_over(spark):
    many = {"m": F.array(*[F.lit(str(i)) for i in range(28)])}
    got = value(spark, many, lambda df: mapping.format_choices(df, "m", joiner="|"))
    assert got.split("|")[25:] == ["Z. 25", "A. 26", "B. 27"]


@pytest.mark.parametrize(
    ("index", "expected"),
    [
        ("1", "B"),
        ("' 2 '", "C"),
        ("'c'", "C"),
        ("'1_0'", "K"),
        ("2.9d", "C"),
        ("true", "B"),
        ("-1", ""),
        ("26", ""),
        ("'2.0'", ""),
        ("' c'", ""),
        ("'é'", ""),
        ("''", ""),
        ("cast(null as string)", ""),
        ("double('nan')", ""),
    ],
)
def test_index_as_letter(spark, index, expected):
    columns = {"i": F.expr(index)}
    found = value(spark, columns, lambda df: mapping.lookup_index(df, "i", as_letter=True))
    assert found == expected


def test_lookups(spark):
    columns = {"i": F.lit(2), "items": F.array(*map(F.lit, ("A1", "A2", "A3 "))), "neg": F.lit(-1)}
    look = mapping.lookup_index
    assert value(spark, columns, lambda df: look(df, "i", list="items")) == "A3"
    assert value(spark, columns, lambda df: look(df, "neg", list="items")) == ""
    assert value(spark, columns, lambda df: look(df, "i", labels=["neg", None, "pos"])) == "pos"
    assert value(spark, columns, lambda df: look(df, "i", labels=["a"])) == ""
    assert value(spark, columns, lambda df: look(df, "gone", labels=["a"])) == ""


def test_missing_field_fails_at_plan_time(spark):
    recipe = {"prompt_template": "{nope}", "completion_template": "x"}
    with pytest.raises(ValueError, match="`prompt_template` uses `nope`"):
        mapping.format_records(spark.range(1), recipe)


def test_braces_and_dotted_fields(spark):
    recipe = {"prompt_template": "{{{s.a}}} {n}", "completion_template": "{b}"}
    columns = {"s": F.struct(F.lit(" x ").alias("a")), "n": F.lit(None).cast("int"), "b": F.lit(True)}
    assert one(spark, columns, recipe) == ("{x} ", "True")


def test_variant_paths(spark):
    document = '{"a": {"b": [1, "two", null]}, "c": "", "0": "zero", "l": ["p", "q"]}'
    columns = {"v": F.parse_json(F.lit(document))}
    paths = {"v.a.b.1": "two", "v.a.b.2": None, "v.a.b.9": None, "v.0": "zero", "v.x.y": None}
    for path, expected in paths.items():
        assert value(spark, columns, lambda df: nested_text(df, path)) == expected
    first = value(spark, columns, lambda df: mapping.first_non_empty(df, ["v.c", "v.x", "v.a.b.0"]))
    assert first == "1"
    assert value(spark, columns, lambda df: mapping.format_choices(df, "v.l")) == "A. p\nB. q"


def test_zero_and_false_are_filled(spark):
    columns = {"z": F.lit(0), "f": F.lit(False), "e": F.lit(" ")}
    assert value(spark, columns, lambda df: mapping.first_non_empty(df, ["e", "z"])) == "0"
    assert value(spark, columns, lambda df: mapping.first_non_empty(df, ["e", "f"])) == "False"
    assert value(spark, columns, lambda df: mapping.first_non_empty(df, ["e"])) == ""
