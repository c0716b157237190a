from __future__ import annotations

import json
from copy import deepcopy

import pytest
from pyspark.sql import functions as F

from pairlab.operators import filters
from pairlab.plans.recipe import RecipeError, check_recipe, prepare

MAPPING = {"prompt_template": "{question}", "completion_template": "{answer}"}


def recipe(data, **more):
    return {"dataset_name": "demo", "source": {"data": data}, "mapping": MAPPING, **more}


def questions(spark, n, start=0):
    ids = spark.range(start, start + n)
    return ids.select(
        "id",
        F.concat(F.lit("q"), "id").alias("question"),
        F.concat(F.lit("a"), "id").alias("answer"),
    )


def counts(prepared):
    return {r["split"]: r["kept"] for r in prepared.stats().collect()}


def test_ratio_split(spark):
    split = {"strategy": "ratios", "ratios": {"valid": 0.2, "test": 0.2}}
    found = prepare(spark, recipe(questions(spark, 10), split=split), ["id"])
    assert counts(found) == {"train": 6, "valid": 2, "test": 2}


def test_legacy_ratio_wins(spark):
    split = {"strategy": "train_valid", "valid_ratio": 0.5, "ratios": {"valid": 0.1}}
    found = prepare(spark, recipe(questions(spark, 10), split=split), ["id"])
    assert counts(found) == {"train": 5, "valid": 5}


def test_append_to_a_split(spark):
    named = questions(spark, 3).withColumn(
        "split", F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), (F.col("id") + 1).cast("int"))
    )
    made = recipe(named)
    made["source"]["append"] = {"train": [{"data": questions(spark, 2, 10), "max_examples": 1}]}
    found = prepare(spark, made, ["id"])
    assert counts(found) == {"train": 2, "valid": 1, "test": 1}
    made["source"]["append"] = {"dev": [{"data": questions(spark, 2, 10)}]}
    with pytest.raises(RecipeError, match="there is no such split"):
        prepare(spark, made, ["id"])


def test_caps_per_split(spark):
    split = {"ratios": {"valid": 0.2, "test": 0.2}, "max_examples_per_split": {"train": 3, "test": 0}}
    found = prepare(spark, recipe(questions(spark, 20), split=split), ["id"])
    assert counts(found) == {"train": 3, "valid": 4, "test": 0}
    row = {r["split"]: r for r in found.stats().collect()}["test"]
    assert (row["seen"], row["skipped"], row["max_prompt_chars_seen"]) == (0, 0, None)
    assert found.metadata().head()["split_counts"] == {"train": 3, "valid": 4, "test": 0}


def test_excluded_prompts(spark, tmp_path):
    named = questions(spark, 3).withColumn(
        "split", F.element_at(F.array(*map(F.lit, ("train", "valid", "test"))), (F.col("id") + 1).cast("int"))
    )
    path = tmp_path / "seen.jsonl"
    path.write_text('{"prompt": " q1 "}\n\n{"prompt": "other"}\n')
    made = recipe(named, filters={"exclude_prompt_hashes": {"sources": [str(path)]}})
    stats = {r["split"]: r for r in prepare(spark, made, ["id"]).stats().collect()}
    assert [stats[s]["kept"] for s in ("train", "valid", "test")] == [1, 0, 1]
    assert stats["valid"]["skipped_excluded_prompt_hash"] == 1
    assert stats["valid"]["max_prompt_chars_seen"] is None


def test_length_filter(spark):
    rows = [("p", "c"), ("x" * 5001, "c"), ("p", "y" * 3001)]
    df = spark.createDataFrame(rows, "prompt string, completion string").withColumn("split", F.lit("train"))
    limits = filters.PairFilters(max_prompt_chars=5000, max_completion_chars=3000, max_total_chars=0)
    found = filters.filter_stats(filters.tag_pairs(df, limits), limits).head()
    assert (found["kept"], found["skipped"], found["skipped_char_limits"]) == (1, 2, 2)
    assert (found["max_prompt_chars_seen"], found["max_completion_chars_seen"]) == (5001, 3001)


def token_counts(prompt, completion):
    return F.length(prompt) + F.length(completion) + 5, F.length(prompt) + 8


def test_token_supervision(spark):
    df = spark.createDataFrame([(1, "p" * 20, "c" * 10), (2, "p", "c" * 10)], "id long, question string, answer string")
    limits = {"token_supervision": {"enabled": True, "max_seq_length": 24, "min_supervised_tokens": 1}}
    split = {"strategy": "existing"}
    named = df.withColumn("split", F.explode(F.array(*map(F.lit, ("train", "valid", "test")))))
    found = prepare(spark, recipe(named, filters=limits, split=split), ["id"], token_counts)
    row = {r["split"]: r for r in found.stats().collect()}["train"]
    assert row["max_sequence_tokens_seen"] == 35
    assert row["max_prompt_tokens_seen"] == 28
    assert row["min_supervised_tokens_seen"] == 0
    assert (row["truncated_examples"], row["zero_supervision_examples"]) == (1, 1)
    assert (row["kept"], row["skipped_token_supervision"]) == (1, 1)
    with pytest.raises(RecipeError, match="token_counts"):
        prepare(spark, recipe(named, filters=limits, split=split), ["id"])


def test_write_and_metadata(spark, tmp_path):
    data = questions(spark, 10).withColumn("answer", F.lit("naïve 中"))
    split = {"ratios": {"valid": 0.2, "test": 0.2}}
    found = prepare(spark, recipe(data, split=split), ["id"])
    assert found.write(str(tmp_path / "out")) == {"train": 6, "valid": 2, "test": 2}
    lines = [json.loads(line) for p in (tmp_path / "out" / "split=train").glob("*.json") for line in p.read_text("utf-8").splitlines()]
    assert len(lines) == 6
    assert all(set(line) == {"prompt", "completion"} and line["completion"] == "naïve 中" for line in lines)
    again = found.write(str(tmp_path / "mixed"), shuffle=True)
    assert again == {"train": 6, "valid": 2, "test": 2}
    assert spark.read.json(str(tmp_path / "mixed")).count() == 10
    row = found.metadata().head()
    assert row["split_counts"] == {"train": 6, "valid": 2, "test": 2}
    assert row["filter_stats"]["train"]["kept"] == 6


GOOD = {
    "dataset_name": "d",
    "source": {"type": "jsonl", "path": "x.jsonl"},
    "split": {"strategy": "ratios"},
    "mapping": {
        "prompt_parts": ["{a}", {"template": "{b}", "when_any": ["b"]}],
        "completion_template": "{c}",
        "computed_fields": {"c": {"first_non_empty": ["x.y"]}},
    },
    "filters": {"max_prompt_chars": 10},
}

BAD = [
    ("dataset_name", None, "dataset_name` is missing"),
    ("extra", 1, "`recipe` does not know"),
    ("source.type", "xml", "source.type`: no reader"),
    ("source.files", {"train": "x"}, "either `path` or `files`"),
    ("source.append", {"train": []}, "list of sources"),
    ("source.append", {"train": [{"type": "csv", "path": "y", "append": {}}]}, "cannot append"),
    ("source.max_examples", "many", "is no number"),
    ("split.strategy", "random", "is none of"),
    ("source.streaming", True, "lazily"),
    ("source.revision", "main", "no revisions"),
    ("source.trust_remote_code", True, "no code"),
    ("split.splits", {}, "split` does not know"),
    ("split.ratios", {"valid": "x"}, "is no number"),
    ("mapping.type", "code", "only templates are known"),
    ("mapping.completion_template", None, "completion_template` is missing"),
    ("mapping.prompt_parts", None, "has neither"),
    ("mapping.prompt_parts", ["{a"], "no valid template"),
    ("mapping.prompt_parts", [{"template": "x", "unless": 1}], "does not know"),
    ("mapping.computed_fields", {"c": {"upper": "x"}}, "does not know"),
    ("mapping.computed_fields", {"c": {"first_non_empty": []}}, "list of paths"),
    ("mapping.computed_fields", {"c": {"format_choices": {}}}, "text_field"),
    ("mapping.computed_fields", {"c": {"lookup_index": {"index": "i"}}}, "nothing to look up in"),
    ("mapping.computed_fields", {"c": {"lookup_index": {"labels": []}}}, "index` is missing"),
    ("filters.max_words", 3, "filters` does not know"),
    ("filters.exclude_prompt_hashes", {"sources": [" "]}, "expected a path or a table"),
    ("filters.token_supervision", {"enabled": True}, "needs `max_seq_length`"),
]


def test_good_recipe():
    check_recipe(GOOD)


@pytest.mark.parametrize(("place", "value", "message"), BAD)
def test_bad_recipes(place, value, message):
    made = deepcopy(GOOD)
    *outer, last = place.split(".")
    block = made
    for name in outer:
        block = block[name]
    if value is None:
        del block[last]
    else:
        block[last] = value
    with pytest.raises(RecipeError) as error:
        check_recipe(made)
    assert message in str(error.value)


def test_ignored_ratio_warns():
    made = deepcopy(GOOD)
    made["split"] = {"strategy": "train_valid_existing_test", "test_ratio": 0.1}
    with pytest.warns(UserWarning, match="no effect"):
        check_recipe(made)


def test_published_splits_are_united_for_ratios(spark):
    named = questions(spark, 10).withColumn("split", F.lit("train"))
    split = {"strategy": "ratios", "ratios": {"valid": 0.2, "test": 0.2}}
    found = prepare(spark, recipe(named, split=split), ["id"])
    assert counts(found) == {"train": 6, "valid": 2, "test": 2}


def test_check_pairs(spark):
    rows = [("train", "train-000000", "p", "c"), ("valid", "valid-000000", " ", "c")]
    df = spark.createDataFrame(rows, "split string, pair_id string, prompt string, completion string")
    with pytest.raises(ValueError, match="without records"):
        filters.check_pairs(df)
    with pytest.raises(ValueError, match="empty prompt: valid \\(valid-000000\\)"):
        filters.check_pairs(df, ("train", "valid"))
    filters.check_pairs(df, ("train",))


def test_source_row_range(spark):
    data = questions(spark, 50).withColumn("split", F.when(F.col("id") < 40, "cot").otherwise("tir"))
    made = recipe(data, split={"strategy": "train_valid", "valid_ratio": 0.2})
    made["source"]["split"] = "cot[10:30]"
    found = prepare(spark, made, ["id"])
    assert counts(found) == {"train": 16, "valid": 4}
    prompts = {r["prompt"] for r in found.pairs().collect()}
    assert prompts == {f"q{i}" for i in range(10, 30)}
    made["source"]["split"] = "tir"
    assert counts(prepare(spark, made, ["id"])) == {"train": 8, "valid": 2}
    made["source"]["split"] = "cot[1%:2%]"
    with pytest.raises(ValueError, match="Unreadable"):
        prepare(spark, made, ["id"])


def test_exclusion_joins_agree(spark, monkeypatch):
    """Half of the rows copy one prompt; broadcast and salted join give the same."""
    from pairlab.operators import joins

    prompt = F.when(F.col("id") % 2 == 0, "copied").otherwise(F.concat(F.lit("p"), "id"))
    df = spark.range(200).select(
        "id", F.lit("train").alias("split"), prompt.alias("prompt"), F.lit("c").alias("completion")
    )
    seen = spark.createDataFrame([("copied",), ("p7",), ("none",)], "prompt string")
    found = []
    for limit in (joins.MAX_BROADCAST_BYTES, 0):
        monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", limit)
        tagged = filters.tag_pairs(df, filters.PairFilters(), filters.prompt_hashes(seen))
        found.append(sorted(r["id"] for r in tagged.where("is_kept").collect()))
    assert found[0] == found[1] == [i for i in range(1, 200, 2) if i != 7]


def test_a_write_counts_the_statistics(spark, tmp_path):
    split = {"ratios": {"valid": 0.2, "test": 0.2}, "max_examples_per_split": {"test": 0}}
    made = recipe(questions(spark, 20), split=split, filters={"max_prompt_chars": 2})
    found = prepare(spark, made, ["id"])
    counted = sorted(map(tuple, found.stats().collect()))
    columns = found.stats().columns
    found.write(str(tmp_path / "out"))
    assert found.counted is not None and found.stats().columns == columns
    assert sorted(map(tuple, found.stats().collect())) == counted
