from __future__ import annotations

import csv
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.operators import reports
from pairlab.sources import readers, writers


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": "1"}\n\n  \n{"a": "é", "b": [1, 2]}\n')
    found = readers.read_jsonl(spark, str(path), "a string, b array<int>").collect()
    assert [tuple(r) for r in found] == [("1", None), ("é", [1, 2])]


def test_malformed_jsonl_raises(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"a": "1"}\n{"a": \n')
    with pytest.raises(Exception, match="bad.jsonl|MALFORMED|FAILFAST"):
        readers.read_jsonl(spark, str(path), "a string").collect()


def test_json_list(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    assert [r["a"] for r in readers.read_json(spark, str(path), "a int").collect()] == [1, 2]


def test_csv_cells_are_strings(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('x,y\n1,"two\nlines, ""quoted"""\n03,\n')
    found = readers.read_csv(spark, str(path))
    assert [tuple(r) for r in found.collect()] == [("1", 'two\nlines, "quoted"'), ("03", "")]
    assert {t for _, t in found.dtypes} == {"string"}


def test_split_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n1\n")
    (tmp_path / "v.csv").write_text("b\n2\n")
    files = {"train": str(tmp_path / "t.csv"), "valid": str(tmp_path / "v.csv")}
    found = readers.read_source(spark, {"type": "csv", "files": files})
    rows = {r["split"]: (r["a"], r["b"]) for r in found.collect()}
    assert rows == {"train": ("1", None), "valid": (None, "2")}


def test_lines_are_numbered_across_blocks_and_files(spark, tmp_path):
    """Small blocks, so that one file is read by many tasks."""
    expected = []
    for name in ("a", "b"):
        lines = [f"{name}{i}" * (i % 9) for i in range(400)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        expected += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = spark.read.text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        found = readers.number_lines(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["value"] for r in sorted(found, key=lambda r: r["line_index"])] == expected
    assert sorted(r["line_index"] for r in found) == list(range(800))


def test_pairs_number_blank_lines_too(spark, tmp_path):
    path = tmp_path / "train.jsonl"
    path.write_text('{"prompt": "p", "completion": null}\n\n{"prompt": "a\\"b", "completion": "c", "x": 1}\n')
    found = sorted(tuple(r) for r in readers.read_pairs(spark, str(path), "train").collect())
    assert found == [("train-000000", "train", "p", ""), ("train-000002", "train", 'a"b', "c")]


@pytest.mark.parametrize(("line", "message"), [('{"prompt": "p"}', "No `completion` in"), ("[1]", "No JSON object"), ("{oops", "No JSON object")])
def test_bad_pairs_raise(spark, tmp_path, line, message):
    path = tmp_path / "train.jsonl"
    path.write_text(line + "\n")
    with pytest.raises(Exception, match=message):
        readers.read_pairs(spark, str(path), "train").collect()


def test_pairs_from_rows(spark):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "id int, prompt string, completion string")
    found = sorted(tuple(r) for r in readers.pairs_from_rows(rows, ["id"]).collect())
    assert found == [("train-000000", "train", "a", "x"), ("train-000001", "train", "b", "")]
    with pytest.raises(ValueError, match="no `completion` column"):
        readers.pairs_from_rows(rows.drop("completion"), ["id"])


def test_long_pair_ids_keep_their_digits(spark):
    made = spark.sql("select 7L as a, 1234567L as b").select(
        readers.pair_id(F.lit("t"), F.col("a")), readers.pair_id(F.lit("t"), F.col("b"))
    )
    assert tuple(made.head()) == ("t-000007", "t-1234567")


def test_missing_events_are_empty(spark, tmp_path):
    schema = T.StructType([T.StructField("event", T.StringType())])
    assert readers.read_or_empty(spark, str(tmp_path / "none.jsonl"), schema).count() == 0


SUMMARY = T.StructType([T.StructField("run_name", T.StringType()), T.StructField("status", T.StringType())])
EVAL = T.StructType([T.StructField("score", T.DoubleType())])


def runs_folder(tmp_path):
    for name, text in {"r1": '{"run_name": "r1",\n "status": "completed"}', "r2": "{broken", "r3": '{"run_name": "r3"}'}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(text)
    (tmp_path / "r3" / "eval.json").write_text('{"score": 0.5}')
    return str(tmp_path)


def test_summaries_skip_corrupt_files(spark, tmp_path):
    root = runs_folder(tmp_path)
    found = readers.read_summaries(spark, root, SUMMARY, EVAL).orderBy("run_name").collect()
    assert [(r["run_name"], r["eval"] and r["eval"]["score"]) for r in found] == [("r1", None), ("r3", 0.5)]
    assert found[0]["run_dir"] == f"{root}/r1"
    with pytest.raises(Exception):
        readers.read_summaries(spark, root, SUMMARY, strict=True).collect()


def test_feature_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "row_id int, features array<double>")
    writers.write_features(df, str(tmp_path / "f"))
    assert writers.read_features(spark, str(tmp_path / "f"), rows=2).schema["features"].dataType == T.ArrayType(T.FloatType())
    with pytest.raises(ValueError, match="Expected 3"):
        writers.read_features(spark, str(tmp_path / "f"), rows=3)
    ragged = spark.createDataFrame([(1, [1.0]), (2, [3.0, 4.0])], "row_id int, features array<double>")
    with pytest.raises(ValueError, match="Inconsistent"):
        writers.write_features(ragged, str(tmp_path / "g"))


def test_keyed_tables_prune_by_split(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", 1.0), ("b", "test", 2.0)], "pair_id string, split string, score double")
    writers.write_keyed(df, str(tmp_path / "s"))
    found = spark.read.parquet(str(tmp_path / "s")).where("split = 'test'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert found.count() == 1


def test_report_over_scanned_summaries(spark, tmp_path):
    root = runs_folder(tmp_path)
    runs = readers.read_summaries(spark, root, SUMMARY)
    shown = {r["run"]: r for r in reports.run_table(runs).collect()}
    assert shown["r3"]["status"] == "-"
    assert shown["r1"]["task_metric"] == "-"


def test_predictions_and_metadata(spark, tmp_path):
    path = tmp_path / "predictions.jsonl"
    path.write_text('{"prediction": "a", "reference": "A", "id": 3}\n')
    found = readers.read_predictions(spark, str(path))
    assert [tuple(r) for r in found.collect()] == [("a", "A")]
    stats = spark.createDataFrame([("train", 3, 1)], "split string, kept long, skipped long")
    row = writers.dataset_metadata(stats, "d", "s", 7)
    writers.write_metadata(row, str(tmp_path / "metadata"))
    stored = spark.read.json(str(tmp_path / "metadata")).head().asDict(True)
    assert stored["split_counts"] == {"train": 3}
    assert stored["filter_stats"]["train"] == {"kept": 3, "skipped": 1}


@pytest.fixture
def small_blocks(spark):
    """Files are cut every few bytes, as a large file is every 128 MB."""
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def odd_texts(seed, n):
    rnd = random.Random(seed)
    bits = ['"', "\\", "{", "}", "[", "]", ",", "\n", "\r\n", "é", "漢", "x", ":", " ", "\t", "'", "}}", '""']
    return ["".join(rnd.choice(bits) for _ in range(rnd.choice([0, 3, 40, 400]))) for _ in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_json_lists_are_cut_in_parallel(spark, small_blocks, tmp_path, indent, seed):
    rows = [{"n": k, "text": t, "deep": {"list": [t, {"a": None}]}} for k, t in enumerate(odd_texts(seed, 60))]
    (tmp_path / "a.json").write_text("﻿  " + json.dumps(rows, indent=indent, ensure_ascii=seed == 1) + "\n \n")
    (tmp_path / "b.json").write_text(" [ \n ] ")
    (tmp_path / "c.json").write_text(json.dumps(rows[:1]))
    schema = "n bigint, text string, deep struct<list: array<string>>"
    found = readers.read_json(spark, str(tmp_path), schema)
    assert found.rdd.getNumPartitions() > 4
    got = sorted((r["n"], r["text"]) for r in found.collect())
    assert got == sorted((r["n"], r["text"]) for r in [*rows, rows[0]])
    plain = [{"n": k, "s": t.replace("\n", "")} for k, t in enumerate(odd_texts(seed, 9))]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text(json.dumps(plain, indent=indent))
    inferred = readers.read_json(spark, str(tmp_path / "d"))
    assert sorted(tuple(r) for r in inferred.collect()) == sorted((r["n"], r["s"]) for r in plain)


@pytest.mark.parametrize(
    "text", ['{"a": 1}', "[1, 2]", '[{"a": 1}, 3]', '[{"a": 1}', '[{"a": 1}] x', '[null, {"a": 1}]', '[[{"a": 1}]]', '[{"a": 1} {"a": 2}]', '"x"']
)
def test_other_json_is_refused(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception, match="must be a list of objects.*bad.json"):
        readers.read_json(spark, str(path), "a int").collect()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_csv_with_line_breaks_is_cut_in_parallel(spark, small_blocks, tmp_path, seed):
    texts = [t.replace("\r", "") for t in odd_texts(seed, 60)]
    rows = [{"n": str(k), "a text": t, "end": texts[-k]} for k, t in enumerate(texts)]
    for name, lineterminator in (("a.csv", "\n"), ("b.csv", "\r\n")):
        with (tmp_path / name).open("w", newline="", encoding="utf-8") as file:
            writer = csv.DictWriter(file, ["n", "a text", "end"], lineterminator=lineterminator)
            writer.writeheader()
            writer.writerows(rows)
    for name in ("a.csv", "b.csv"):
        found = readers.read_csv(spark, str(tmp_path / name))
        assert found.rdd.getNumPartitions() > 4
        with (tmp_path / name).open(newline="", encoding="utf-8") as file:
            expected = [dict(row) for row in csv.DictReader(file)]
        assert sorted((r.asDict() for r in found.collect()), key=lambda r: int(r["n"])) == expected
    assert readers.read_csv(spark, str(tmp_path)).count() == 2 * len(rows)


def test_a_record_over_many_blocks(spark, small_blocks, tmp_path):
    long = '}"\n{' * 300
    (tmp_path / "x.json").write_text(json.dumps([{"a": "1"}, {"a": long}, {"a": "2"}]))
    found = readers.read_json(spark, str(tmp_path / "x.json"), "a string")
    assert sorted(r["a"] for r in found.collect()) == sorted(["1", "2", long])
    (tmp_path / "x.csv").write_text('a,b\n1,"' + "line\n" * 300 + '"\n2,z\n')
    found = readers.read_csv(spark, str(tmp_path / "x.csv"))
    assert sorted(map(tuple, found.collect())) == [("1", "line\n" * 300), ("2", "z")]


def test_malformed_lines_are_named(spark, small_blocks, tmp_path):
    lines = ['{"a": "%d"}' % k for k in range(50)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "b.jsonl").write_text("\n".join([*lines, "", ' {"a": ', *lines, "[1]", "7"]) + "\n")
    found = readers.malformed_lines(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["line"], r["value"].strip()) for r in found] == [(52, '{"a":'), (103, "[1]"), (104, "7")]
    with pytest.raises(ValueError, match=r"b\.jsonl:52 is not a JSON object"):
        readers.read_jsonl(spark, str(tmp_path), "a string", checked=True)
    held = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a string", checked=True)
    assert held.count() == 50
