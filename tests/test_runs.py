"""Scoring, reuse, comparisons, reports and run logs."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pairlab import session
from pairlab.operators import compare, reports, reuse, runlogs, scoring
from pairlab.session import shared_dir
from pairlab.streaming import logs

PAIRS = "pair_id string, split string, prompt string, completion string"
SCORES = "pair_id string, split string, score double"


def scores(spark, *values):
    return spark.createDataFrame([(f"p{i}", "test", v) for i, v in enumerate(values)], SCORES)


def pairs(spark, n=4):
    return spark.createDataFrame([(f"p{i}", "train", "q" * i, "c") for i in range(n)], PAIRS)


def length_scorer():
    return lambda prompt, completion: (float(len(prompt)), 1, 2, 3)


def test_scorer_and_extractor(spark):
    found = scoring.score_pairs(pairs(spark), length_scorer).orderBy("pair_id").collect()
    assert [r["score"] for r in found] == [0.0, 1.0, 2.0, 3.0]
    assert (found[0]["prompt_offset"], found[0]["completion_targets"]) == (1, 3)
    vectors = scoring.extract_features(pairs(spark), lambda: lambda p, c: [[len(p)], [1]])
    assert vectors.orderBy("pair_id").collect()[2]["features"] == [2.0, 1.0]


def test_completion_scores_reject_pairs_without_supervision(spark):
    rows = [("a", 1, 9.0, 2), ("a", 2, 1.0, 2), ("a", 3, 3.0, 2), ("b", 1, 5.0, 4)]
    df = spark.createDataFrame(rows, "pair_id string, step int, token_loss double, prompt_offset int")
    kept, rejected = scoring.split_unscored(scoring.completion_scores(df))
    assert [(r["pair_id"], r["score"]) for r in kept.collect()] == [("a", -2.0)]
    assert [r["pair_id"] for r in rejected.collect()] == ["b"]


def test_fingerprint(spark):
    df = pairs(spark, 50)
    columns = ["split", "prompt", "completion"]
    same = reuse.fingerprint(df.repartition(7), ["pair_id"], columns).head()
    assert reuse.fingerprint(df, ["pair_id"], columns).head() == same
    moved = df.withColumn("prompt", F.when(F.col("pair_id") == "p3", "other").otherwise(F.col("prompt")))
    assert reuse.fingerprint(moved, ["pair_id"], columns).head() != same
    shifted = spark.createDataFrame([("k", "ab", "c")], "k string, a string, b string")
    other = spark.createDataFrame([("k", "a", "bc")], "k string, a string, b string")
    assert reuse.fingerprint(shifted, ["k"], ["a", "b"]).head() != reuse.fingerprint(other, ["k"], ["a", "b"]).head()


def test_stored_tables_are_reused(spark, tmp_path):
    calls = []

    def compute(df):
        calls.append(sorted(r["pair_id"] for r in df.collect()))
        return scoring.score_pairs(df, length_scorer)

    root = str(tmp_path / "scores")
    first = reuse.reuse_table(pairs(spark), root, compute, {"model": "m"})
    again = reuse.reuse_table(pairs(spark).repartition(3), root, compute, {"model": "m"})
    assert sorted(first.collect()) == sorted(again.collect())
    assert len(calls) == 1
    reuse.reuse_table(pairs(spark), root, compute, {"model": "other"})
    reuse.reuse_table(pairs(spark, 5), root, compute, {"model": "m"})
    assert len(calls) == 3


def test_only_missing_rows_are_computed(spark, tmp_path):
    df, root = pairs(spark), str(tmp_path / "scores")
    path = f"{root}/{reuse.table_digest(df, ['pair_id', 'split'], ['prompt', 'completion'], {})}"
    scoring.score_pairs(df.where("pair_id < 'p2'"), length_scorer).write.parquet(path)
    calls = []

    def compute(rows):
        calls.append(sorted(r["pair_id"] for r in rows.collect()))
        return scoring.score_pairs(rows, length_scorer)

    found = reuse.reuse_table(df, root, compute, {})
    assert calls == [["p2", "p3"]]
    assert sorted(r["score"] for r in found.collect()) == [0.0, 1.0, 2.0, 3.0]
    extra = spark.createDataFrame([("zz", "train", 1.0, 1, 1, 1)], scoring.SCORE_SCHEMA)
    extra.write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="another record set"):
        reuse.reuse_table(df, root, compute, {})


def test_comparison(spark):
    base, full, subset = scores(spark, 0.0, 0.0), scores(spark, 1.0, -1.0), scores(spark, 0.8, -0.7)
    rows = compare.comparison_rows(base, full, subset)
    found = {r["pair_id"]: r for r in rows.collect()}
    assert found["p0"]["delta_error"] == pytest.approx(-0.2)
    assert found["p1"]["delta_sign_match"] is True
    summary = compare.summarize_comparison(rows).head()
    assert summary["num_examples"] == 2
    assert summary["delta_sign_accuracy"] == 1.0
    assert summary["delta_pearson"] == pytest.approx(1.0)
    assert summary["mean_delta_gap"] == pytest.approx(0.05)
    empty = compare.summarize_comparison(rows.limit(0)).head()
    assert (empty["num_examples"], empty["mean_delta_gap"]) == (0, None)


def test_incomplete_comparison(spark):
    base, full = scores(spark, 0.0, 0.0), scores(spark, 1.0)
    with pytest.raises(ValueError, match="differ in their pairs"):
        compare.check_comparison(base, full, base)
    compare.check_comparison(base, base, base)


SAMPLING = """{"selector_path": "/x/selectors/lora_ntk_kmeans.py", "max_example": 128,
  "selector_context": {"selector_feature_pipeline": {"transformations": ["sign"],
    "raw_feature_dim": 10, "projection": {"name": "sparse_random", "output_dim": 4}},
    "selector_timing": {"total_seconds": 1.5}}}"""


def test_method_names(spark):
    def method(text, fallback=None):
        parsed = F.from_json(F.lit(text), F.schema_of_json(F.lit(text)))
        df = spark.range(1).select(parsed.alias("sampling"))
        flat = df.select(*compare.selector_details(df))
        given = None if fallback is None else F.lit(fallback)
        made = compare.selection_method(F.col("selector"), F.col("transformations"), F.col("projection"), given)
        return flat.select("*", made.alias("method")).head()

    found = method(SAMPLING)
    assert found["method"] == "kmeans+sparse_random+sign"
    assert (found["max_examples"], found["projection_dim"], found["raw_feature_dim"]) == (128, 4, 10)
    assert found["selector_total_seconds"] == 1.5
    assert method('{"selector_path": "random.py"}')["method"] == "random"
    assert method('{"selector_path": "lora_ntk_kmeans.py"}')["method"] == "kmeans"
    assert method('{"selector_path": "a/own.py"}')["method"] == "own"
    assert method('{"selector_path": "a/own.py"}', "given")["method"] == "given"
    assert method('{"max_example": 3}')["method"] == "-"


RUN = (
    "run_name string, status string, base_model string, dataset_name string, backend string, "
    "feature_transform_label string, split_sizes struct<train: int>, test_delta_pearson double"
)


def run(name, size, pearson, status="completed", label=None, dataset="Open-Math"):
    return (name, status, "org/m", dataset, "lora_ntk", label, (size,), pearson)


def test_primary_runs(spark):
    rows = [
        run("a", 64, 0.9),
        run("b", 128, 0.1),
        run("c", 128, 0.2),
        run("d", 512, 0.9, "failed"),
        run("e", 128, 0.2, dataset="open_math"),
        run("f", 16, None, label="sign"),
        run("g", 16, -0.5, label="sign"),
    ]
    df = spark.createDataFrame(rows, RUN)
    found = {r["feature_label"]: r["run_name"] for r in reports.primary_runs(df).collect()}
    assert found == {"raw": "e", "sign": "g"}
    assert reports.primary_runs(df, ["other"]).count() == 0
    grid = reports.comparison_grid(df, ["open math", "Other"], ["lora_ntk"], ["org/m"])
    cells = {(r["dataset"], r["feature_label"]): r["status"] for r in grid.collect()}
    assert cells == {
        ("open math", "raw"): "completed",
        ("open math", "sign"): "completed",
        ("Other", "raw"): "missing",
        ("Other", "sign"): "missing",
    }


def test_feature_keys(spark):
    labels = ["Raw", "", "identity", "x+thresholded-sign(0.1)", "SIGN", "a / sign", "signs"]
    df = spark.createDataFrame([(v,) for v in labels], "v string")
    found = [r[0] for r in df.select(reports.feature_key(F.col("v"))).collect()]
    assert found == ["raw", "raw", "raw", "thresholded_sign", "sign", "sign", "signs"]


def test_fixed_point_rounds_like_python(spark):
    values = [0.36405, 1.09425, 2.675, 1234567.5, -0.00001, 0.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in df.select(reports.fixed_point(F.col("v"), 2)).collect()]
    assert found == [f"{v:.2f}" for v in values]


def test_method_order(spark):
    rows = [("zeta", 1.0), ("kmeans", 2.0), ("alpha", 3.0), ("random", 4.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "method string, value double")
    found = [r["method"] for r in reports.mean_by_method(df, "value").collect()]
    assert found == ["random", "kmeans", "alpha", "zeta"]


LINES = """Loading data
Iter 10: Train loss 1.5, Learning Rate 1.000e-05, It/sec 1.426, Tokens/sec 251.622, Trained Tokens 1764, Peak mem 18.5 GB
Iter 10: Val loss 1.6, Val took 2.5s
Iter 20: Train loss nan
Iter 20: Val loss 1.4
Iter 30: Val loss 1.4
Test loss 1.25, Test ppl 3.49.
"""


def parsed(spark):
    lines = [(i, line) for i, line in enumerate(LINES.splitlines())]
    df = spark.createDataFrame(lines, "ordinal int, value string").withColumn("run_name", F.lit("r"))
    return runlogs.parse_log_lines(df, keep=["run_name", "ordinal"])


def test_log_lines(spark):
    rows = parsed(spark).orderBy("ordinal").collect()
    assert [r["event"] for r in rows] == ["train", "val", "train", "val", "val", "test"]
    first = rows[0].asDict()
    assert first["step"] == 10 and first["learning_rate"] == 1e-05
    assert first["trained_tokens"] == 1764 and first["peak_mem_gb"] == 18.5
    assert rows[1]["val_seconds"] == 2.5
    assert rows[2]["train_loss"] is None
    assert (rows[5]["test_loss"], rows[5]["test_ppl"]) == (1.25, 3.49)


EXPECTED = {
    "run_name": "r",
    "last_train_step": 20,
    "last_train_loss": None,
    "last_learning_rate": None,
    "last_it_per_sec": None,
    "last_tokens_per_sec": None,
    "trained_tokens": None,
    "peak_mem_gb": 18.5,
    "best_val_loss": 1.4,
    "best_val_step": 20,
    "test_loss": 1.25,
    "test_ppl": 3.49,
}


def test_run_summary(spark):
    assert runlogs.summarize_events(parsed(spark)).head().asDict() == EXPECTED


def test_streamed_logs(spark, tmp_path):
    """Two files of one run arrive in turn; each line is read once."""
    folder = tmp_path / "logs" / "r"
    folder.mkdir(parents=True)
    lines = LINES.splitlines()
    state, out = str(tmp_path / "state"), str(tmp_path / "events")

    def drain():
        events = logs.stream_events(logs.stream_lines(spark, str(tmp_path / "logs")), "train")
        logs.append_events(events.drop("ordinal"), out, state, once=True).awaitTermination()
        table = logs.write_summaries(logs.live_summaries(events), str(tmp_path / "sums"), str(tmp_path / "state2"), once=True)
        table.awaitTermination()

    (folder / "a.log").write_text("\n".join(lines[:3]) + "\n")
    drain()
    (folder / "b.log").write_text("\n".join(lines[3:]) + "\n")
    drain()
    rows = spark.read.json(out).collect()
    assert len(rows) == 6
    assert {r["source_phase"] for r in rows} == {"train"}
    assert all(r["timestamp"][10] == "T" for r in rows)
    assert logs.read_summaries(spark, str(tmp_path / "sums")).head().asDict() == EXPECTED
    assert len(list((tmp_path / "sums").glob("version=*"))) <= 2


def test_only_changed_buckets_are_renewed(spark, tmp_path):
    """Changed, new and removed rows; a call without news computes nothing."""
    calls = []

    def compute(rows):
        found = rows.select("k", F.concat("a", F.lit("!")).alias("out"))
        calls.append(sorted(r["k"] for r in found.collect()))
        return found

    def call(rows):
        df = spark.createDataFrame(rows, "k long, a string")
        found = reuse.renew_table(df, str(tmp_path), compute, {"m": 1}, ["k"], ["a"], 8)
        got = {r["k"]: r["out"] for r in found.collect()}
        assert got == {k: f"{a}!" for k, a in rows} and found.count() == len(rows)

    rows = [(k, f"t{k}") for k in range(40)]
    call(rows)
    call(rows[::-1])
    assert len(calls) == 1 and calls[0] == list(range(40))
    call([(k, "new" if k == 3 else a) for k, a in rows])
    assert 3 in calls[1] and len(calls[1]) < 20
    call([(k, "new" if k == 3 else a) for k, a in rows if k != 5] + [(99, "x")])
    assert 99 in calls[2] and 5 not in calls[2] and len(calls[2]) < 30
    call(rows[:1])
    call([])


def test_growing_logs_are_followed(spark, tmp_path):
    """Lines come at the end of a file already read, and in a second one."""
    file, other = tmp_path / "logs" / "r" / "a.log", tmp_path / "logs" / "s" / "b.log"
    for one in (file, other):
        one.parent.mkdir(parents=True)
    lines = LINES.splitlines()
    out, state = str(tmp_path / "events"), str(tmp_path / "state")

    def poll():
        return logs.poll_events(spark, str(tmp_path / "logs"), out, state, "train")

    file.write_text("\n".join(lines[:2]) + "\n")
    assert (poll(), poll()) == (2, 0)
    with file.open("a") as more:
        more.write("\n".join(lines[2:]) + "\n")
    other.write_text(lines[0] + "\n")
    assert (poll(), poll()) == (len(lines) - 1, 0)
    schema = logs.stream_events(logs.tail_lines(spark, str(tmp_path / "logs")), "x").schema
    found = spark.read.schema(schema).json(out)
    assert found.where("run_name = 'r'").count() == 6
    assert found.where("run_name = 's'").count() <= 1
    summary = runlogs.summarize_events(found.where("run_name = 'r'").drop("version"))
    got = summary.head().asDict()
    assert {k: got[k] for k in EXPECTED if k in got and k != "run_name"} == {
        k: v for k, v in EXPECTED.items() if k in got and k != "run_name"
    }


def test_each_byte_is_read_once(tmp_path, monkeypatch):
    """Ranges of a few bytes cut lines anywhere; every line comes once, whole."""
    from pairlab.sources import log_tail

    monkeypatch.setattr(log_tail, "TASK_BYTES", 7)
    monkeypatch.setattr(log_tail, "BLOCK_BYTES", 3)
    folder = tmp_path / "logs" / "run"
    folder.mkdir(parents=True)
    reader = log_tail.LogTailReader(str(tmp_path / "logs"), True)

    def news(start, end):
        found = []
        for part in reader.partitions(start, end):
            for batch in reader.read(part):
                found += batch.to_pylist()
        return sorted((r["start"], r["value"]) for r in found)

    first = "é one\n\ntwo two two two\nx\nunfin"
    (folder / "a.log").write_text(first)
    (folder / ".hidden").write_text("no\n")
    start = reader.initialOffset()
    end = reader.latestOffset()
    text = first.encode()
    assert end == {str(folder / "a.log"): text.rindex(b"\n") + 1}
    assert [v for _, v in news(start, end)] == ["é one", "", "two two two two", "x"]
    assert reader.latestOffset() == end and news(end, end) == []
    with (folder / "a.log").open("a") as more:
        more.write("ished\nlast\n")
    after = reader.latestOffset()
    assert news(end, after) == [
        (text.rindex(b"\n") + 1, "unfinished"),
        (len(text) + 6, "last"),
    ]
    size = sum(stop - at for p in reader.partitions(end, after) for _, at, stop, _, _ in p.parts)
    assert size == len(b"unfinished\nlast\n")
    (folder / "a.log").write_text("anew\n")
    assert news(after, reader.latestOffset()) == [(0, "anew")]


def test_unfinished_lines_wait(spark, tmp_path):
    file = tmp_path / "logs" / "r" / "a.log"
    file.parent.mkdir(parents=True)
    out, state = str(tmp_path / "events"), str(tmp_path / "state")

    def poll():
        return logs.poll_events(spark, str(tmp_path / "logs"), out, state, "x", "wait")

    assert poll() == 0
    file.write_text("Iter 1: Train loss 2.5\nIter 2: Tr")
    assert (poll(), poll()) == (1, 0)
    with file.open("a") as more:
        more.write("ain loss 1.5\n")
    assert (poll(), poll()) == (1, 0)
    steps = [r["step"] for r in spark.read.json(out).orderBy("step").collect()]
    assert steps == [1, 2]


def test_summaries_are_assembled(spark):
    runs = spark.createDataFrame([("r", "d"), ("s", "d")], "run_name string, dataset_name string")
    tasks = spark.createDataFrame([("r", "f1", 0.25)], "run_name string, metric_name string, metric_value double")
    made = runlogs.build_summaries(runs, runlogs.summarize_events(parsed(spark)), None, tasks)
    shown = {r["run"]: r for r in reports.run_table(made).collect()}
    assert shown["r"]["task_metric"] == "f1=0.250"
    assert shown["r"]["test_ppl"] == "3.490"
    assert shown["s"]["task_metric"] == "-"
    assert shown["s"]["best_val_loss"] == "-"


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    held = {"spark.sql.warehouse.dir": "hdfs://x/warehouse/"}
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: held.get(k, d)))
    assert shared_dir(unset) == "hdfs://x/warehouse/_pairlab"
    held["spark.sql.warehouse.dir"] = "file:/work/warehouse"
    assert shared_dir(unset) == "file:/work/warehouse/_pairlab"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        held["spark.master"] = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(unset)


def test_intermediate_tables_can_be_deleted(spark):
    made = session.materialize(spark.range(5))
    assert made.count() == 5
    folder = Path(session.shared_dir(spark)) / "pairlab"
    assert list(folder.iterdir())
    session.release(spark)
    assert not list(folder.iterdir())


def test_adapter_lookup(spark):
    rows = [
        ("r1", "runs/1", "ad/x/", "completed", "Open-Math", "m", "2024-01-02", "a"),
        ("r2", "runs/2", "ad/x", "completed", "open math", "m", "2024-01-03", "a"),
        ("r3", "runs/3", "ad/y", "failed", "open math", "m", "2024-01-09", "a"),
        ("r4", "runs/4", "ad/z", "COMPLETED", "openmath", "", "2024-01-01", "a"),
        ("r5", "runs/5", "", "completed", "openmath", "m", "2025-01-01", "a"),
    ]
    schema = "run_name string, run_dir string, adapter_dir string, status string, dataset_name string, base_model string, updated_at string, created_at string"
    runs = spark.createDataFrame(rows, schema)
    wanted = spark.createDataFrame([("ad/x",), ("none",)], "adapter_path string")
    found = {r["adapter_path"]: r["run_name"] for r in compare.runs_for_adapters(wanted, runs).collect()}
    assert found == {"ad/x": "r1", "none": None}
    requests = spark.createDataFrame([("OPEN_MATH", "m"), ("open math", "n"), ("open math", ""), ("x", "m")], "dataset_name string, base_model string")
    got = {(r["dataset_name"], r["base_model"]): r["adapter_dir"] for r in compare.resolve_adapters(requests, runs).collect()}
    assert got == {("OPEN_MATH", "m"): "ad/x", ("open math", "n"): "ad/z", ("open math", ""): "ad/x", ("x", "m"): None}

