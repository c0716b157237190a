"""Run logs, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import runlogs
from pairlab.operators.reports import run_table
from pairlab.session import shared_path
from pairlab.streaming import logs

from .registry import query, table


def log_lines(events):
    """Events written as the lines a trainer prints, one run per user."""
    kind, value, step = F.col("event_type"), F.col("value"), F.col("event_id")
    shown, number = value.cast("string"), step.cast("string")
    full = F.concat(
        F.lit("Iter "), number, F.lit(": Train loss "), shown,
        F.lit(", Learning Rate 1.000e-05, It/sec "), (value / 4).cast("string"),
        F.lit(", Tokens/sec "), (value / 2).cast("string"),
        F.lit(", Trained Tokens "), (step * 3).cast("string"),
        F.lit(", Peak mem "), (value / 8).cast("string"), F.lit(" GB\n"),
    )
    short = F.concat(
        F.lit("  Iter "), number, F.lit(": Train loss "),
        F.when(value < 1, "nan").otherwise(shown),
    )
    val = F.concat(
        F.lit("Iter "), number, F.lit(": Val loss "), shown, F.lit(", Val took "),
        (value / 16).cast("string"), F.lit("s"),
    )
    test = F.concat(F.lit("Test loss "), shown, F.lit(", Test ppl "), shown, F.lit("."))
    line = (
        F.when(kind == "click", full)
        .when(kind == "signup", short)
        .when(kind == "view", val)
        .when(kind == "purchase", test)
        .otherwise(F.concat(F.lit("Saved weights "), number))
    )
    return events.select(
        F.col("user_id").alias("run_name"),
        F.col("event_id").alias("ordinal"),
        line.alias("value"),
    )


EVENTS = """
    select user_id as run_name, event_id as ordinal,
           case event_type when 'view' then 'val' when 'purchase' then 'test'
             else 'train' end as event,
           case when event_type <> 'purchase' then event_id end as step,
           case when event_type = 'click' or (event_type = 'signup' and value >= 1)
             then value end as train_loss,
           case when event_type = 'click' then 0.00001::double end as learning_rate,
           case when event_type = 'click' then value / 4 end as it_per_sec,
           case when event_type = 'click' then value / 2 end as tokens_per_sec,
           case when event_type = 'click' then event_id * 3 end as trained_tokens,
           case when event_type = 'click' then value / 8 end as peak_mem_gb,
           case when event_type = 'view' then value end as val_loss,
           case when event_type = 'view' then value / 16 end as val_seconds,
           case when event_type = 'purchase' then value end as test_loss,
           case when event_type = 'purchase' then value end as test_ppl
    from events where event_type <> 'error'
    """


@query("parse_log_lines", EVENTS)
def parse_log_lines(spark, sf_dir):
    lines = log_lines(table(spark, sf_dir, "events"))
    return runlogs.parse_log_lines(lines, keep=["run_name", "ordinal"])


SUMMARY = f"""
    with e as ({EVENTS}), runs as (select distinct run_name from e),
    train as (select * from e where event = 'train'
              qualify row_number() over (partition by run_name
                order by ordinal desc) = 1),
    test as (select * from e where event = 'test'
             qualify row_number() over (partition by run_name
               order by ordinal desc) = 1),
    val as (select * from e where event = 'val' and val_loss is not null
            qualify row_number() over (partition by run_name
              order by val_loss, ordinal) = 1),
    peak as (select run_name, max(peak_mem_gb) as peak from e where event = 'train'
             group by run_name)
    select run_name, train.step as last_train_step, train.train_loss as last_train_loss,
           train.learning_rate as last_learning_rate,
           train.it_per_sec as last_it_per_sec,
           train.tokens_per_sec as last_tokens_per_sec,
           train.trained_tokens as trained_tokens, peak as peak_mem_gb,
           val.val_loss as best_val_loss, val.step as best_val_step,
           test.test_loss as test_loss, test.test_ppl as test_ppl
    from runs left join train using (run_name) left join test using (run_name)
      left join val using (run_name) left join peak using (run_name)
    """


def batch_summaries(spark, sf_dir):
    lines = log_lines(table(spark, sf_dir, "events"))
    events = runlogs.parse_log_lines(lines, keep=["run_name", "ordinal"])
    return runlogs.summarize_events(events)


@query("summarize_runs", SUMMARY)
def summarize_runs(spark, sf_dir):
    return batch_summaries(spark, sf_dir)


@query(
    "best_validation",
    f"""
    select run_name, arg_min(val_loss, {{'l': val_loss, 'o': ordinal}}) as best_val_loss,
           arg_min(step, {{'l': val_loss, 'o': ordinal}}) as best_val_step
    from ({EVENTS}) where event = 'val' group by run_name
    """,
)
def best_validation(spark, sf_dir):
    lines = log_lines(table(spark, sf_dir, "events"))
    events = runlogs.parse_log_lines(lines, keep=["run_name", "ordinal"])
    best = events.groupBy("run_name").agg(runlogs.best_validation().alias("best"))
    return best.where("best is not null").select(
        "run_name",
        F.col("best.val_loss").alias("best_val_loss"),
        F.col("best.step").alias("best_val_step"),
    )


def summaries(spark, sf_dir):
    """Run metadata from the customers, with metrics and evaluation."""
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_name"),
        F.col("c_mktsegment").alias("dataset_name"),
        F.concat(F.lit("org/"), F.lower("c_mktsegment")).alias("base_model"),
        F.lit("completed").alias("status"),
    )
    evaluated = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("run_name")
    )
    task_eval = evaluated.agg(
        F.lit("f1").alias("metric_name"),
        (F.max("o_totalprice") / 500000).alias("metric_value"),
    )
    metrics = batch_summaries(spark, sf_dir)
    return runlogs.build_summaries(users, metrics, None, task_eval)


ASSEMBLED = f"""
    with s as ({SUMMARY}),
    t as (select o_custkey as run_name, max(o_totalprice) / 500000 as metric_value
          from orders group by o_custkey)
    select c_custkey as run_name, c_mktsegment as dataset_name,
           lower(c_mktsegment) as model, s.last_train_loss, s.best_val_loss, s.test_ppl,
           s.peak_mem_gb, t.metric_value
    from customer left join s on s.run_name = c_custkey
      left join t on t.run_name = c_custkey
    """


@query(
    "build_summaries",
    f"""
    select run_name, dataset_name, 'org/' || model as base_model, last_train_loss,
           best_val_loss, metric_value
    from ({ASSEMBLED})
    """,
)
def build_summaries(spark, sf_dir):
    return summaries(spark, sf_dir).select(
        "run_name",
        "dataset_name",
        "base_model",
        "metrics.last_train_loss",
        "metrics.best_val_loss",
        "task_eval.metric_value",
    )


def shown(value: str) -> str:
    return f"case when {value} is null then '-' else printf('%.3f', {value}) end"


@query(
    "run_table",
    f"""
    select run_name::varchar as run, model as base_model, dataset_name as dataset,
           '-' as task, 'completed' as status,
           {shown('last_train_loss')} as last_train_loss,
           {shown('best_val_loss')} as best_val_loss, {shown('test_ppl')} as test_ppl,
           case when metric_value is null then '-'
             else 'f1=' || printf('%.3f', metric_value) end as task_metric,
           {shown('peak_mem_gb')} as peak_mem_gb, '-' as adapter
    from ({ASSEMBLED})
    """,
)
def runs_shown(spark, sf_dir):
    return run_table(summaries(spark, sf_dir))


def streamed_lines(spark, sf_dir):
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return log_lines(reader.parquet(sf_dir))


def write_logs(lines, folder):
    """A text file for each run with its lines so far, written by the tasks. Written
    again with more lines, a file has grown, as a trainer's log does."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)

    def save(batches):
        out, own = None, None
        for batch in batches:
            for run, ordinal, line in zip(*batch.to_pydict().values()):
                if run != own:
                    if out:
                        out.close()
                    own = run
                    store.create_dir(f"{root}/{run}")
                    out = store.open_output_stream(f"{root}/{run}/train.log")
                out.write(f"{ordinal}\t{line.strip()}\n".encode())
            yield batch.slice(0, 0)
        if out:
            out.close()

    ordered = lines.select("run_name", "ordinal", "value").repartition("run_name")
    ordered = ordered.sortWithinPartitions("run_name", "ordinal")
    ordered.mapInArrow(save, ordered.schema).count()


@query("stream_events", EVENTS)
def stream_events(spark, sf_dir):
    """Log files grow between two triggers; each reads only what has come since.
    Events are appended and read back. The line's own number leads each line."""
    root = shared_path(spark)
    folder = root if "://" in root or root.startswith("file:") else f"file://{root}"
    lines = log_lines(table(spark, sf_dir, "events"))
    half = lines.agg(F.expr("percentile_approx(ordinal, 0.5)")).scalar()
    for shown in (lines.where(F.col("ordinal") <= half), lines):
        write_logs(shown, f"{folder}/logs")
        tailed = logs.tail_lines(spark, f"{folder}/logs")
        parts = F.split("value", "\t", 2)
        own = tailed.select(
            F.col("run_name").cast("bigint").alias("run_name"),
            parts[0].cast("bigint").alias("ordinal"),
            parts[1].alias("value"),
        )
        events = logs.stream_events(own, "train")
        logs.append_events(
            events, f"{root}/events", f"{root}/state", once=True
        ).awaitTermination()
    stored = spark.read.schema(events.schema).json(f"{root}/events")
    return stored.drop("timestamp", "source_phase")


@query("stream_summaries", SUMMARY)
def stream_summaries(spark, sf_dir):
    """The run summary kept up to date while lines arrive."""
    root = shared_path(spark)
    events = logs.stream_events(streamed_lines(spark, sf_dir), "train")
    running = logs.write_summaries(
        logs.live_summaries(events), f"{root}/summaries", f"{root}/state", once=True
    )
    running.awaitTermination()
    return logs.read_summaries(spark, f"{root}/summaries")
