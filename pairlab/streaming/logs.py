"""Live run logs with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runlogs import parse_log_lines, summarize_events
from ..session import delete, materialize
from ..sources.log_tail import NAME, register


def stream_lines(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """Lines of log files as they appear under ``path``, with run and arrival.

    The run is the name of the file's folder. ``arrival`` orders the pieces of a
    run by file time and by place in the file.
    """
    reader = spark.readStream.format("text").option("recursiveFileLookup", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(path)
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return lines.select(
        "value",
        folder.alias("run_name"),
        F.struct(
            F.col("_metadata.file_modification_time").alias("written"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
        ).alias("arrival"),
    )


def stream_events(lines: DataFrame, source_phase: str) -> DataFrame:
    """Parsed events stamped with arrival time and phase; works on a batch too.

    Lines without an ``ordinal`` are ordered by arrival, then by step.
    """
    keep = [c for c in ("run_name", "ordinal", "arrival") if c in lines.columns]
    events = parse_log_lines(lines, keep=keep)
    if "arrival" in keep:
        events = events.withColumn("ordinal", F.struct("arrival", "step"))
        events = events.drop("arrival")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return events.withColumns(
        {"timestamp": stamp, "source_phase": F.lit(source_phase)}
    )


def append_events(
    events: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append events to JSON lines. The checkpoint makes each line count once."""
    writer = (
        events.writeStream.format("json")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def tail_lines(
    spark: SparkSession, path: str, unfinished: str = "wait"
) -> DataFrame:
    """Lines of the log files under ``path`` as they are written, each byte read once:
    a trigger reads what new files hold and what known ones have grown by. The run is
    the name of the file's folder, ``ordinal`` the file and the line's place in it;
    see :class:`..sources.log_tail.LogTail` for ``unfinished``.
    """
    register(spark)
    reader = spark.readStream.format(NAME).option("unfinished", unfinished)
    return reader.load(path).select(
        "value", "run_name", "file", F.struct("file", "start").alias("ordinal")
    )


def poll_events(
    spark: SparkSession,
    path: str,
    out: str,
    state: str,
    source_phase: str,
    unfinished: str = "read",
) -> int:
    """Append the events of lines that have come since the last call, and return the
    number of these lines; call it as often as news are wanted.

    ``state`` is the checkpoint: how many bytes of each file have been read. Events go
    to a folder of their trigger, so one that broke off is simply done again.
    """
    counted = []

    def store(batch: DataFrame, number: int) -> None:
        # Read from the source once, for the count and for the events.
        held = materialize(batch)
        counted.append(held.count())
        events = stream_events(held, source_phase)
        events.write.mode("overwrite").json(f"{out}/version={number}")

    lines = tail_lines(spark, path, unfinished)
    running = (
        lines.writeStream.foreachBatch(store)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return sum(counted)


def live_summaries(events: DataFrame) -> DataFrame:
    """Running summary per run, for ``complete`` output. State grows with the
    number of runs, not of lines."""
    return summarize_events(events)


def write_summaries(
    summaries: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Keep the table at ``path`` equal to the summaries so far. Each batch writes
    the whole result as a version of its own, so readers always find a complete
    one, and repeating a batch changes nothing; see :func:`read_summaries`."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")
        # The last one stays for those who are reading it.
        if number > 1:
            delete(batch.sparkSession, f"{path}/version={number - 2}")

    writer = (
        summaries.writeStream.foreachBatch(store)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a summary table."""
    versions = spark.read.parquet(path)
    newest = versions.select(F.max("version")).scalar()
    return versions.where(F.col("version") == newest).drop("version")
