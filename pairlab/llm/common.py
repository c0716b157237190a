"""Helpers of the training-data operators: columns by position, bounded batches,
windows seen before, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of one Arrow batch of texts: bounds a Python worker's memory by so many
#: of the longest texts.
TEXTS_PER_BATCH = 256
#: Sides of joins up to this size are sent to every executor; larger ones are
#: shuffled.
BROADCAST_BYTES = 32 * 1024**2
#: What separates words, as a class of a regular expression.
BLANKS = r"[\x20\x09-\x0D]+"


def pick(df: DataFrame, **names: str) -> DataFrame:
    """``name=column``: these columns under these names, matched exactly and the
    first of equals, so that columns differing by case or repeated don't clash."""
    placed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return placed.select(
        *[F.col(f"c{df.columns.index(c)}").alias(n) for n, c in names.items()]
    )


def documents(df: DataFrame) -> DataFrame:
    """``doc_id`` as a long and ``text``, empty where it is null."""
    return pick(df, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def in_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator], schema: str
) -> DataFrame:
    """``mapInArrow`` over batches of a bounded number of rows."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXTS_PER_BATCH:
        conf.set(key, str(TEXTS_PER_BATCH))
    return df.mapInArrow(work, schema)


def hinted(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, to be broadcast if its counted size allows."""
    small = df.count() * row_bytes <= BROADCAST_BYTES
    return F.broadcast(df) if small else df


def later_windows(windows: DataFrame) -> DataFrame:
    """Of ``windows`` (h1, h2, doc_id, pos, last), those that an equal window
    precedes in order of (doc_id, pos): with that first one's ``first_doc``.

    Equal means the same 128 bits. The first of each is found by a map-side
    combined minimum, so a window that a third of all documents hold is one row
    per task before it is shuffled. The firsts of windows that occur twice are
    written, so that the join has exchanges of its own and adaptive execution can
    split the windows' side where it is skewed.
    """
    place = F.struct("doc_id", "pos")
    firsts = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .select("h1", "h2", "first")
    )
    return (
        windows.join(materialize(firsts), ["h1", "h2"])
        .where(place > F.col("first"))
        .select("doc_id", "pos", "last", F.col("first.doc_id").alias("first_doc"))
    )


def merged(pairs: Column) -> Column:
    """Sorted, disjoint (start, end) of the union of (start, end) intervals; ends
    are exclusive, touching intervals become one."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], x["end"]).alias("end"),
        )
        return F.when(
            (F.size(done) > 0) & (x["start"] <= last["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)),
        ).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(pairs), empty, add)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node of
    ``edges`` (a, b).

    Each round gives every node the smallest label among its neighbours and then
    that label's own label, so chains halve; it ends when no label has changed.
    Labels stay in written tables, and only their count reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    links = materialize(both.where("a != b").distinct())
    labels = materialize(
        links.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.col("a")).alias("root")
        )
    )
    while True:
        near = (
            links.join(labels, links.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        best = labels.join(near, "node", "left").select(
            "node", F.least("root", "near").alias("root"), F.col("root").alias("old")
        )
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = materialize(
            best.join(jump, "root", "left").select(
                "node", F.least("root", "far").alias("root"), "old"
            )
        )
        changed = after.where(F.col("root") != F.col("old")).limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels


def rows_by(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str]
) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of a partition that is sorted by ``keys``, one after another."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        start = 0
        for i in range(1, len(values) + 1):
            if i < len(values) and values[i] == values[start]:
                continue
            if current is not None and values[start] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = values[start]
            held.append(batch.slice(start, i - start))
            start = i
    if current is not None:
        yield current, pa.Table.from_batches(held)
