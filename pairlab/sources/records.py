"""Records that span lines, cut in parallel from files of any size.

A quoted line break or a nested bracket makes it unclear, in the middle of a file,
where a record begins. Every block of a file is therefore read twice: first for what
it does to the state (inside quotes or not, how deep), whatever the state before it;
these effects are chained over the blocks in their order; then records are cut with
each block's state known. Only what stands at the edges of blocks meets other blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_JSON_BLANKS = " \t\r\n"
WHOLE, HEAD, OPEN = 0, 1, 2


@dataclass(frozen=True)
class Effect:
    """What text does to a state: whether it ends on the other side of a quote, and
    how much deeper it ends if it began outside or inside quotes."""

    turns: bool = False
    outside: int = 0
    inside: int = 0

    def then(self, other: Effect) -> Effect:
        after_out = other.inside if self.turns else other.outside
        after_in = other.outside if self.turns else other.inside
        return Effect(
            self.turns != other.turns, self.outside + after_out, self.inside + after_in
        )

    def on(self, state: tuple[bool, int]) -> tuple[bool, int]:
        quoted, depth = state
        return quoted != self.turns, depth + (self.inside if quoted else self.outside)


def _depth(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def json_effect(text: str) -> Effect:
    if "\\" in text:
        text = _ESCAPED.sub("", text)
    if '"' not in text:
        return Effect(False, _depth(text), 0)
    parts = text.split('"')
    outside, inside = "".join(parts[0::2]), "".join(parts[1::2])
    return Effect(len(parts) % 2 == 0, _depth(outside), _depth(inside))


def csv_effect(text: str) -> Effect:
    """Doubled quotes turn twice."""
    return Effect(text.count('"') % 2 == 1)


@dataclass(frozen=True)
class Format:
    """``end`` separates the segments that the text source gives; ``effect`` is what
    a segment with its end does; a record is over after a segment that leaves text
    outside quotes at depth ``level``. A file that doesn't end in the state ``last``
    is no good, which ``says`` names."""

    end: str
    effect: Callable[[str], Effect]
    level: int
    last: tuple[bool, int] | None = None
    says: str = ""


# A list's own end, and the separator that is added behind it.
JSON_LIST = Format(
    "}", json_effect, 1, (False, -1), "JSON source must be a list of objects"
)
CSV = Format("\n", csv_effect, 0)


def _segments(spark: SparkSession, path, form: Format) -> DataFrame:
    return (
        spark.read.option("lineSep", form.end)
        .text(path)
        .select(
            F.col("value"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
        )
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """The segments of a batch by block; a block's segments stand together."""
    for batch in batches:
        files, starts = batch["file"].to_pylist(), batch["start"].to_pylist()
        values, at = batch["value"].to_pylist(), 0
        for k in range(1, len(values) + 1):
            here = k < len(values)
            if not here or starts[k] != starts[at] or files[k] != files[at]:
                yield (files[at], starts[at]), values[at:k]
                at = k


def _block_effects(segments: DataFrame, form: Format) -> DataFrame:
    """``file``, ``start`` and what each block does: one row for each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple, effect: Effect) -> pa.RecordBatch:
            found = (*key, effect.turns, effect.outside, effect.inside)
            names = ["file", "start", "turns", "outside", "inside"]
            return pa.RecordBatch.from_pydict(
                {n: [v] for n, v in zip(names, found, strict=True)}
            )

        own, total = None, Effect()
        for key, values in _runs(batches):
            if key != own:
                if own is not None:
                    yield row(own, total)
                own, total = key, Effect()
            total = total.then(form.effect(form.end.join(values) + form.end))
        if own is not None:
            yield row(own, total)

    schema = "file string, start bigint, turns boolean, outside bigint, inside bigint"
    return segments.mapInArrow(work, schema)


def _states(effects: DataFrame, form: Format) -> dict[tuple[str, int], tuple[bool, int]]:
    """The state before each block. One small row for each input block (128 MB by
    default) comes to the driver: some 100 MB for 100 TB."""
    states, ends = {}, {}
    for r in effects.orderBy("file", "start").toLocalIterator():
        state = ends.get(r["file"], (False, 0))
        states[r["file"], r["start"]] = state
        ends[r["file"]] = Effect(r["turns"], r["outside"], r["inside"]).on(state)
    bad = [f for f, end in ends.items() if form.last is not None and end != form.last]
    if bad:
        raise ValueError(f"{form.says}: {bad[0]}")
    return states


def records(spark: SparkSession, path, form: Format) -> DataFrame:
    """``file``, ``start`` (of the block where it begins), ``place`` in it and
    ``record`` (whole text) of all records under ``path``. What stands before a
    record's end, such as a list's brackets and commas, belongs to it."""
    segments = _segments(spark, path, form)
    known = spark.sparkContext.broadcast(_states(_block_effects(segments, form), form))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records, what ends an earlier block's record, and what begins one
        that a later block ends."""
        rows: list[tuple] = []

        def sent() -> pa.RecordBatch:
            kinds, keys, places, texts = zip(*rows, strict=True)
            files, starts = zip(*keys, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(kinds, pa.int32()),
                    pa.array(files, pa.string()),
                    pa.array(starts, pa.int64()),
                    pa.array(places, pa.int64()),
                    pa.array(texts, pa.string()),
                ],
                ["kind", "file", "start", "place", "record"],
            )

        own, state, held, place, head = None, (False, 0), [], 0, False
        for key, values in _runs(batches):
            if key != own:
                if held:
                    rows.append((HEAD if head else OPEN, own, place, "".join(held)))
                own, state, held, place = key, known.value[key], [], 0
                # At a file's start nothing is open yet.
                head = state[0] or state[1] > form.level
            for value in values:
                text = value + form.end
                state = form.effect(text).on(state)
                held.append(text)
                if not state[0] and state[1] <= form.level:
                    rows.append((HEAD if head else WHOLE, own, place, "".join(held)))
                    held, head, place = [], False, place + 1
            if rows:
                yield sent()
        if held:
            rows.append((HEAD if head else OPEN, own, place, "".join(held)))
            yield sent()

    cut = segments.mapInArrow(
        work, "kind int, file string, start bigint, place bigint, record string"
    )
    whole = cut.where(F.col("kind") == WHOLE)
    # At most two pieces of each block.
    pieces = cut.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "place")
    begun = F.sum((F.col("kind") == OPEN).cast("int")).over(order)
    joined = (
        pieces.withColumn("begun", begun)
        .groupBy("file", "begun")
        .agg(
            F.min(F.struct("start", "place")).alias("first"),
            F.array_sort(F.collect_list(F.struct("start", "place", "record"))).alias("all"),
        )
        .select(
            "file",
            "first.start",
            "first.place",
            F.array_join("all.record", "").alias("record"),
        )
    )
    return whole.drop("kind").unionByName(joined)


def json_objects(spark: SparkSession, path) -> DataFrame:
    """``file`` and ``value``, the text of each object of files that each hold one
    JSON list of objects. Anything else in a file fails the query and is named."""
    found = records(spark, path, JSON_LIST)
    text = F.regexp_replace("record", "^\uFEFF", "")
    bare = F.trim(text, F.lit(_JSON_BLANKS))
    first = (F.col("start") == 0) & (F.col("place") == 0)
    # The text source drops the file's last separator, which was added again above.
    last = bare.rlike(r"^(\[\s*)?\]\s*\}$")
    body = F.when(
        F.when(first, F.startswith(bare, F.lit("[")))
        .otherwise(F.startswith(bare, F.lit(",")))
        & F.endswith(bare, F.lit("}")),
        F.trim(F.substring(bare, 2, 2**31 - 1), F.lit(_JSON_BLANKS)),
    )
    fault = F.raise_error(
        F.concat(F.lit(f"{JSON_LIST.says}: "), F.col("file"))
    )
    value = F.when(F.startswith(body, F.lit("{")), body).otherwise(fault)
    return found.where(~last).select("file", value.alias("value"))


def csv_records(spark: SparkSession, path) -> DataFrame:
    """``file`` and ``value`` of each record but a file's first, the header, and but
    blank ones."""
    found = records(spark, path, CSV)
    text = F.regexp_replace("record", r"\r?\n\z", "")
    header = (F.col("start") == 0) & (F.col("place") == 0)
    return found.where(~header).select("file", text.alias("value")).where("value <> ''")
