"""Scans: JSON lines, JSON lists, CSV, Spark tables and split maps.

Every reader is a plain Spark source, so column pruning, partition pruning and
splittable reads apply. Bad input raises (``FAILFAST``) rather than being
silently dropped.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import BLANK_CLASS
from ..operators.joins import join_same, join_unique, quoted_name
from ..operators.ordering import global_index, rows_between
from ..session import shared_path
from .records import csv_records, json_objects

LINE_INDEX = "line_index"
SLICE = re.compile(r"(?P<name>[\w.-]+)(?P<range>\[(?P<start>\d*):(?P<stop>\d*)\])?")
Schema = T.StructType | str | None


def _reader(spark: SparkSession, schema: Schema):
    reader = spark.read.option("mode", "FAILFAST")
    return reader.schema(schema) if schema is not None else reader


def read_jsonl(
    spark: SparkSession, path, schema: Schema = None, checked: bool = False
) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones raise with the file
    named. Give a schema at scale: inference reads the data once more, and so does
    ``checked``, which names a malformed line by file and number beforehand."""
    if checked:
        check_jsonl(spark, path)
    return _reader(spark, schema).json(path)


def malformed_lines(spark: SparkSession, path) -> DataFrame:
    """``file``, ``line`` (from 1) and ``value`` of the lines that hold something but
    no JSON object. Lines are counted by block; only bad ones meet the counts of their
    file."""
    scan = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    lines = number_lines(scan)
    first = lines.groupBy("file").agg(F.min(LINE_INDEX).alias("_first"))
    text = F.trim(F.col("value"), F.lit(" \t\r\n"))
    kept = F.get_json_object(text, "$")
    sound = F.startswith(text, F.lit("{")) & kept.isNotNull()
    bad = lines.where((text != "") & ~F.coalesce(sound, F.lit(False)))
    # One row per file.
    placed = join_same(bad, first, ["file"])
    line = (F.col(LINE_INDEX) - F.col("_first") + 1).alias("line")
    return placed.select("file", line, "value")


def check_jsonl(spark: SparkSession, path) -> None:
    """Raise for the first malformed line, naming its file and number."""
    found = malformed_lines(spark, path).orderBy("file", "line").head()
    if found is not None:
        raise ValueError(f"{found['file']}:{found['line']} is not a JSON object.")


def read_json(spark: SparkSession, path, schema: Schema = None) -> DataFrame:
    """Files that each hold one JSON list of objects, read by as many tasks as a file
    has blocks. Anything else in a file fails. Without a schema the objects are
    written as lines first, from which it is inferred."""
    objects = json_objects(spark, path)
    if schema is None:
        line = F.translate("value", "\r\n", "  ").alias("value")
        written = shared_path(spark)
        objects.select(line).write.mode("overwrite").text(written)
        return _reader(spark, None).json(written)
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")
    return objects.select(parsed).select("row.*")


def read_csv(spark: SparkSession, path) -> DataFrame:
    """CSV with a header; all columns are strings, quotes are doubled, empty
    cells are empty strings. Line breaks within quotes may stand anywhere: files are
    still read by as many tasks as they have blocks."""
    named = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    fields = [T.StructField(name, T.StringType()) for name in named.columns]
    schema = ", ".join(f"{quoted_name(f.name)} string" for f in fields)
    options = {"escape": '"', "mode": "PERMISSIVE", "lineSep": "\n"}
    parsed = F.from_csv("value", schema, options).alias("row")
    rows = csv_records(spark, path).select(parsed).select("row.*")
    return rows.na.fill("")


READERS = {
    "jsonl": read_jsonl,
    "json": read_json,
    "csv": lambda spark, path, schema=None: read_csv(spark, path),
    "parquet": lambda spark, path, schema=None: spark.read.load(path, "parquet"),
    "orc": lambda spark, path, schema=None: spark.read.orc(path),
    "table": lambda spark, path, schema=None: spark.table(path),
}


def read_splits(
    spark: SparkSession, kind: str, files: Mapping[str, str], schema: Schema = None
) -> DataFrame:
    """One DataFrame with a ``split`` column from a map of split to path."""
    result = None
    for split, path in files.items():
        part = READERS[kind](spark, path, schema).withColumn("split", F.lit(str(split)))
        result = (
            part
            if result is None
            else result.unionByName(part, allowMissingColumns=True)
        )
    if result is None:
        raise ValueError("`files` must name at least one split.")
    return result


def _inside(folder: str, files: str | Sequence[str]) -> list[str]:
    """Files or patterns of a dataset's folder."""
    listed = [files] if isinstance(files, str) else files
    return [f"{folder}/{name}" for name in listed]


def read_source(
    spark: SparkSession, source: Mapping, key: Sequence[str] = ()
) -> DataFrame:
    """The scan a recipe's ``source`` block names. A DataFrame under ``data``
    stands for itself.

    ``config`` or ``name`` picks a folder of the dataset, ``data_files`` files or
    patterns in it, by split if it is a mapping. ``split`` picks one published
    split, ``name[start:stop]`` a row range of it in the order of ``key``.
    """
    if source.get("data") is not None:
        df = source["data"]
    else:
        kind = str(source.get("type", "table")).lower()
        schema = source.get("schema")
        files, path = source.get("files"), source.get("path") or source.get("dataset")
        # A named configuration is a folder of the dataset.
        part = source.get("config") or source.get("name")
        path = f"{path}/{part}" if part else path
        chosen = source.get("data_files")
        if isinstance(chosen, Mapping):
            files = {split: _inside(path, own) for split, own in chosen.items()}
        elif chosen is not None:
            path = _inside(path, chosen)
        if files is not None:
            df = read_splits(spark, kind, files, schema)
        else:
            df = READERS[kind](spark, path, schema)
    if source.get("split") is None:
        return df
    wanted = SLICE.fullmatch(str(source["split"]))
    if wanted is None:
        raise ValueError(f"Unreadable `source.split`: {source['split']!r}")
    if "split" in df.columns:
        df = df.where(F.col("split") == wanted["name"]).drop("split")
    if wanted["range"] is None:
        return df
    if not key:
        raise ValueError("A row range needs the key columns that order the rows.")
    stop = wanted["stop"]
    return rows_between(df, key, int(wanted["start"] or 0), int(stop) if stop else None)


def number_lines(df: DataFrame, name: str = LINE_INDEX) -> DataFrame:
    """Zero-based line number over all files in path order, without a shuffle.

    ``df`` must be a fresh text scan. Lines of one file block are read in order
    by one task, so a line's place inside its block is its id minus the block's
    first id; a count per block gives the blocks' offsets. Only one small row
    per input block (128 MB by default) is aggregated and, if its measured size
    allows, broadcast: about 25 MB for 100 TB.
    """
    scanned = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = scanned.groupBy("_file", "_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    before = (
        Window.partitionBy(F.lit(0))
        .orderBy("_file", "_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = F.coalesce(F.sum("_lines").over(before), F.lit(0))
    blocks = blocks.select("_file", "_start", (earlier - F.col("_first")).alias("_off"))
    placed = join_unique(scanned, blocks, ["_file", "_start"], "inner")
    return placed.withColumn(name, F.col("_id") + F.col("_off")).drop(
        "_file", "_start", "_id", "_off"
    )


def pair_id(split, index):
    """``train-000042``; longer numbers keep all their digits."""
    digits = index.cast("string")
    padded = F.when(index < 1_000_000, F.lpad(digits, 6, "0")).otherwise(digits)
    return F.concat(split, F.lit("-"), padded)


def read_pairs(spark: SparkSession, path, split: str) -> DataFrame:
    """Pair records of one JSON-lines split.

    ``pair_id`` numbers every line, blank ones too. Both keys must be there; a
    null value reads as the empty string.
    """
    lines = number_lines(spark.read.text(path))
    lines = lines.where(~F.col("value").rlike(f"^{BLANK_CLASS}*$"))
    keys = F.json_object_keys("value")
    where = F.concat(F.lit(f"{split} line "), (F.col(LINE_INDEX) + 1).cast("string"))

    def required(field: str):
        gone = F.concat(F.lit(f"No `{field}` in "), where)
        text = F.coalesce(F.get_json_object("value", f"$.{field}"), F.lit(""))
        return (
            F.when(
                keys.isNull(),
                F.raise_error(F.concat(F.lit("No JSON object in "), where)),
            )
            .when(~F.array_contains(keys, field), F.raise_error(gone))
            .otherwise(text)
        )

    return lines.select(
        pair_id(F.lit(split), F.col(LINE_INDEX)).alias("pair_id"),
        F.lit(split).alias("split"),
        required("prompt").alias("prompt"),
        required("completion").alias("completion"),
    )


def pairs_from_rows(df: DataFrame, key, split: str = "train") -> DataFrame:
    """Pair records from a table, numbered in key order."""
    for field in ("prompt", "completion"):
        if field not in df.columns:
            raise ValueError(f"The rows have no `{field}` column")
    indexed = global_index(df, key, LINE_INDEX)
    return indexed.select(
        pair_id(F.lit(split), F.col(LINE_INDEX)).alias("pair_id"),
        F.lit(split).alias("split"),
        F.coalesce(F.col("prompt").cast("string"), F.lit("")).alias("prompt"),
        F.coalesce(F.col("completion").cast("string"), F.lit("")).alias("completion"),
    )


def read_predictions(spark: SparkSession, path) -> DataFrame:
    return read_jsonl(spark, path, "prediction string, reference string")


def read_or_empty(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """JSON lines under a fixed schema, no rows where the path is missing."""
    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_summaries(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    eval_schema: T.DataType | None = None,
    strict: bool = False,
    eval_name: str = "eval",
) -> DataFrame:
    """``{root}/*/summary.json`` with the run directory, joined to the
    ``eval.json`` beside it.

    Corrupt summaries are skipped, or raise when ``strict``.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    corrupt = T.StructField("_corrupt_record", T.StringType())

    def scan(name: str, fields: T.StructType) -> DataFrame:
        known = T.StructType([*fields.fields, *([] if strict else [corrupt])])
        rows = (
            spark.read.schema(known)
            .option("multiLine", True)
            .option("mode", mode)
            .json(f"{root}/*/{name}")
        )
        folder = F.regexp_replace("_metadata.file_path", r"^file:/+|/[^/]*$", "")
        rows = rows.withColumn(
            "run_dir",
            F.when(
                F.col("_metadata.file_path").startswith("file:"),
                F.concat(F.lit("/"), folder),
            ).otherwise(folder),
        )
        if not strict:
            rows = rows.where("_corrupt_record is null").drop("_corrupt_record")
        return rows

    runs = scan("summary.json", schema)
    if eval_schema is None:
        return runs
    try:
        evals = scan("eval.json", eval_schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return runs
    packed = evals.select(
        "run_dir", F.struct(*[f.name for f in eval_schema.fields]).alias("_eval")
    )
    joined = runs.join(packed, "run_dir", "left")
    if eval_name in runs.columns:
        joined = joined.withColumn(
            eval_name, F.coalesce("_eval", F.col(eval_name))
        ).drop("_eval")
    else:
        joined = joined.withColumnRenamed("_eval", eval_name)
    return joined
