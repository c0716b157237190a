"""Content fingerprints and reuse of stored tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import quoted
from ..session import materialize


def _text(df: DataFrame, names: Sequence[str]) -> Column:
    """The columns' values as one text that no other values give."""
    parts = [
        # A length and a text, or a mark that no length is.
        F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        for text in [quoted(name).cast("string") for name in names]
    ]
    return F.concat_ws("|", *parts)


def fingerprint(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """One row (for each group ``by``) that identifies a record set: its count, and
    the sum and the exclusive or of 60-bit pieces of a SHA-256 per record.

    Order belongs to a record through its key, so the digest needs no sort: both
    folds are combined on the map side and every partitioning gives the same.
    """
    digest = F.sha2(_text(df, [*key, *columns]), 256)

    def piece(start: int):
        return F.conv(F.substring(digest, start, 15), 16, 10)

    return df.groupBy(*[quoted(c) for c in by]).agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(piece(1).cast("decimal(20,0)")), F.lit(0))
        .cast("string")
        .alias("digest_sum"),
        F.coalesce(F.bit_xor(piece(16).cast("bigint")), F.lit(0)).alias("digest_xor"),
    )


def table_digest(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], params: Mapping
) -> str:
    """Hex digest of a record set together with the parameters that shape what is
    computed from it."""
    row = fingerprint(df, key, columns).head().asDict()
    names = {"key": list(key), "columns": list(columns)}
    text = json.dumps({"records": row, "params": dict(params)} | names, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def missing_rows(df: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that have no stored result yet."""
    return df.join(stored.select(*key), list(key), "left_anti")


def _stored(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def reuse_table(
    df: DataFrame,
    root: str,
    compute: Callable[[DataFrame], DataFrame],
    params: Mapping,
    key: Sequence[str] = ("pair_id", "split"),
    columns: Sequence[str] = ("prompt", "completion"),
) -> DataFrame:
    """Results of ``compute`` for ``df``, stored under a digest of the rows and
    ``params``.

    Leave out of ``params`` what only shapes later steps (feature transformations
    for instance), so that raw results are shared. A table whose keys are not
    exactly those of ``df`` is not trusted; only the rows it lacks are computed.
    """
    path = f"{root}/{table_digest(df, key, columns, params)}"
    stored = _stored(df, path)
    if stored is None:
        compute(df).write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    if not missing_rows(stored, df, key).isEmpty():
        raise ValueError(f"Stored table holds rows of another record set: {path}")
    missing = missing_rows(df, stored, key)
    if not missing.isEmpty():
        compute(missing).write.mode("append").parquet(path)
        stored = df.sparkSession.read.parquet(path)
    return stored


LEAF = ["records", "digest_sum", "digest_xor"]


def key_bucket(df: DataFrame, key: Sequence[str], buckets: int) -> Column:
    """The bucket of a row by its key, the same wherever it is computed."""
    start = F.substring(F.sha2(_text(df, key), 256), 1, 8)
    return (F.conv(start, 16, 10).cast("bigint") % buckets).cast("int")


def _newest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """The last complete list of leaves, and its number."""
    try:
        lists = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return -1, None
    number = lists.agg(F.max("list")).head()[0]
    if number is None:
        return -1, None
    return int(number), lists.where(F.col("list") == number).drop("list")


def renew_table(
    df: DataFrame,
    root: str,
    compute: Callable[[DataFrame], DataFrame],
    params: Mapping,
    key: Sequence[str] = ("pair_id", "split"),
    columns: Sequence[str] = ("prompt", "completion"),
    buckets: int = 1024,
) -> DataFrame:
    """Results of ``compute`` for ``df``, of which only those of changed rows'
    neighbours are computed anew; with ``version``, the call that computed a row.

    Rows fall into buckets by their key. A digest of each bucket's rows is a leaf, the
    digest of all leaves the root of a tree: a call compares leaves with those stored,
    and computes the buckets in which a row is new, gone or different. Results of a
    bucket lie in a folder of the call that wrote them; the list of leaves, written
    last, says which counts, so a call that broke off changes nothing. ``compute``
    keeps the key columns. The list has a row for each bucket, whatever the table.
    """
    spark = df.sparkSession
    names = {"key": list(key), "columns": list(columns), "buckets": buckets}
    text = json.dumps({"params": dict(params)} | names, sort_keys=True)
    place = f"{root}/{hashlib.sha256(text.encode()).hexdigest()}"
    number, known = _newest(spark, f"{place}/leaves")
    marked = df.withColumn("_bucket", key_bucket(df, key, buckets))
    leaves = materialize(fingerprint(marked, key, columns, ["_bucket"]))
    if known is None:
        stale, kept = leaves, None
    else:
        known = materialize(known)
        kept = leaves.join(known, ["_bucket", *LEAF]).select("_bucket", *LEAF, "version")
        stale = leaves.join(known, ["_bucket", *LEAF], "left_anti")
    stale = materialize(stale)
    version = number + 1
    if stale.isEmpty() and leaves.count() == known.count():
        current = known
    else:
        # At most one small row for each bucket.
        own = marked.join(F.broadcast(stale.select("_bucket")), "_bucket", "left_semi")
        made = compute(own.drop("_bucket"))
        made = made.withColumn("_bucket", key_bucket(made, key, buckets))
        made.write.mode("overwrite").parquet(f"{place}/results/version={version}")
        current = stale.withColumn("version", F.lit(version))
        current = current if kept is None else current.unionByName(kept)
        current.coalesce(1).write.mode("overwrite").parquet(f"{place}/leaves/list={version}")
        current = spark.read.parquet(f"{place}/leaves/list={version}")
    results = spark.read.option("mergeSchema", True).parquet(f"{place}/results")
    wanted = F.broadcast(current.select("_bucket", "version"))
    return results.join(wanted, ["_bucket", "version"], "left_semi").drop("_bucket")
