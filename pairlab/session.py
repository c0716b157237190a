"""Where shared intermediate tables live, and how a plan is cut there."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where none is set, a folder of the
    warehouse, which all executors share too. A cluster whose warehouse is a folder of
    one machine has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    alone = spark.conf.get("spark.master", "local").startswith("local")
    scheme = warehouse.split(":", 1)[0] if ":" in warehouse else "file"
    if scheme == "file" and (not alone or "cluster" in spark.conf.get("spark.master", "")):
        raise ValueError(
            "Executors share no folder: set spark.checkpoint.dir to one that they do."
        )
    return f"{warehouse}/_pairlab"


def _filesystem(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def shared_path(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the shared folder. What is written there goes with the session,
    or before it by :func:`release`."""
    path = f"{shared_dir(spark).rstrip('/')}/pairlab/{uuid4().hex}{suffix}"
    files, place = _filesystem(spark, path)
    # Hadoop forgets paths that don't exist yet.
    files.mkdirs(place)
    files.deleteOnExit(place)
    _written.add(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    files, place = _filesystem(spark, path)
    files.delete(place, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables written so far. Only for when no DataFrame
    that reads them is used any more."""
    while _written:
        delete(spark, _written.pop())


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table:
    later reads neither recompute it nor depend on an executor staying alive."""
    path = shared_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
