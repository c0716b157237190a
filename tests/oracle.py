"""Run a query and its SQL twin side by side."""

from __future__ import annotations

import math
from glob import glob
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {Path(path).stem} as select * from '{path}'")
    return con


def kind(dtype: str) -> str:
    """Engine-neutral type name."""
    dtype = str(dtype).lower()
    names = {
        "bigint": "int64", "long": "int64", "integer": "int32", "int": "int32",
        "varchar": "string", "double": "float64", "boolean": "bool",
    }
    return names.get(dtype, dtype)


def cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cleaned = [tuple(cell(row[i]) for i in order) for row in found]
    return sorted(cleaned, key=repr)


def differences(spark, con, call, sql: str | None, sf_dir: str) -> list[str]:
    df = call(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    if sql is None:
        return [] if ours else ["no rows"]
    relation = con.sql(sql)
    theirs = rows(relation.columns, relation.fetchall())
    problems = []
    left = {c: kind(t) for c, t in df.dtypes}
    right = {c: kind(t) for c, t in zip(relation.columns, relation.types)}
    if left != right:
        odd = sorted(set(left.items()) ^ set(right.items()))
        problems.append(f"types differ: {odd}")
    if len(ours) != len(theirs):
        problems.append(f"rows: {len(ours)} against {len(theirs)}")
    for mine, other in zip(ours, theirs):
        if mine != other:
            problems.append(f"{mine!r:.400} against {other!r:.400}")
            break
    if not ours:
        problems.append("no rows")
    return problems
