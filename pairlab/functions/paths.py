"""Dotted paths resolved against a schema at plan time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import finite

_INTEGER = re.compile(r"\s*[+-]?\d+\s*")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _variant_step(segment: str) -> str:
    return "['" + segment.replace("'", "\\'") + "']"


def resolve(df: DataFrame, path: str) -> tuple[Column, T.DataType | None]:
    """Column and type behind ``path``; ``(null, None)`` where the schema has
    no such place.

    Structs and maps are read by name, arrays by zero-based integer (negative
    counts from the end), VARIANT values by either.
    """
    head, *rest = path.split(".")
    if head not in df.columns:
        return F.lit(None), None
    return walk(quoted(head), df.schema[head].dataType, rest)


def walk(
    col: Column, dtype: T.DataType, segments: list[str]
) -> tuple[Column, T.DataType | None]:
    for at, segment in enumerate(segments):
        if isinstance(dtype, T.StructType):
            if segment not in dtype.fieldNames():
                return F.lit(None), None
            col, dtype = col.getField(segment), dtype[segment].dataType
        elif isinstance(dtype, T.MapType):
            if not isinstance(dtype.keyType, T.StringType):
                return F.lit(None), None
            col = F.try_element_at(col, F.lit(segment))
            dtype = dtype.valueType
        elif isinstance(dtype, T.ArrayType):
            if not _INTEGER.fullmatch(segment):
                return F.lit(None), None
            index = int(segment)
            position = index + 1 if index >= 0 else index
            col = F.try_element_at(col, F.lit(position))
            dtype = dtype.elementType
        elif isinstance(dtype, T.VariantType):
            return _walk_variant(col, segments[at:]), dtype
        else:
            return F.lit(None), None
    return col, dtype


def _walk_variant(col: Column, segments: list[str]) -> Column:
    for segment in segments:
        found = F.try_variant_get(col, "$" + _variant_step(segment), "variant")
        if segment.isdigit():
            item = F.try_variant_get(col, f"$[{int(segment)}]", "variant")
            found = F.coalesce(found, item)
        col = found
    return col


def nested_number(df: DataFrame, path: str) -> Column:
    """Finite double behind ``path`` or null."""
    col, dtype = resolve(df, path)
    if dtype is None or isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(None).cast("double")
    if isinstance(dtype, T.VariantType):
        col = F.try_variant_get(col, "$", "double")
    return finite(col)


def nested_text(df: DataFrame, path: str) -> Column:
    """Scalar behind ``path`` as string, null where absent."""
    col, dtype = resolve(df, path)
    if dtype is None or isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(None).cast("string")
    if isinstance(dtype, T.VariantType):
        return F.try_variant_get(col, "$", "string")
    return col.cast("string")
