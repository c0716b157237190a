"""Feature vectors: element-wise transformations and assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shapes import Shape, Value, option_name, option_names, problems

DEFAULT_THRESHOLD = 0.01
FEATURES = "array<float>"


def sign(features: Column) -> Column:
    return F.transform(features, lambda x: F.signum(x)).cast(FEATURES)


def thresholded_sign(
    features: Column, threshold: float = DEFAULT_THRESHOLD
) -> Column:
    """1 above the threshold, -1 below its negative, else 0 (also for NaN)."""
    threshold = float(threshold)
    if threshold < 0:
        raise ValueError("A sign threshold cannot be negative")

    def step(x: Column) -> Column:
        above = (x > threshold) & ~F.isnan(x)
        return F.when(above, 1.0).when(x < -threshold, -1.0).otherwise(0.0)

    return F.transform(features, step).cast(FEATURES)


@dataclass(frozen=True)
class Step:
    """What a named transformation does to a column, what its parameters must be, and
    how a chain's label shows it (``None``: not at all)."""

    make: Callable[..., Column]
    params: Shape = Shape({})
    label: str | None = "{name}"
    detail: str = ""


_THRESHOLD = Value(lambda x: float(x) >= 0, "a threshold cannot be negative: {value}")
# The names and what a label shows of them.
STEPS: dict[str, Step] = {
    "identity": Step(lambda features: features, label=None),
    "sign": Step(sign),
    "thresholded_sign": Step(
        thresholded_sign,
        Shape({"threshold": _THRESHOLD}),
        detail="(threshold={threshold})",
    ),
}


@dataclass(frozen=True)
class Chain:
    """Transformations in their order, and the parameters given for any of them."""

    names: tuple[str, ...]
    params: Mapping[str, Mapping]

    @classmethod
    def read(
        cls,
        names: Iterable[str] | str | None = None,
        params: Mapping[str, Mapping] | None = None,
        threshold: float | None = None,
    ) -> Chain:
        """A chain as options spell it: names in a comma list or a list, parameters by
        name. ``threshold`` stands for the parameter of that name where it isn't
        given."""
        own = {option_name(name): dict(value) for name, value in (params or {}).items()}
        if threshold is not None:
            short = {"threshold": threshold}
            own["thresholded_sign"] = short | own.get("thresholded_sign", {})
        return cls(option_names(names) or ("identity",), own)

    def over(self, features: Column) -> Column:
        """The whole chain as one expression."""
        known = {name: Value(shape=step.params) for name, step in STEPS.items()}
        for name in self.names:
            if name not in known:
                raise ValueError(f"No transformation named {name!r}")
            given = self.params.get(name, {})
            if wrong := list(problems(given, known[name], f"transformation_params.{name}")):
                raise ValueError("; ".join(wrong))
            features = STEPS[name].make(features, **given)
        return features

    @property
    def label(self) -> str:
        """``raw`` or the active names joined by ``+``, thresholds shown."""
        shown = []
        for name in self.names:
            step = STEPS.get(name, Step(sign))
            if step.label is not None:
                given = self.params.get(name, {})
                held = all(v is not None for v in given.values()) and given
                detail = step.detail.format(**given) if held else ""
                shown.append(step.label.format(name=name) + detail)
        return "+".join(shown) or "raw"


def assemble_features(
    leaves: DataFrame, selection: str = "lora_b_only", suffix: str = "lora_b"
) -> DataFrame:
    """One vector per pair from rows (pair_id, leaf_order, leaf_name, values).

    ``lora_b_only`` keeps the leaves whose name ends in ``suffix``, ``all`` keeps
    every leaf. A pair none of whose leaves is kept is an error. A group holds
    one pair's leaves, as many as the model has.
    """
    if selection not in ("all", "lora_b_only"):
        raise ValueError(f"Unknown leaf filter: {selection}")
    kept = F.lit(True) if selection == "all" else F.col("leaf_name").endswith(suffix)
    picked = F.collect_list(F.when(kept, F.struct("leaf_order", "values")))
    values = F.flatten(F.transform(F.array_sort(picked), lambda leaf: leaf["values"]))
    nothing = F.raise_error(
        F.concat(F.lit("No leaf of this pair is kept: "), F.col("pair_id").cast("string"))
    )
    grouped = leaves.groupBy("pair_id").agg(values.alias("features"))
    return grouped.select(
        "pair_id",
        F.when(F.size("features") > 0, F.col("features"))
        .otherwise(nothing)
        .alias("features"),
    )


def matrix_of(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A batch of equally long lists as a 2-D array without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0), dtype=dtype)
    sizes = pc.min_max(pc.list_value_length(column)).as_py()
    if column.null_count or sizes["min"] != sizes["max"]:
        raise ValueError(f"Inconsistent feature dimensions: {sizes}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), sizes["min"]).astype(dtype, copy=False)


def lists_of(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a 2-D array as list values."""
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim, pa.int32())
    flat = pa.array(np.ascontiguousarray(matrix).reshape(-1), type=kind)
    return pa.ListArray.from_arrays(offsets, flat)


def dot(left: Column, right: Column) -> Column:
    """Dot product of two array columns in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


