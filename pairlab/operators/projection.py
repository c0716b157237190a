"""Sparse random projection with a matrix defined by a hash.

The draws of a component depend on seed and component alone, so the matrix is the
same on any cluster and in any batch. Only its kept cells are drawn, by the tasks that
need them, and rows are projected batch by batch where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.paths import quoted
from ..shapes import option_name
from .filters import DEFAULT_MAX_FEATURE_BYTES, check_feature_bytes, check_features
from .krr import bounded_batches
from .vectors import FEATURES, Chain, lists_of, matrix_of

MAX_COMPONENTS = 1024
#: Entries that a task keeps; more are drawn anew for every batch.
HELD_ENTRIES = 16_000_000
#: Values of vectors, and of their gathered entries, that a task holds at a time.
BATCH_VALUES = 8_000_000
# A public 64-bit mixing function.
MIX_STEP = 0x9E3779B97F4A7C15
MIX_ROUNDS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
MIX_LAST = 31
#: What sets the draws of different seeds apart.
SEED_STEP = 1_000_003


def default_components(dim: int, components: int | None = None) -> int:
    return int(components) if components else min(MAX_COMPONENTS, max(1, dim))


def _mixed(keys: np.ndarray) -> np.ndarray:
    z = keys + np.uint64(MIX_STEP)
    for shift, factor in MIX_ROUNDS:
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(MIX_LAST))


@dataclass(frozen=True)
class SparseMatrix:
    """A random matrix of features x components of density 1/sqrt(d) with values plus
    or minus sqrt(1/density)/sqrt(k), defined by a hash.

    Only the kept cells are drawn: down each component, a draw says how many features
    are skipped before the next one. Draw ``i`` of component ``c`` is a function of
    (seed, c, i) alone, so every task makes the parts it needs by itself.
    """

    dim: int
    components: int
    seed: int

    @property
    def density(self) -> float:
        return 1.0 / sqrt(self.dim)

    @property
    def size(self) -> float:
        return sqrt(1.0 / self.density) / sqrt(self.components)

    def draws(self) -> int:
        """Draws of a component at a time: seldom too few, and then continued."""
        expected = self.dim * self.density
        return int(expected + 6 * sqrt(expected) + 16)

    def entries(self, first: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Components ``first`` to ``stop``: all features in order, their signs, and
        where each component starts."""
        count, start = self.draws(), np.zeros(stop - first)
        seed = (self.seed * SEED_STEP) % (1 << 32)
        keys = (np.arange(first, stop, dtype=np.uint64) + np.uint64(seed)) << np.uint64(32)
        features, signs, owners, begin = [], [], [], 0
        while True:
            at = np.arange(begin, begin + count, dtype=np.uint64)
            z = _mixed(keys[:, None] + at)
            uniform = ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            if self.density < 1:
                skipped = np.floor(np.log(uniform) / np.log1p(-self.density))
            else:
                skipped = np.zeros(uniform.shape)
            place = np.cumsum(skipped + 1, axis=1) + start[:, None] - 1
            held = place < self.dim
            owner, column = np.nonzero(held)
            features.append(place[owner, column].astype(np.int64))
            signs.append(1.0 - 2.0 * (z[owner, column] & np.uint64(1)))
            owners.append(owner)
            if not held[:, -1].any():
                break
            begin, start = begin + count, place[:, -1] + 1
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(stop - first))
        return np.concatenate(features)[order], np.concatenate(signs)[order], starts

    def chunks(self, rows: int) -> Iterator[tuple[int, int]]:
        """Runs of components whose entries, for so many rows, fit in memory."""
        width = max(1, int(BATCH_VALUES / max(1, rows) / (self.draws() + 1)))
        for first in range(0, self.components, width):
            yield first, min(first + width, self.components)


class Projector:
    """``vectors @ R`` by gathering the kept features of each component."""

    def __init__(self, matrix: SparseMatrix) -> None:
        self.matrix = matrix
        self.keep = matrix.components * matrix.draws() <= HELD_ENTRIES
        self.held: dict[tuple[int, int], tuple] = {}

    def _entries(self, first: int, stop: int) -> tuple:
        if not self.keep:
            return self.matrix.entries(first, stop)
        if (first, stop) not in self.held:
            self.held[first, stop] = self.matrix.entries(first, stop)
        return self.held[first, stop]

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        matrix = self.matrix
        result = np.zeros((len(vectors), matrix.components), np.float32)
        most = max(1, BATCH_VALUES // matrix.dim)
        for at in range(0, len(vectors), most):
            some = vectors[at : at + most].astype(np.float64)
            for first, stop in matrix.chunks(most):
                features, signs, starts = self._entries(first, stop)
                if not len(features):
                    continue
                # A component without entries starts where the next one does.
                filled = np.diff(np.append(starts, len(features))) > 0
                sums = np.zeros((len(some), stop - first))
                sums[:, filled] = np.add.reduceat(
                    some[:, features] * signs, starts[filled], axis=1
                )
                result[at : at + most, first:stop] = sums * matrix.size
        return result


def project_sparse_random(
    df: DataFrame,
    components: int | None = None,
    seed: int = 42,
    features: str = "features",
    dim: int | None = None,
) -> DataFrame:
    """Replace the vectors by their projection; other columns stay. Each task draws
    the matrix, or its parts, from its definition; nothing of it is collected or sent,
    and there is no limit on features or components."""
    if dim is None:
        _, dim = check_features(df, features)
    if dim == 0:
        return df
    matrix = SparseMatrix(dim, default_components(dim, components), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = Projector(matrix)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = batch.schema.get_field_index(features)
            projected = lists_of(
                project(matrix_of(batch.column(at), np.float32)), pa.float32()
            )
            columns = [projected if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    fields = [
        T.StructField(f.name, T.ArrayType(T.FloatType()))
        if f.name == features
        else f
        for f in df.schema.fields
    ]
    # Wide vectors, not their number, fill a worker's memory.
    bounded = bounded_batches(df, max(1, BATCH_VALUES // dim))
    return bounded.mapInArrow(run, T.StructType(fields))


PROJECTIONS = {
    "identity": lambda df, components=None, seed=42, features="features": df,
    "sparse_random": project_sparse_random,
    "sparse_random_projection": project_sparse_random,
}


def project_features(
    df: DataFrame,
    name: str | None = None,
    components: int | None = None,
    seed: int = 42,
    features: str = "features",
) -> DataFrame:
    kind = option_name(name or "identity")
    if kind not in PROJECTIONS:
        raise ValueError(f"No projection named {name!r}")
    return PROJECTIONS[kind](df, components=components, seed=seed, features=features)


@dataclass(frozen=True)
class PreparedFeatures:
    features: DataFrame
    description: DataFrame


def prepare_features(
    df: DataFrame,
    transformations: Sequence[str] | str | None = None,
    params: Mapping[str, Mapping] | None = None,
    projection: str | None = None,
    components: int | None = None,
    seed: int = 42,
    features: str = "features",
    max_bytes: int = DEFAULT_MAX_FEATURE_BYTES,
) -> PreparedFeatures:
    """Transform, then project, with a one-row description of what was done.

    Unprojected features above ``max_bytes`` are refused.
    """
    chain = Chain.read(transformations, params)
    kind = option_name(projection or "identity")
    rows, dim = check_features(df, features)
    if kind == "identity":
        check_feature_bytes(rows, dim, max_bytes)
    column = chain.over(quoted(features)).cast(FEATURES)
    ready = df.withColumn(features, column)
    ready = project_features(ready, kind, components, seed, features)
    output = dim if kind == "identity" else default_components(dim, components)
    described = T.StructType(
        [
            T.StructField("raw_feature_dim", T.IntegerType()),
            T.StructField("transformations", T.ArrayType(T.StringType())),
            T.StructField("transformation_params", T.StringType()),
            T.StructField("transformed_feature_dim", T.IntegerType()),
            T.StructField("projection", T.StringType()),
            T.StructField("projection_dim", T.IntegerType()),
        ]
    )
    row = (dim, [*chain.names], str(dict(chain.params)), dim, kind, output)
    return PreparedFeatures(ready, df.sparkSession.createDataFrame([row], described))
