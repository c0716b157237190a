"""Kernel ridge regression with the linear kernel, fitted on the cluster.

With ``K = X X'`` the dual solution and the Nystrom solution are both linear in
the features, so a fitted model is one weight per feature and a prediction one
dot product. Fitting needs only sums over rows: every task folds its rows into
one matrix, these are added up on the executors, and the driver solves a system
of at most ``MAX_SOLVE`` unknowns. With more features it takes preconditioned steps
of conjugate gradients instead, each a pass over the rows. Nothing of size rows x rows exists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import quoted
from ..session import materialize
from .filters import check_features
from .splits import take_subset
from .vectors import lists_of, matrix_of

# Numerical guards.
CLIP = 1e12
RELATIVE_JITTER = 1e-12
EIGENVALUE_FLOOR = 1e-12
RELATIVE_EIGENVALUE_FLOOR = 1e-10

MAX_SOLVE = 4096
MAX_LANDMARK_BYTES = 1024**3
#: Residual over right side at which conjugate gradients end.
CG_TOLERANCE = 1e-11
#: Steps scaled by feature alone before the system is sketched; directions of the
#: sketch, and bytes it may take on the driver.
PLAIN_STEPS, SKETCH, SKETCH_BYTES = 6, 64, 256 * 1024**2
#: Directions beyond the rank that a block holds, and most passes that turn it.
OVERSAMPLED, MAX_TURNS = 10, 60
#: Features of one Arrow batch in a pass over wide vectors.
BATCH_BYTES = 64 * 1024**2
#: A wide row is written by its cells other than zero where at most one in so many is.
SPARSE = 8


@dataclass(frozen=True)
class LinearKernelModel:
    """``weights`` has one row per feature and one column per target."""

    method: str
    weights: np.ndarray
    ridge_lambda: float
    details: dict = field(default_factory=dict)

    def predict(
        self,
        df: DataFrame,
        features: str = "features",
        names: Sequence[str] = ("predicted_score_delta",),
        keep: Sequence[str] | None = None,
    ) -> DataFrame:
        """Append one prediction column per target. Of the other columns only ``keep``
        stay, where it is given: wide vectors needn't come back from Python."""
        return multiply(df, self.weights, features, names, keep)


def tame(matrix: np.ndarray) -> np.ndarray:
    """Non-finite entries become 0 or plus or minus 1e12."""
    if np.isfinite(matrix).all():
        return matrix
    return np.nan_to_num(matrix, nan=0.0, posinf=CLIP, neginf=-CLIP)


def _solve(system: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    try:
        return tame(np.linalg.solve(system, rhs))
    except np.linalg.LinAlgError:
        return tame(np.linalg.lstsq(system, rhs, rcond=None)[0])


def multiply(
    df: DataFrame,
    weights: np.ndarray,
    features: str,
    names: Sequence[str],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append ``features @ weights``, one column per name, batch by batch, to all
    columns or to those of ``keep``."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float64))
    if keep is not None:
        held = [features, *[c for c in keep if c != features]]
        df = df.select(*[quoted(c) for c in held])
    kept = df.columns if keep is None else list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = batch.schema.get_field_index(features)
            with np.errstate(all="ignore"):
                values = tame(tame(matrix_of(batch.column(at))) @ shared.value)
            if keep is None:
                columns, own = batch.columns, batch.schema.names
            else:
                columns, own = [batch.column(c) for c in kept], kept
            columns = [*columns, *[pa.array(v) for v in values.T]]
            yield pa.RecordBatch.from_arrays(columns, [*own, *names])

    fields = [T.StructField(name, T.DoubleType()) for name in names]
    old = df.schema.fields if keep is None else [df.schema[c] for c in kept]
    return df.mapInArrow(run, T.StructType([*old, *fields]))


def linear_kernel(
    df: DataFrame, landmarks: np.ndarray, features: str = "features"
) -> DataFrame:
    """Append ``kernel``: the dot products with the landmarks as one array per
    row. The landmark matrix is small and checked, rows stay where they are."""
    _check_landmarks(len(landmarks), landmarks.shape[1])
    shared = df.sparkSession.sparkContext.broadcast(
        np.asarray(landmarks, np.float64).T
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = batch.schema.get_field_index(features)
            with np.errstate(all="ignore"):
                kernel = tame(matrix_of(batch.column(at)) @ shared.value)
            columns = [*batch.columns, lists_of(kernel, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "kernel"])

    kernel = T.StructField("kernel", T.ArrayType(T.DoubleType()))
    return df.mapInArrow(run, T.StructType([*df.schema.fields, kernel]))


def _sum_rows(partials: DataFrame) -> dict[int, np.ndarray]:
    """Add up array rows (i, v) per i on the executors; the caller has checked
    how many there are."""
    summed = partials.groupBy("i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")
    )
    return {row["i"]: np.asarray(row["v"]) for row in summed.toLocalIterator()}


PARTIAL = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("v", T.ArrayType(T.DoubleType())),
    ]
)


def _partial_rows(*blocks: tuple[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for start, matrix in blocks:
        index = pa.array(np.arange(start, start + len(matrix), dtype=np.int32))
        values = lists_of(matrix, pa.float64())
        yield pa.RecordBatch.from_arrays([index, values], ["i", "v"])


@dataclass(frozen=True)
class NormalEquations:
    """Sums over rows: ``gram`` = X'X, ``moments`` = X'Y, the row count and the
    sum of squared lengths."""

    gram: np.ndarray
    moments: np.ndarray
    rows: int
    squares: float


def normal_equations(
    df: DataFrame,
    targets: Sequence[str],
    features: str = "features",
    basis: np.ndarray | None = None,
) -> NormalEquations:
    """Fold all rows into X'X and X'Y, of ``features`` or of ``features @ basis``.
    Non-finite values are tamed row by row, so that one doesn't spoil the sums."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(basis)
    count = len(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        rows = squares = 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = tame(matrix_of(batch.column(0)))
            if shared.value is not None:
                x = tame(x @ shared.value)
            part = x.T @ np.hstack([x, _columns(batch.columns[1:])])
            total = part if total is None else total + part
            rows += len(x)
            squares += float((x * x).sum())
        if total is not None:
            yield from _partial_rows((0, total), (-1, np.array([[rows, squares]])))

    columns = [quoted(t).cast("double").alias(f"y{n}") for n, t in enumerate(targets)]
    slim = df.select(quoted(features).alias("x"), *columns)
    # A task's sums don't shrink with its rows: tasks follow cores, not splits.
    cores = spark.sparkContext.defaultParallelism
    sums = _sum_rows(slim.coalesce(cores).mapInArrow(run, PARTIAL))
    if -1 not in sums:
        raise ValueError("No rows to fit.")
    rows, squares = sums.pop(-1)
    table = np.vstack([sums[i] for i in sorted(sums)])
    dim = table.shape[1] - count
    return NormalEquations(table[:, :dim], table[:, dim:], round(rows), float(squares))


def fit_dual(
    df: DataFrame,
    targets: Sequence[str] = ("score_delta",),
    ridge_lambda: float = 0.01,
    features: str = "features",
    key: Sequence[str] = ("pair_id",),
) -> LinearKernelModel:
    """Ridge on the full kernel, for any number of rows and features.

    The dual solution equals the ridge system over features. Up to ``MAX_SOLVE``
    features that system is folded in one pass and solved; beyond, conjugate
    gradients solve it with one pass of X'(Xw) over the written rows per step, so
    that neither X'X nor XX' is ever held; rows of mostly zeros are written, and
    multiplied, by their other cells. Both give the solution to within
    ``CG_TOLERANCE``. Non-finite features and targets are tamed row by row first.
    """
    _, dim = check_features(df, features)
    if dim <= MAX_SOLVE:
        sums = normal_equations(df, targets, features)
        system = sums.gram + _ridge(sums.rows, sums.squares, ridge_lambda) * np.eye(dim)
        weights, rows = _solve(system, sums.moments), sums.rows
        details = {"rows": rows}
    else:
        weights, details = _conjugate_gradients(df, targets, features, ridge_lambda, dim)
    return LinearKernelModel("dual", weights, ridge_lambda, details)


def _ridge(rows: int, squares: float, ridge_lambda: float) -> float:
    penalty = rows * ridge_lambda
    return penalty + RELATIVE_JITTER * max(squares / max(rows, 1) + penalty, 1.0)


def _packed(df: DataFrame, dim: int) -> DataFrame:
    """Vectors ``x`` written once, with the other columns, for any number of passes:
    rows of mostly zeros as their other cells and the places ``at`` of these, the rest
    as they are, without ``at``."""
    x = df.schema["x"].dataType.elementType
    x = x if isinstance(x, T.FloatType) else T.DoubleType()
    kind = np.float32 if isinstance(x, T.FloatType) else np.float64
    others = [c for c in df.columns if c != "x"]
    types = pa.list_(pa.from_numpy_dtype(kind)), pa.list_(pa.int32())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cells = matrix_of(batch.column("x"), kind)
            flat = np.flatnonzero(cells.ravel() != 0)
            rows, at = np.divmod(flat, dim)
            sizes = np.bincount(rows, minlength=len(cells))
            full = sizes * SPARSE > dim
            if full.any():
                own = [batch.column(c).filter(pa.array(full)) for c in others]
                none = pa.nulls(int(full.sum()), types[1])
                whole = lists_of(cells[full], types[0].value_type)
                yield pa.RecordBatch.from_arrays(
                    [whole, none, *own], ["x", "at", *others]
                )
            if not full.all():
                inside = ~full[rows]
                ends = np.cumsum(np.append(0, sizes[~full])).astype(np.int32)
                values = pa.array(cells.ravel()[flat[inside]], types[0].value_type)
                places = pa.array(at[inside].astype(np.int32))
                own = [batch.column(c).filter(pa.array(~full)) for c in others]
                lists = [pa.ListArray.from_arrays(ends, v) for v in (values, places)]
                yield pa.RecordBatch.from_arrays(
                    [*lists, *own], ["x", "at", *others]
                )

    fields = [
        T.StructField("x", T.ArrayType(x)),
        T.StructField("at", T.ArrayType(T.IntegerType())),
        *[df.schema[c] for c in others],
    ]
    df = bounded_batches(df, max(1, BATCH_BYTES // (8 * dim)))
    return materialize(df.mapInArrow(work, T.StructType(fields)))


@dataclass(frozen=True)
class _Cells:
    """Rows of a matrix by their cells other than zero."""

    values: np.ndarray
    rows: np.ndarray
    places: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def read(cls, batch: pa.RecordBatch, dim: int) -> _Cells:
        sizes = pc.list_value_length(batch.column("at")).to_numpy()
        values = batch.column("x").flatten().to_numpy().astype(np.float64)
        places = batch.column("at").flatten().to_numpy()
        rows = np.repeat(np.arange(len(sizes)), sizes)
        return cls(tame(values), rows, places, (len(sizes), dim))

    def _summed(self, by: np.ndarray, of: np.ndarray, size: int, m: np.ndarray):
        sums = [np.bincount(by, self.values * c[of], size) for c in m.T]
        return np.column_stack(sums)

    def times(self, right: np.ndarray) -> np.ndarray:
        return self._summed(self.rows, self.places, self.shape[0], right)

    def turned_times(self, right: np.ndarray) -> np.ndarray:
        return self._summed(self.places, self.rows, self.shape[1], right)

    def squares(self) -> np.ndarray:
        return np.bincount(self.places, self.values**2, self.shape[1])


@dataclass(frozen=True)
class _Whole:
    """The same of rows with all their cells."""

    x: np.ndarray

    def times(self, right: np.ndarray) -> np.ndarray:
        return self.x @ right

    def turned_times(self, right: np.ndarray) -> np.ndarray:
        return self.x.T @ right

    def squares(self) -> np.ndarray:
        return (self.x * self.x).sum(axis=0)


def _blocks(
    batch: pa.RecordBatch, dim: int
) -> Iterator[tuple[_Cells | _Whole, pa.RecordBatch]]:
    full = pc.is_null(batch.column("at"))
    for sparse, mask in ((False, full), (True, pc.invert(full))):
        some = batch.filter(mask)
        if some.num_rows and sparse:
            yield _Cells.read(some, dim), some
        elif some.num_rows:
            yield _Whole(tame(matrix_of(some.column("x")))), some


def _passes(
    df: DataFrame, count: int, dim: int, weights: np.ndarray | None
) -> tuple[np.ndarray, int, float]:
    """X'(X w) for all columns of ``weights`` in one pass over rows from
    :func:`_packed`; without weights X'y and, as a last column, the features' sums of
    squares. Also the row count and the sum of all squares. Each task gives a matrix
    of features x columns."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, count))
        rows = squares = 0.0
        for batch in batches:
            for x, some in _blocks(batch, dim):
                if shared.value is None:
                    own = x.squares()
                    total[:, :-1] += x.turned_times(_columns(some.columns[2:]))
                    total[:, -1] += own
                    squares += float(own.sum())
                else:
                    total += x.turned_times(x.times(shared.value))
                rows += some.num_rows
        if rows:
            yield from _partial_rows((0, total.T), (-1, np.array([[rows, squares]])))

    # A task's sums are as large as one row: tasks follow cores, not splits.
    cores = df.sparkSession.sparkContext.defaultParallelism
    sums = _sum_rows(df.coalesce(cores).mapInArrow(run, PARTIAL))
    if -1 not in sums:
        raise ValueError("No rows to fit.")
    rows, squares = sums.pop(-1)
    return np.vstack([sums[i] for i in range(count)]).T, round(rows), float(squares)


@dataclass(frozen=True)
class _Preconditioner:
    """An approximate inverse: each feature by its own scale, and, where ``basis`` is
    given, the leading directions of the scaled system by their eigenvalues."""

    scale: np.ndarray
    basis: np.ndarray | None = None
    shares: np.ndarray | None = None

    def __call__(self, residual: np.ndarray) -> np.ndarray:
        scaled = self.scale * residual
        if self.basis is not None:
            inside = self.basis.T @ scaled
            scaled = scaled - self.basis @ ((1 - self.shares)[:, None] * inside)
        return self.scale * scaled


def _sketched(
    rows: DataFrame, dim: int, scale: np.ndarray, ridge: float
) -> _Preconditioner:
    """A randomized Nystrom approximation of the scaled X'X from one pass over a block
    of random directions, with the usual shift against rounding."""
    size = max(1, min(SKETCH, dim, SKETCH_BYTES // (8 * dim)))
    random = np.random.default_rng(dim).normal(size=(dim, size))
    tests = np.linalg.qr(random)[0]
    image = scale * _passes(rows, size, dim, scale * tests)[0]
    shift = np.finfo(float).eps * np.linalg.norm(image) * np.sqrt(dim)
    image += shift * tests
    core = tests.T @ image
    root = np.linalg.cholesky(0.5 * (core + core.T) + shift * np.eye(size))
    basis, values, _ = np.linalg.svd(
        np.linalg.solve(root, image.T).T, full_matrices=False
    )
    values = np.maximum(values**2 - shift, 0.0)
    floor = float(np.median(ridge * scale**2))
    return _Preconditioner(scale, basis, (values[-1] + floor) / (values + floor))


def _conjugate_gradients(
    df: DataFrame,
    targets: Sequence[str],
    features: str,
    ridge_lambda: float,
    dim: int,
) -> tuple[np.ndarray, dict]:
    """All targets at once, a pass over the written rows for each step.

    Steps are scaled by feature first; a system that doesn't yield to that soon is
    sketched once and goes on with its leading directions known. Whenever the steps'
    own residual says they are done, b - Ax is computed anew: only that one counts.
    """
    columns = [quoted(t).cast("double").alias(f"y{n}") for n, t in enumerate(targets)]
    stored = _packed(df.select(quoted(features).alias("x"), *columns), dim)
    count = len(targets)
    sums, rows, squares = _passes(stored, count + 1, dim, None)
    rhs, own = sums[:, :-1], sums[:, -1:]
    ridge = _ridge(rows, squares, ridge_lambda)

    def image_of(some: np.ndarray) -> np.ndarray:
        return _passes(stored, some.shape[1], dim, some)[0] + ridge * some

    scale = 1 / np.sqrt(own + ridge)
    inverse = _Preconditioner(scale)
    least = CG_TOLERANCE * np.maximum(np.linalg.norm(rhs, axis=0), 1e-300)
    weights, residual, steps = np.zeros((dim, count)), rhs.copy(), 0
    most = min(dim, rows) + 50
    while (np.linalg.norm(residual, axis=0) > least).any() and steps < most:
        if steps >= PLAIN_STEPS and inverse.basis is None:
            inverse = _sketched(stored, dim, scale, ridge)
        toward = inverse(residual)
        direction, norm = toward.copy(), (residual * toward).sum(axis=0)
        until = most if inverse.basis is not None else max(PLAIN_STEPS, steps + 1)
        while steps < until and (np.linalg.norm(residual, axis=0) > least).any():
            image = image_of(direction)
            curve = (direction * image).sum(axis=0)
            pace = np.where(curve > 0, norm / np.where(curve > 0, curve, 1.0), 0.0)
            weights = weights + pace * direction
            residual = residual - pace * image
            toward = inverse(residual)
            after = (residual * toward).sum(axis=0)
            direction = toward + direction * (after / np.maximum(norm, 1e-300))
            norm, steps = after, steps + 1
        residual = rhs - image_of(weights)
    left = float((np.linalg.norm(residual, axis=0) / (least / CG_TOLERANCE)).max())
    return tame(weights), {
        "rows": rows,
        "steps": steps,
        "residual": left,
        "sketched": inverse.basis is not None,
    }


def bounded_batches(df: DataFrame, rows: int) -> DataFrame:
    """Let Arrow batches of this session hold at most ``rows`` rows from now on:
    wide vectors, not their number, fill a worker's memory."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def _columns(columns: Sequence[pa.Array]) -> np.ndarray:
    return tame(np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]))


def _check_landmarks(count: int, dim: int) -> None:
    if count * dim * 8 > MAX_LANDMARK_BYTES:
        raise ValueError(
            f"{count} landmarks of {dim} features exceed "
            f"{MAX_LANDMARK_BYTES / 1024**3:.1f} GiB. Use fewer or project."
        )


def select_landmarks(
    df: DataFrame, count: int, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """Seeded landmark rows; the count must lie between 1 and the row count."""
    rows = df.count()
    if not 1 <= count <= rows:
        raise ValueError(
            f"Cannot take {count} landmarks from {rows} rows."
        )
    return take_subset(df, count, key, seed)


def collect_landmarks(
    landmarks: DataFrame,
    key: Sequence[str],
    features: str = "features",
    shape: tuple[int, int] | None = None,
) -> np.ndarray:
    """Landmark vectors as a matrix in key order, behind a size check; ``shape``
    spares the check's pass where rows and dimension are known."""
    rows, dim = shape or check_features(landmarks, features)
    _check_landmarks(rows, dim)
    ordered = landmarks.orderBy(*key).select(features).toArrow()
    return matrix_of(ordered[features])


def nystrom_basis(landmarks: np.ndarray, rank: int | None = None) -> np.ndarray:
    """Features-to-components matrix: landmark kernel, its leading eigenvectors
    scaled by the inverse root of the (floored) eigenvalues."""
    count = len(landmarks)
    rank = max(1, min(count if rank is None else int(rank), count))
    kernel = tame(landmarks @ landmarks.T)
    values, vectors = np.linalg.eigh(0.5 * (kernel + kernel.T))
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    largest = max(float(values.max()), 1.0)
    floor = max(EIGENVALUE_FLOOR, RELATIVE_EIGENVALUE_FLOOR * largest)
    return landmarks.T @ (vectors / np.sqrt(np.maximum(values, floor)))


def _scaled_components(
    values: np.ndarray, vectors: np.ndarray, rank: int
) -> np.ndarray:
    """Leading eigenvectors of Z'Z, scaled as :func:`nystrom_basis` scales them: with
    eigenvalues at or above the floor they are the same components."""
    values = np.maximum(values[::-1][:rank], 0.0)
    vectors = vectors[:, ::-1][:, :rank]
    largest = max(float(values.max()), 1.0)
    floor = max(EIGENVALUE_FLOOR, RELATIVE_EIGENVALUE_FLOOR * largest)
    return vectors * np.sqrt(values / np.maximum(values, floor))


def nystrom_basis_of_rows(
    landmarks: DataFrame, dim: int, rank: int, features: str = "features"
) -> np.ndarray:
    """The same basis for any number of landmarks, which stay where they are.

    The kernel is linear: the eigenvectors of ZZ', taken through Z', are those of Z'Z.
    Up to ``MAX_SOLVE`` features that matrix is folded in one pass. Beyond, passes of
    Z'(ZQ) over the landmarks turn a block of random directions to the leading ones,
    until their eigenvalues stand; the driver holds features x rank.
    """
    points = landmarks.select(quoted(features).alias("x"))
    if dim <= MAX_SOLVE:
        ones = materialize(points).select("x", F.lit(0.0).alias("none"))
        gram = normal_equations(ones, ["none"], "x").gram
        return _scaled_components(*np.linalg.eigh(0.5 * (gram + gram.T)), rank)
    if rank > MAX_SOLVE:
        raise ValueError(f"At most {MAX_SOLVE} components, got {rank}; use dual.")
    stored = _packed(points, dim)
    size = min(dim, rank + OVERSAMPLED)
    random = np.random.default_rng(dim).normal(size=(dim, size))
    block, before = np.linalg.qr(random)[0], None
    for _ in range(MAX_TURNS):
        image = _passes(stored, size, dim, block)[0]
        inner = block.T @ image
        values, turns = np.linalg.eigh(0.5 * (inner + inner.T))
        leading = values[::-1][:rank]
        if before is not None and np.allclose(leading, before, rtol=1e-12, atol=1e-12):
            break
        before, block = leading, np.linalg.qr(image @ turns)[0]
    return _scaled_components(values, block @ turns, rank)


def fit_nystrom(
    df: DataFrame,
    targets: Sequence[str] = ("score_delta",),
    ridge_lambda: float = 0.01,
    num_landmarks: int = 32,
    rank: int | None = 32,
    features: str = "features",
    key: Sequence[str] = ("pair_id",),
    seed: int = 42,
    landmarks: DataFrame | None = None,
) -> LinearKernelModel:
    """Ridge on the Nystrom components; landmark count and rank are cut down to
    what the data allows. Few landmarks are solved on the driver, more stay where they
    are, see :func:`nystrom_basis_of_rows`."""
    shape = None
    if landmarks is None:
        rows, dim = check_features(df, features)
        shape = (min(int(num_landmarks), rows), dim)
        if shape[0] < 1:
            raise ValueError("No rows to take landmarks from.")
        landmarks = take_subset(df, shape[0], key, seed)
    else:
        shape = check_features(landmarks, features)
    count, dim = shape
    if count <= MAX_SOLVE and count * dim * 8 <= MAX_LANDMARK_BYTES:
        points = tame(collect_landmarks(landmarks, key, features, shape))
        basis = nystrom_basis(points, rank)
    else:
        most = min(count, dim)
        wanted = most if rank is None else max(1, min(int(rank), most))
        basis = nystrom_basis_of_rows(landmarks, dim, wanted, features)
    sums = normal_equations(df, targets, features, basis)
    components = basis.shape[1]
    system = sums.gram + sums.rows * ridge_lambda * np.eye(components)
    jitter = RELATIVE_JITTER * max(float(np.trace(system)) / components, 1.0)
    beta = _solve(system + jitter * np.eye(components), sums.moments)
    details = {
        "rows": sums.rows,
        "rank": components,
        "num_landmarks": count,
    }
    return LinearKernelModel("nystrom", basis @ beta, ridge_lambda, details)


def fit(df: DataFrame, method: str, **options) -> LinearKernelModel:
    kind = method.lower()
    if kind == "dual":
        return fit_dual(df, **options)
    if kind == "nystrom":
        return fit_nystrom(df, **options)
    raise ValueError(f"No kernel method {method!r}; use dual or nystrom")
