"""Representative subsets: k-means, nearest rows, and pluggable selectors."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .filters import DEFAULT_MAX_FEATURE_BYTES, check_feature_bytes, check_features
from .joins import join_same
from .krr import PARTIAL, _partial_rows, _sum_rows, bounded_batches
from .projection import prepare_features
from .splits import take_subset
from .vectors import matrix_of

MAX_CENTRE_BYTES = 1024**3
CHUNK_VALUES = 4_000_000
#: Rows that starting centres are drawn from, at least.
SAMPLE_ROWS = 2_000
#: Rows that are compared with a band of centres together, and centres on either side
#: of their length that give the first distances.
GROUP_ROWS, GUESSED = 512, 4


def _check_centres(count: int, dim: int) -> None:
    if count * dim * 8 > MAX_CENTRE_BYTES:
        raise ValueError(
            f"{count} centres of {dim} features exceed "
            f"{MAX_CENTRE_BYTES / 1024**3:.1f} GiB. Select fewer or project."
        )


def starting_centres(
    sample: np.ndarray, count: int, seed: int, runs: int
) -> np.ndarray:
    """For each run ``count`` rows of the sample, each drawn with a chance that grows
    with the squared distance to those drawn before."""
    made = np.empty((runs, count, sample.shape[1]))
    for run in range(runs):
        random = np.random.default_rng([seed, run])
        made[run, 0] = sample[random.integers(len(sample))]
        near = np.full(len(sample), np.inf)
        for k in range(1, count):
            near = np.minimum(near, _distances(sample, made[run, k - 1 : k])[:, 0])
            total = float(near.sum())
            chances = near / total if total > 0 else None
            made[run, k] = sample[random.choice(len(sample), p=chances)]
    return made


class _Assigner:
    """Nearest centres of all runs. Rows and centres are ordered by their lengths; two
    lengths that differ by more than a distance already found put a centre out of
    question, so that a group of rows meets only the centres of a band."""

    def __init__(self, centres: np.ndarray) -> None:
        self.runs = []
        for own in centres:
            lengths = np.sqrt((own * own).sum(axis=1))
            order = np.argsort(lengths, kind="stable")
            self.runs.append((own[order], lengths[order], order))

    def __call__(self, x: np.ndarray, lengths: np.ndarray, run: int):
        """Centre and squared distance of each row of a group of similar length."""
        centres, norms, order = self.runs[run]
        middle = int(np.searchsorted(norms, lengths[len(lengths) // 2]))
        first = slice(max(0, middle - GUESSED), min(len(norms), middle + GUESSED))
        reach = np.sqrt(_distances(x, centres[first]).min(axis=1))
        # A margin for what rounding takes from the guesses.
        low = float((lengths - reach).min()) - 1e-9 * (1 + float(lengths.max()))
        high = float((lengths + reach).max()) + 1e-9 * (1 + float(lengths.max()))
        band = slice(*np.searchsorted(norms, (low, high), side="left"))
        band = slice(min(band.start, first.start), max(band.stop, first.stop))
        found = _distances(x, centres[band])
        best = found.argmin(axis=1)
        return order[band][best], found[np.arange(len(x)), best]


def _updated(
    df: DataFrame, centres: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """One pass for all runs: the mean of each centre's rows (the centre itself where
    it has none), and the cost of the centres given."""
    runs, count, dim = centres.shape
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _Assigner(shared.value)
        total = np.zeros((runs * count, dim + 2))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix_of(batch.column(0))
            lengths = np.sqrt((x * x).sum(axis=1))
            order = np.argsort(lengths, kind="stable")
            for at in range(0, len(x), GROUP_ROWS):
                some = order[at : at + GROUP_ROWS]
                rows = x[some]
                for k in range(runs):
                    near, distances = assign(rows, lengths[some], k)
                    own = np.hstack([rows, np.ones((len(rows), 1)), distances[:, None]])
                    np.add.at(total, near + k * count, own)
        yield from _partial_rows((0, total))

    cores = df.sparkSession.sparkContext.defaultParallelism
    sums = _sum_rows(df.coalesce(cores).mapInArrow(run, PARTIAL))
    if not sums:
        raise ValueError("No rows to cluster.")
    total = np.vstack([sums[i] for i in range(runs * count)])
    total = total.reshape(runs, count, dim + 2)
    sizes = total[:, :, dim : dim + 1]
    means = np.where(sizes > 0, total[:, :, :dim] / np.maximum(sizes, 1), centres)
    return means, total[:, :, dim + 1].sum(axis=1)


def lloyd(
    df: DataFrame,
    starts: np.ndarray,
    max_iter: int = 300,
    tol: float = 1e-4,
    features: str = "features",
) -> tuple[np.ndarray, np.ndarray]:
    """Centres of several runs (runs x centres x features) after Lloyd's steps from
    ``starts``, and the cost of the centres before the last step. Each pass over the
    rows moves all runs; a run whose centres all move by less than ``tol`` is done."""
    rows = df.select(F.col(features).alias("x"))
    dim = starts.shape[2]
    rows = bounded_batches(rows, max(1, CHUNK_VALUES // dim))
    centres, costs = starts.astype(np.float64).copy(), np.full(len(starts), np.inf)
    moving, steps = np.arange(len(starts)), 0
    while len(moving) and steps < max_iter:
        after, costs[moving] = _updated(rows, centres[moving])
        moved = np.sqrt(((after - centres[moving]) ** 2).sum(axis=2)).max(axis=1)
        centres[moving] = after
        moving, steps = moving[moved > tol], steps + 1
    return centres, costs


def kmeans_centres(
    df: DataFrame,
    count: int,
    seed: int = 42,
    n_init: int = 10,
    max_iter: int = 300,
    features: str = "features",
) -> np.ndarray:
    """Centres of the best of ``n_init`` runs. The runs start from a sample of a
    bounded size, taken by a hash, and go through all rows together, as many at a time
    as the bound on centres allows."""
    stored = materialize(df.select(F.col(features).alias("features")))
    size, dim = check_features(stored, "features")
    size = min(size, max(SAMPLE_ROWS, 4 * count), MAX_CENTRE_BYTES // (8 * dim))
    sample = take_subset(stored, max(size, count), ["features"], seed)
    points = matrix_of(sample.orderBy("features").toArrow()["features"])
    together = max(1, MAX_CENTRE_BYTES // (8 * count * dim))
    best = None
    for first in range(0, n_init, together):
        some = min(together, n_init - first)
        starts = starting_centres(points, count, seed + first, some)
        centres, costs = lloyd(stored, starts, max_iter)
        k = int(costs.argmin())
        if best is None or costs[k] < best[0]:
            best = (costs[k], centres[k])
    return best[1]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of a few rows to every centre."""
    cross = x @ centres.T
    squares = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :]
    return np.maximum(squares - 2.0 * cross, 0.0)


def nearest_rows(
    df: DataFrame,
    centres: np.ndarray,
    row_id: str = "row_id",
    features: str = "features",
) -> DataFrame:
    """The row nearest to each centre: (centre, row_id, distance), distance
    squared, ties to the smaller id.

    Each task keeps one candidate per centre, so what is shuffled is centres
    times tasks whatever the row count.
    """
    _check_centres(*centres.shape)
    shared = df.sparkSession.sparkContext.broadcast(centres)
    kind = df.schema[row_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        best: list[tuple | None] = [None] * len(points)
        least = np.full(len(points), np.inf)
        for batch in batches:
            ids = batch.column(0)
            x = matrix_of(batch.column(1))
            step = max(1, CHUNK_VALUES // len(points))
            for start in range(0, len(x), step):
                part = x[start : start + step]
                near = _distances(part, points)
                # Rounding of the fast form must not decide a tie: all rows within
                # it of a centre's least distance are measured exactly.
                slack = 1e-9 * (1.0 + (part * part).sum(axis=1).max())
                bound = np.minimum(near.min(axis=0), least) + slack
                rows, centres_near = np.nonzero(near <= bound)
                exact = ((part[rows] - points[centres_near]) ** 2).sum(axis=1)
                for r, c, d in zip(rows, centres_near, exact, strict=True):
                    if d <= least[c]:
                        found = (float(d), ids[int(start + r)].as_py())
                        if best[c] is None or found < best[c]:
                            best[c], least[c] = found, d
        rows = [(c, b[1], b[0]) for c, b in enumerate(best) if b is not None]
        if rows:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("centre", row_id, "distance"), r)) for r in rows],
                schema=pa.schema(
                    [
                        ("centre", pa.int32()),
                        (row_id, ids.type),
                        ("distance", pa.float64()),
                    ]
                ),
            )

    schema = f"centre int, `{row_id}` {kind.simpleString()}, distance double"
    candidates = df.select(row_id, features).mapInArrow(run, schema)
    order = F.struct("distance", row_id)
    return candidates.groupBy("centre").agg(
        F.min_by(row_id, order).alias(row_id), F.min("distance").alias("distance")
    )


def own_centre(
    df: DataFrame,
    centres: np.ndarray,
    row_id: str = "row_id",
    features: str = "features",
) -> DataFrame:
    """Nearest centre of each row: (row_id, centre, distance), distance squared."""
    _check_centres(*centres.shape)
    shared = df.sparkSession.sparkContext.broadcast(centres)
    kind = df.schema[row_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix_of(batch.column(1))
            step = max(1, CHUNK_VALUES // len(points))
            label = np.concatenate(
                [
                    _distances(x[at : at + step], points).argmin(axis=1)
                    for at in range(0, len(x), step)
                ]
            )
            exact = ((x - points[label]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(label.astype(np.int32)), pa.array(exact)],
                [row_id, "centre", "distance"],
            )

    schema = f"`{row_id}` {kind.simpleString()}, centre int, distance double"
    return df.select(row_id, features).mapInArrow(run, schema)


def representative_ids(
    df: DataFrame,
    centres: np.ndarray,
    count: int,
    row_id: str = "row_id",
    features: str = "features",
) -> DataFrame:
    """Exactly ``count`` row ids: the rows nearest to the centres once each,
    filled up with the rows closest to their own centre."""
    vectors = materialize(df.select(row_id, features))
    nearest = nearest_rows(vectors, centres, row_id, features).select(row_id)
    nearest = materialize(nearest.distinct())
    missing = count - nearest.count()
    spare = join_same(
        own_centre(vectors, centres, row_id, features), nearest, [row_id], "left_anti"
    )
    # Top-k: fewer rows than there are centres.
    fill = spare.orderBy("distance", row_id).limit(missing).select(row_id)
    return nearest.unionByName(fill)


def select_by_kmeans(
    rows: DataFrame,
    features: DataFrame,
    max_example: int | None,
    row_id: str = "row_id",
    seed: int = 42,
    n_init: int = 10,
    max_iter: int = 300,
    max_bytes: int = DEFAULT_MAX_FEATURE_BYTES,
) -> DataFrame:
    """Rows whose vectors represent the whole set; few rows are all kept."""
    if max_example is None:
        return rows
    if max_example <= 0:
        return rows.where(F.lit(False))
    total, dim = check_features(features)
    if total <= max_example:
        return rows
    check_feature_bytes(total, dim, max_bytes)
    centres = kmeans_centres(features, max_example, seed, n_init, max_iter)
    chosen = representative_ids(features, centres, max_example, row_id)
    return join_same(rows, chosen, [row_id], "left_semi")


Selector = Callable[..., DataFrame]


def select_all(rows: DataFrame, max_example: int | None = None) -> DataFrame:
    return rows


def select_random(
    rows: DataFrame, max_example: int | None = None, context: Mapping | None = None
) -> DataFrame:
    """Seeded rows without replacement; ``context['key']`` names the row key."""
    context = context or {}
    key = list(context.get("key", ("row_id",)))
    return take_subset(rows, max_example, key, int(context.get("seed", 42)))


def select_kmeans(
    rows: DataFrame, max_example: int | None = None, context: Mapping | None = None
) -> DataFrame:
    """Transform and project ``context['features']``, cluster, keep the rows
    nearest to the centres."""
    context = dict(context or {})
    row_id = context.get("row_id", "row_id")
    if max_example is None:
        return rows
    limit = int(
        context.get("selector_max_kmeans_feature_bytes", DEFAULT_MAX_FEATURE_BYTES)
    )
    prepared = prepare_features(
        context["features"],
        context.get("selector_transformations"),
        context.get("selector_transformation_params"),
        context.get("selector_projection"),
        context.get("selector_projection_components"),
        int(context.get("seed", 42)),
        max_bytes=limit,
    )
    return select_by_kmeans(
        rows,
        prepared.features,
        max_example,
        row_id,
        int(context.get("seed", 42)),
        int(context.get("kmeans_n_init", 10)),
        int(context.get("kmeans_max_iter", 300)),
        limit,
    )


SELECTORS: dict[str, Selector] = {
    "identity": select_all,
    "random": select_random,
    "lora_ntk_kmeans": select_kmeans,
}


def run_selector(
    selector: str | Selector,
    rows: DataFrame,
    max_example: int | None = None,
    context: Mapping | None = None,
) -> DataFrame:
    """Call a registered or user selector, with ``context`` if it takes one."""
    call = SELECTORS[selector] if isinstance(selector, str) else selector
    accepted = inspect.signature(call).parameters.values()
    options = {"max_example": max_example}
    if any(p.kind is p.VAR_KEYWORD or p.name == "context" for p in accepted):
        options["context"] = dict(context or {})
    chosen = call(rows, **options)
    if not isinstance(chosen, DataFrame):
        raise ValueError(
            f"The selector gave {type(chosen).__name__}, not a DataFrame"
        )
    return chosen


def sample_train(
    pairs: DataFrame,
    selector: str | Selector,
    max_example: int | None = None,
    context: Mapping | None = None,
    train: str = "train",
) -> DataFrame:
    """Replace the train split by its selection; other splits pass through."""
    rows = pairs.where(F.col("split") == train)
    others = pairs.where(F.col("split") != train)
    return run_selector(selector, rows, max_example, context).unionByName(others)


def sample_counts(
    pairs: DataFrame, sampled: DataFrame, train: str = "train"
) -> DataFrame:
    """Rows per split before and after sampling."""
    before = pairs.groupBy("split").agg(F.count(F.lit(1)).alias("original_examples"))
    after = sampled.groupBy("split").agg(F.count(F.lit(1)).alias("selected_examples"))
    joined = before.join(after, "split", "left")
    return joined.select(
        "split",
        "original_examples",
        F.coalesce("selected_examples", F.lit(0)).alias("selected_examples"),
    )


# Three names for the same scaling, and the names for none.
SCALING_POLICIES = ("match_full_exposure", "match_full_passes", "per_example")
FIXED_POLICIES = ("", "none", "fixed")


def scaled_iterations(
    policy: str,
    base: Column,
    selected: Column,
    original: Column,
    min_iters: int = 1,
    cap_at_full: bool = True,
) -> Column:
    """Training length for a subset: the full length scaled by the share of rows,
    rounded up, at least ``min_iters`` and at most the full length if capped.
    Unchanged where a number is missing or not positive."""
    policy = policy.strip().lower()
    if policy in FIXED_POLICIES:
        return base
    if policy not in SCALING_POLICIES:
        raise ValueError(
            f"No scaling policy {policy!r}; known: "
            f"{sorted({*SCALING_POLICIES, *FIXED_POLICIES[1:]})}"
        )
    if min_iters < 1:
        raise ValueError("min_iters must be 1 or more")
    share = F.ceil(F.try_divide(base * selected, original))
    scaled = F.greatest(F.lit(min_iters), share).cast("bigint")
    if cap_at_full:
        scaled = F.least(base, scaled)
    usable = (base > 0) & (selected > 0) & (original > 0)
    return F.when(usable, scaled).otherwise(base)

