"""Whitening of embeddings by a covariance over distinct vectors.

Entries become whole numbers, so equal vectors are equal exactly.  Rows are
grouped by their vector, combined in each task before the shuffle; the fit
takes every distinct vector once, or as often as it occurs.  Sums of whole
numbers give an exact centre, and every task adds up one small matrix of
products of centred vectors.  Each distinct vector is whitened once, and the
result is joined back to its rows; vectors that many rows have are cut into
parts for that.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.runtime import HOT_MIN_ROWS, hot_keys, row_salt, spread_join, stored

SCALE, OFFSET = 64, 1_000_000
# Larger entries would not be exact as double precision whole numbers.
LARGEST = float(1 << 52)
COMPONENTS = 16
# Directions with less of the largest variance, times the dimensions, are rounding errors.
NO_VARIANCE = 1e-14
# Distinct vectors whose products a task forms at once.
BLOCK = 4096
# Tasks that add up what all others send.
SUMMING_TASKS = 16
LIMB_BITS, LIMBS = 16, 4


def whole_vectors(embeddings: DataFrame, vector: str) -> DataFrame:
    """(vec_id, key, x) of the rows whose entries are all finite numbers: whole numbers, and a digest of them."""
    usable = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * SCALE < LARGEST)
    whole = lambda v: (F.floor(v.cast("double") * SCALE) + OFFSET).cast("long")
    rows = embeddings.select("vec_id", F.col(vector).alias("v"))
    # An empty vector has no entry that is not finite, but no direction either.
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", usable))
    rows = rows.select("vec_id", F.transform("v", whole).alias("x"))
    digest = F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256))
    return rows.select("vec_id", digest.alias("key"), "x")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(key, x, rows): every distinct vector and its number of rows."""
    return rows.groupBy("key").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("rows"))


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors as rows of a matrix, and how often they occur."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            yield x, part.column("rows").to_numpy(zero_copy_only=False)


def _added(frame: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple, kind) -> np.ndarray:
    """Sum of one array per task, added up in a few tasks before the driver takes those."""

    def bytes_of(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, dtype=kind).tobytes()], pa.binary())], ["part"])

    def one(batches):
        yield from bytes_of(task(batches))

    def several(batches):
        total = np.zeros(shape, dtype=kind)
        for batch in batches:
            for part in batch.column("part").to_pylist():
                total = total + np.frombuffer(part, dtype=kind).reshape(shape)
        yield from bytes_of(total)

    parts = frame.mapInArrow(one, "part binary").repartition(SUMMING_TASKS).mapInArrow(several, "part binary")
    total = np.zeros(shape, dtype=kind)
    for row in parts.toLocalIterator():
        total = total + np.frombuffer(row.part, dtype=kind).reshape(shape)
    return total


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean, as one rounding of the exact difference where it fits a whole number."""
    if n < 1 << 30 and int(np.abs(x).max(initial=0)) < 1 << 31:
        return (x * n - sums) / n
    mean = [divmod(int(s), n) for s in sums]
    return (x - np.array([q for q, _ in mean])) - np.array([r / n for _, r in mean])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * x - sums) squared, exactly."""
    bound = int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0))
    if bound < 1 << 62:
        d = x * n - sums
        if int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 1 << 63:
            return (d * d).sum(axis=1).tolist()
    exact = [int(s) for s in sums]
    return [sum((n * v - s) ** 2 for v, s in zip(row, exact)) for row in x.tolist()]


@dataclass(frozen=True)
class Whitening:
    """The number of fit rows and their exact sums, unit axes as columns, their variances, and the whole variance."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    total: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.axes / np.sqrt(self.variance)


def fit(vectors: DataFrame, dimensions: int, components: int = COMPONENTS, weight: str = "one") -> Whitening:
    """Whitening fitted on stored ``vectors`` (x, rows), each counted once, or as often as it occurs with "count".

    The driver holds one square matrix of the dimensions.
    """
    if weight not in ("one", "count"):
        raise ValueError(f"weight is one or count, not {weight}")

    def weights(rows: np.ndarray) -> np.ndarray:
        return rows if weight == "count" else np.ones_like(rows)

    # Sums by groups of bits, so that they are exact for any number of rows.
    def sums_of(batches):
        total = np.zeros((LIMBS, dimensions + 1), dtype=np.int64)
        for x, rows in _blocks(batches, dimensions):
            x = np.column_stack([x, np.ones(len(x), dtype=np.int64)])
            w = weights(rows)[:, None]
            for k in range(LIMBS):
                limb = x >> k * LIMB_BITS
                total[k] += ((limb if k == LIMBS - 1 else limb & (1 << LIMB_BITS) - 1) * w).sum(axis=0)
        return total

    limbs = _added(vectors, sums_of, (LIMBS, dimensions + 1), np.int64)
    exact = [sum(int(limb) << k * LIMB_BITS for k, limb in enumerate(column)) for column in limbs.T]
    n = exact.pop()
    if not n:
        return Whitening(0, np.zeros(dimensions, dtype=np.int64), np.zeros((dimensions, 0)), np.zeros(0), 0.0)
    sums = np.array(exact, dtype=np.int64 if max(map(abs, exact)) < 1 << 62 else object)

    def products(batches):
        total = np.zeros((dimensions, dimensions))
        for x, rows in _blocks(batches, dimensions):
            c = _centred(x, n, sums)
            total += c.T @ (c * weights(rows)[:, None])
        return total

    covariance = _added(vectors, products, (dimensions, dimensions), np.float64) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values)[:components]
    order = order[values[order] > max(0.0, values.max()) * NO_VARIANCE * dimensions]
    return Whitening(n, sums, axes[:, order], values[order], float(np.trace(covariance)))


def whiten(
    embeddings: DataFrame,
    vector: str = "embedding",
    components: int = COMPONENTS,
    weight: str = "one",
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component.

    Entries c of ``vector`` become x = floor(64 c) + 1,000,000.  The fit counts
    every distinct x once, or as often as rows have it with ``weight`` "count";
    ``n`` is the number of what it counts.  Components are numbered from 1 by
    falling variance; directions without variance are none, so a table of equal
    vectors has no rows in the result, nor has an empty one.  ``deviation`` is
    the squared distance from the mean times n squared, exact as decimal(38);
    ``identity_error`` tells how far the covariance of what the fit counts is
    from the identity after whitening.

    Rows whose vector is null or empty or holds null or non-finite entries (or
    entries beyond 2^46) are left out, also those of another length than most
    rows have (of two lengths that are as common the larger).  Null and
    repeated vec_ids keep their rows; further columns are ignored.
    """
    rows = whole_vectors(embeddings, vector)
    vectors = stored(distinct_vectors(rows))
    lengths = vectors.groupBy(F.size("x").alias("length")).agg(F.sum("rows").alias("rows"))
    most = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    dimensions = most.length if most else 0
    vectors = vectors.filter(F.size("x") == dimensions)
    fitted = fit(vectors, dimensions, components, weight)
    k = len(fitted.variance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            values = fitted.apply(x).ravel()
            places = pa.array(np.arange(0, len(values) + 1, k, dtype=np.int32))
            whitened = pa.ListArray.from_arrays(places, pa.array(values))
            away = pa.array([str(d) for d in deviations(x, fitted.n, fitted.sums)], pa.string())
            columns = [batch.column("key"), batch.column("rows"), away, whitened]
            yield pa.RecordBatch.from_arrays(columns, ["key", "rows", "deviation", "whitened"])

    result = "key binary, rows long, deviation string, whitened array<double>"
    done = stored(vectors.mapInArrow(run, result)) if k else embeddings.sparkSession.createDataFrame([], result)
    error = _identity_error(done, k, fitted.n, weight) if k else 0.0
    hot = hot_keys(vectors, "key", "rows", min_rows)
    joined = spread_join(rows.drop("x"), done.drop("rows"), "key", hot, row_salt("vec_id"))
    return joined.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        _element(fitted.variance / fitted.total if k else [0.0]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _element(values) -> Column:
    """The value at the place of a component."""
    return F.get(F.array(*(F.lit(float(v)) for v in values)), F.col("at"))


def _identity_error(done: DataFrame, k: int, n: int, weight: str) -> float:
    """Largest entry of the covariance of whitened vectors less the identity."""

    def moments(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            counts = batch.column("rows").to_numpy(zero_copy_only=False)[:, None] if weight == "count" else 1.0
            total[:k] += w.T @ (w * counts)
            total[k] += (w * counts).sum(axis=0)
        return total

    total = _added(done, moments, (k + 1, k), np.float64) / n
    # The vectors are centred already: their mean is a rounding error.
    covariance = total[:k] - np.outer(total[k], total[k])
    return float(np.abs(covariance - np.eye(k)).max())
