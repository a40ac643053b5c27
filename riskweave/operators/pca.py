"""Principal components of a sparse matrix of any width, by subspace iteration on its tiles."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import tiles as tl
from riskweave.operators.runtime import release, stored

EXTRA = 10
ITERATIONS = 4


@dataclass(frozen=True)
class Components:
    """``axes`` (key, values by band), what the mean row projects to, the variance along each axis and in all."""

    axes: DataFrame
    centre: np.ndarray
    variance: np.ndarray
    total_variance: float
    mean_square: float
    width: int
    band_width: int


def _mapped(parts: DataFrame, function: Callable[..., np.ndarray]) -> DataFrame:
    """``function`` over the dense parts in the columns behind the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, *values in zip(*(c.to_pylist() for c in batch.columns)):
                found = function(*(np.frombuffer(v, "<f8") for v in values))
                row = [pa.array([key], pa.int32()), pa.array([np.ascontiguousarray(found).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["key", "values"])

    return parts.mapInArrow(run, "key int, values binary")


def _gram(parts: DataFrame, function: Callable[..., np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all dense parts of a small matrix; a task gives one matrix.

    These are written first, so that all tasks run at once and no shuffle behind them stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for _, *values in zip(*(c.to_pylist() for c in batch.columns)):
                total += function(*(np.frombuffer(v, "<f8") for v in values))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    total = np.zeros(shape)
    found = stored(parts.mapInArrow(run, "part binary"))
    for row in found.toLocalIterator():
        total = total + np.frombuffer(row.part).reshape(shape)
    release(found)
    return total


def _start(means: DataFrame, n: int) -> DataFrame:
    """Random columns of every band in ``means``, which depend on the band alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, values in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.random.default_rng(band).standard_normal((len(values) // 8, n))
                row = [pa.array([band], pa.int32()), pa.array([found.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["key", "values"])

    return means.mapInArrow(run, "key int, values binary")


def _beside(left: DataFrame, right: DataFrame, dense: bool = True) -> DataFrame:
    """(key, values of both): one row per band.

    The hint keeps dense parts off the driver: a row is a whole band, and what
    Spark knows of a table's size says little about that.  Means, which are not
    ``dense``, may be broadcast, and then nothing is shuffled for them.
    """
    others = right.select("key", F.col("values").alias("others"))
    return left.join(others.hint("merge") if dense else others, "key")


def fit(
    matrix: DataFrame,
    n_rows: int,
    width: int,
    components: int = 50,
    iterations: int = ITERATIONS,
    block_entries: int = tl.BLOCK_ENTRIES,
    band_width: int = tl.BAND_WIDTH,
) -> Components:
    """Leading components of ``matrix`` (subject_id, idx, value), a stored table with ``n_rows`` rows.

    Only ``axes`` stays of the tables that are written for them.
    Entities without entries are rows of zeros.  Nothing is as large as a
    covariance: dense sides have a few more columns than components and are cut
    into parts, and the driver holds square matrices of that width.
    """
    spark = matrix.sparkSession
    n = min(components + EXTRA, width)
    kept = min(components, n)
    cut = tl.tiled(matrix, width, block_entries, band_width)
    with tl.large_rows(spark):
        sums = tl.transposed_times(cut, tl.ones(cut), 1)
        # A band in which no row has an entry has no sums, and no part in any product either.
        means = stored(_mapped(sums, lambda v: v / n_rows))
        mean_square = float(_gram(means, lambda m: np.array([[m @ m]]), (1, 1))[0, 0])
        now = stored(_start(means, n))
        for step in range(iterations + 1):
            centre = _gram(_beside(now, means, dense=False), lambda v, m: m[None, :] @ v.reshape(-1, n), (1, n))[0]
            # Stored, so that what is shuffled for one product is gone before the other.
            shares = stored(tl.times(cut, now, n))
            back = tl.transposed_times(cut, shares, n)
            less = stored(
                _mapped(_beside(back, means, dense=False), lambda w, m, c=centre: w.reshape(-1, n) - np.outer(m, n_rows * c))
            )
            release(shares)
            if step == iterations:
                break
            release(now)
            # Orthonormal columns; directions without variance are left at length zero.
            sizes, turns = np.linalg.eigh(_gram(less, lambda w: w.reshape(-1, n).T @ w.reshape(-1, n), (n, n)))
            scale = np.where(sizes > sizes.max() * 1e-14, 1 / np.sqrt(np.maximum(sizes, 1e-300)), 0.0)
            now = stored(_mapped(less, lambda w, t=turns * scale: w.reshape(-1, n) @ t))
            release(less)
        inner = _gram(_beside(now, less), lambda v, w: v.reshape(-1, n).T @ w.reshape(-1, n), (n, n))
        release(less, means)
        sizes, turns = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-sizes)[:kept]
        axes = stored(_mapped(now, lambda v: v.reshape(-1, n) @ turns[:, order]))
        release(now)
    squares = tl.square_sum(cut)
    release(cut.table)
    freedom = max(1, n_rows - 1)
    return Components(
        axes,
        centre @ turns[:, order],
        np.maximum(sizes[order], 0) / freedom,
        (squares - n_rows * mean_square) / freedom,
        mean_square,
        width,
        band_width,
    )


def project(
    matrix: DataFrame, entities: DataFrame, fitted: Components, block_entries: int = tl.BLOCK_ENTRIES
) -> DataFrame:
    """(subject_id, components) of every entity; those without entries are rows of zeros."""
    n = len(fitted.variance)
    cut = tl.tiled(matrix, fitted.width, block_entries, fitted.band_width)
    with tl.large_rows(matrix.sparkSession):
        scores = stored(tl.rows_by_id(cut, tl.times(cut, fitted.axes, n), n))
    release(cut.table)
    filled = entities.select("subject_id").join(scores, "subject_id", "left")
    zeros = F.array_repeat(F.lit(0.0), n)
    centre = F.array(*(F.lit(float(m)) for m in fitted.centre))
    return filled.select("subject_id", F.zip_with(F.coalesce("row", zeros), centre, lambda a, m: a - m).alias("components"))
