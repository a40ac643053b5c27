"""Sparse matrices cut into tiles, and their products with dense matrices.

Rows fall into blocks by a hash, columns into bands by their position; a tile
holds the entries of one block and band.  The dense side of a product is cut
the same way.  Tiles and dense parts travel to the same tasks, sorted so that a
dense part comes before the tiles that it meets, and one dense part at a time
is in memory.  What a task adds up leaves it once for each part of the result,
so no shuffle carries a dense row per entry, and a column that most rows have
is spread over all blocks.
"""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.runtime import stored

# Entries of a block, about, and columns of a band.
BLOCK_ENTRIES = 1 << 18
BAND_WIDTH = 1 << 14
# Entries that are multiplied at once.
CHUNK = 1 << 14
# Sums that a task holds before it sends them on.
HELD_BYTES = 128 << 20
# Tasks among which the sums of one part are shared at first.
SHARES = 16
# Dense parts in one Arrow batch.
BATCH_PARTS = 1

_PARTS = "key int, values binary"
_STREAM = "key int, part int, kind int, block int, band int, starts binary, columns binary, values binary"


@dataclass(frozen=True)
class Tiles:
    """``frame`` (block, band, starts, columns, values) with the entries of a tile by row, and ``ids`` (block, ids)
    of the rows; ``starts`` says where each row of a tile begins.  Both are read from the stored ``table``."""

    table: DataFrame
    frame: DataFrame
    ids: DataFrame
    width: int
    band_width: int

    @property
    def bands(self) -> int:
        return -(-self.width // self.band_width)

    def band_size(self, band: int) -> int:
        return min(self.band_width, self.width - band * self.band_width)


def tiled(
    matrix: DataFrame, width: int, block_entries: int = BLOCK_ENTRIES, band_width: int = BAND_WIDTH
) -> Tiles:
    """Stored tiles of ``matrix`` (subject_id, idx, value), a stored table with positions below ``width``.

    A row is never cut; it has at most ``width`` entries.
    """
    blocks = 1 + matrix.count() // block_entries
    kind = matrix.schema["subject_id"].dataType.simpleString()

    def cut(key: tuple, entries: pa.Table) -> pa.Table:
        ids = entries.column("subject_id").combine_chunks().dictionary_encode()
        rows = ids.indices.to_numpy()
        columns = entries.column("idx").to_numpy()
        order = np.lexsort((columns, rows, columns // band_width))
        rows, columns = rows[order], columns[order]
        values = entries.column("value").to_numpy()[order].astype("<f8")
        edges = np.flatnonzero(np.diff(columns // band_width, prepend=-1, append=width))
        found = [(key[0].as_py(), -1, None, None, None, ids.dictionary.to_pylist())]
        for a, b in zip(edges, edges[1:]):
            band = int(columns[a]) // band_width
            starts = np.searchsorted(rows[a:b], np.arange(len(ids.dictionary) + 1))
            local = columns[a:b] - band * band_width
            found.append(
                (key[0].as_py(), band, _bytes(starts, "<i4"), _bytes(local, "<i4"), _bytes(values[a:b], "<f8"), None)
            )
        names = ["block", "band", "starts", "columns", "values", "ids"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(ids.dictionary.type)]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    block = F.pmod(F.xxhash64("subject_id"), F.lit(blocks)).cast("int").alias("block")
    entries = matrix.select(block, "subject_id", F.col("idx").cast("int").alias("idx"), F.col("value").cast("double").alias("value"))
    layout = f"block int, band int, starts binary, columns binary, values binary, ids array<{kind}>"
    every = stored(entries.groupBy("block").applyInArrow(cut, layout))
    return Tiles(every, every.filter("band >= 0").drop("ids"), every.filter("band < 0").select("block", "ids"), width, band_width)


def _bytes(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


@contextmanager
def large_rows(spark: SparkSession) -> Iterator[None]:
    """Few rows in each Arrow batch, for what is planned and run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_PARTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays(arrays, ["key", "values"])


class _Sums:
    """Dense parts added up by key; full ones leave when too much is held."""

    def __init__(self):
        self.parts: dict[int, np.ndarray] = {}
        self.size = 0

    def add(self, key: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        if key in self.parts:
            self.parts[key] += values
            return
        if self.size + values.nbytes > HELD_BYTES:
            yield from self.flush()
        self.parts[key] = values.copy()
        self.size += values.nbytes

    def flush(self) -> Iterator[pa.RecordBatch]:
        for key, values in self.parts.items():
            yield _batch([(key, _bytes(values, "<f8"))])
        self.parts.clear()
        self.size = 0


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for key, values in _rows(batches):
        yield from sums.add(key, np.frombuffer(values, "<f8"))
    yield from sums.flush()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of a task, whose rows come sorted by key."""
    now, total = None, None
    for key, values in _rows(batches):
        values = np.frombuffer(values, "<f8")
        if key != now:
            if now is not None:
                yield _batch([(now, _bytes(total, "<f8"))])
            now, total = key, values.copy()
        else:
            total += values
    if now is not None:
        yield _batch([(now, _bytes(total, "<f8"))])


def total(parts: DataFrame) -> DataFrame:
    """Sum by key of ``parts`` (key, values), in two steps, so that no task reads a part from every other task."""
    shared = parts.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    some = shared.repartition("key", "share").drop("share").mapInArrow(_combined, _PARTS)
    return some.repartition("key").sortWithinPartitions("key").mapInArrow(_summed, _PARTS)


def _runs(places: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.diff(places, prepend=places[0] - 1))


def _add_product(out: np.ndarray, to: np.ndarray, values: np.ndarray, dense: np.ndarray, at: np.ndarray) -> None:
    """Adds value times row ``at`` of ``dense`` to row ``to`` of ``out``, for entries sorted by ``to``."""
    for a in range(0, len(to), CHUNK):
        rows = to[a : a + CHUNK]
        begin = _runs(rows)
        out[rows[begin]] += np.add.reduceat(dense[at[a : a + CHUNK]] * values[a : a + CHUNK, None], begin, axis=0)


def _tile(starts: bytes, columns: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, column and value of the entries of a tile, and its number of rows."""
    begin = np.frombuffer(starts, "<i4")
    return np.repeat(np.arange(len(begin) - 1), np.diff(begin)), np.frombuffer(columns, "<i4"), np.frombuffer(values, "<f8"), len(begin) - 1


def _meeting(tiles: DataFrame, key: str, dense: DataFrame, parts: int) -> DataFrame:
    """Tiles and the dense parts that they meet in one sorted stream per task, dense parts first."""
    dealt = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
    left = tiles.select(
        F.col(key).alias("key"), dealt.alias("part"), F.lit(1).alias("kind"), "block", "band", "starts", "columns", "values"
    )
    none = F.lit(None)
    right = dense.select(
        "key",
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.lit(0).alias("kind"),
        none.cast("int").alias("block"),
        none.cast("int").alias("band"),
        none.cast("binary").alias("starts"),
        none.cast("binary").alias("columns"),
        "values",
    )
    return left.unionByName(right).repartition("key", "part").sortWithinPartitions("key", "part", "kind")


def _streamed(batches: Iterator[pa.RecordBatch], multiply: Callable, held: bool) -> Iterator[pa.RecordBatch]:
    """``multiply`` over tiles, each with the sum of the dense parts that came before it under its key.

    Products are added up by their keys if ``held``; otherwise each leaves at once.
    """
    sums = _Sums()
    now, dense, open_ = None, None, False
    for key, part, kind, block, band, starts, columns, values in _rows(batches):
        if kind == 0:
            fresh = np.frombuffer(values, "<f8")
            # Several parts of one key are shares of a sum.
            dense = dense + fresh if open_ and (key, part) == now else fresh
            now, open_ = (key, part), True
        elif (key, part) == now:
            to, found = multiply(block, band, _tile(starts, columns, values), dense)
            if held:
                yield from sums.add(to, found)
            else:
                yield _batch([(to, _bytes(found, "<f8"))])
    yield from sums.flush()


def times(tiles: Tiles, dense: DataFrame, n: int) -> DataFrame:
    """(key, values) by block of the matrix times ``dense`` (key, values by band, ``n`` columns): shares to be summed."""
    # Every part of a band gets a copy of its dense side, so there are no more than the cores can use.
    spark = dense.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)

    def multiply(block, band, tile, values):
        rows, columns, entries, height = tile
        out = np.zeros((height, n))
        _add_product(out, rows, entries, values.reshape(-1, n), columns)
        return block, out.ravel()

    stream = _meeting(tiles.frame, "band", dense, max(1, -(-tasks // tiles.bands)))
    # A task has a block once in a band, and seldom several bands: there is little to add up.
    return stream.mapInArrow(partial(_streamed, multiply=multiply, held=False), _PARTS)


def transposed_times(tiles: Tiles, dense: DataFrame, n: int) -> DataFrame:
    """(key, values) by band of the transposed matrix times ``dense`` (key, values by block, which may be shares)."""

    def multiply(block, band, tile, values):
        rows, columns, entries, _ = tile
        order = np.argsort(columns, kind="stable")
        out = np.zeros((tiles_size(band), n))
        _add_product(out, columns[order], entries[order], values.reshape(-1, n), rows[order])
        return band, out.ravel()

    width, band_width = tiles.width, tiles.band_width

    def tiles_size(band):
        return min(band_width, width - band * band_width)

    stream = _meeting(tiles.frame, "block", dense, 1)
    return total(stream.mapInArrow(partial(_streamed, multiply=multiply, held=True), _PARTS))


def ones(tiles: Tiles) -> DataFrame:
    """(key, values by block): a column of ones, whose product with the transposed matrix is the sums of its columns."""

    def run(batches):
        for block, n in _rows(batches):
            yield _batch([(block, _bytes(np.ones(n), "<f8"))])

    return tiles.ids.select("block", F.size("ids").alias("n")).mapInArrow(run, _PARTS)


def square_sum(tiles: Tiles) -> float:
    """Sum of the squares of all entries."""

    def run(batches):
        found = sum(float(v @ v) for v in (np.frombuffer(x, "<f8") for (x,) in _rows(batches)))
        yield pa.RecordBatch.from_arrays([pa.array([found])], ["s"])

    return tiles.frame.select("values").mapInArrow(run, "s double").agg(F.sum("s")).first()[0] or 0.0


def rows_by_id(tiles: Tiles, parts: DataFrame, n: int) -> DataFrame:
    """(subject_id, row) from shares (key, values by block) with ``n`` columns."""
    kind = tiles.ids.schema["ids"].dataType.elementType

    def run(batches):
        for ids, values in _rows(batches):
            flat = np.frombuffer(values, "<f8")
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, n, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["subject_id", "row"])

    joined = total(parts).join(tiles.ids, F.col("key") == F.col("block")).select("ids", "values")
    return joined.mapInArrow(run, f"subject_id {kind.simpleString()}, row array<double>")
