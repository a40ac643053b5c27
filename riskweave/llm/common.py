"""What the operators of this folder share."""

import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.runtime import checkpoint_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The same for Python's str.translate.
ASCII_LOWER = str.maketrans(UPPER, LOWER)

# What parts words where only ASCII white space does.
ASCII_SPACE = r"[\x20\x09-\x0D]+"

# Rows in one Arrow batch: texts may be long, so few of them travel at once.
BATCH_ROWS = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the given folder; texts travel to Python in small batches from here on."""
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside reads and sends so few rows at once; for tables whose rows are large."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def ascii_lower(column: Column | str) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder that does not exist yet, below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small(frame: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A stored table of a few numbers per row, to be broadcast if it has been counted to be small."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_ARROW = {
    "int": pa.int32(),
    "long": pa.int64(),
    "float": pa.float32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<binary>": pa.list_(pa.binary()),
    "array<string>": pa.list_(pa.string()),
    "array<float>": pa.list_(pa.float32()),
    "array<double>": pa.list_(pa.float64()),
}


# What tasks keep in a worker process for later tasks of the same operator.
_kept: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in a worker process until a task comes that has no use for ``key``."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget(but: Hashable = None) -> None:
    """Drops what a worker keeps under other keys.  A function of its own: the store's name in a task's closure would be a copy."""
    others = [key for key in _kept if key != but]
    for key in others:
        del _kept[key]
    if others:
        # What is kept may refer to itself.
        gc.collect()
    # What Arrow holds back from batches that are gone.
    pa.default_memory_pool().release_unused()


def map_rows(
    frame: DataFrame,
    function: Callable[[Iterator[list[tuple]]], Iterator[list[tuple]]],
    columns: str,
    keeps: Hashable = None,
) -> DataFrame:
    """``function`` over the batches of each task, as lists of plain tuples, so that nulls and long
    integers stay what they are.  ``columns`` is the schema of the result, as in "a long, b string".
    ``keeps`` is the key of what the tasks keep, see :func:`kept`; a worker drops the rest.
    """
    fields = [c.strip().split(" ") for c in columns.split(",")]
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield list(zip(*(c.to_pylist() for c in batch.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        for rows in function(lists(batches)):
            if rows:
                arrays = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return frame.mapInArrow(run, columns)


def map_column(
    frame: DataFrame, column: str, start: Callable[[], Callable[[list], list]], keep: bool = False
) -> DataFrame:
    """``frame`` with the values of a column replaced, or, with ``keep``, the rows for which they become true.

    ``start`` is called once in each task and gives what is applied to the
    values of a batch; all other columns pass through as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        function = start()
        for batch in batches:
            place = batch.schema.get_field_index(column)
            values = function(batch.column(place).to_pylist())
            if keep:
                yield batch.filter(pa.array(values, pa.bool_()))
            else:
                yield batch.set_column(place, batch.schema.field(place), pa.array(values, batch.schema.field(place).type))

    return frame.mapInArrow(run, frame.schema)
