"""How five filters interact, counted over a stream of files that takes back what it learns to be wrong.

A document's mask says which filters it fails.  Four of them look at the
document alone.  The fifth, that a smaller doc_id has the same text, depends on
rows that may not have come yet: a document that is the first of its text now
fails it once a smaller id arrives.

All files are read as micro-batches, up to the last one that is there.  Per
text, a keyed state holds the smallest doc_id so far and the masks of its rows;
some hundred texts, by their digests, share a key, as every key has its cost.
When a smaller id arrives, these masks are taken back from the counters of
their parts (-1) and come again with the fifth filter failed (+1).  Counters
are sums of such changes by part and mask, so they are right after every batch,
and a later call with the same folder reads the new files only.

Rows are combined in each task before they are shuffled: of the rows with one
text only those of the smallest id go to the state, the others fail the fifth
filter whatever comes and are counted where they are.  A text that a third of
all rows have is therefore a few rows per task.  All orders of the filters
follow from the counters by one product with a fixed matrix.
"""

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskweave.llm.common import ASCII_SPACE, new_folder
from riskweave.operators.runtime import stored

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
QUALITY, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
CODES = 4 << len(FILTERS)

# Texts a task holds before it hands them on.
HELD_TEXTS = 100_000
# Micro-batches over the files that are there.
BATCHES = 4
# Texts of one key of the state, about; the number of keys is fixed when a folder is first used.
TEXTS_PER_KEY = 256
NULL_SALTS = COUNTER_KEYS = 1024
DIGEST = 16

_CHANGES = "key long, text binary, doc_id long, part string, code int, n long"
# One entry of the lists for each text, part and code.
_STATE = "texts binary, ids array<long>, parts array<string>, codes array<int>, counts array<long>"
_COUNTERS = "part string, code int, n long"
_NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def own_mask(text: Column) -> Column:
    """Bits of the filters that look at one text."""
    words = F.array_remove(F.split(text, ASCII_SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (
        n < 200,
        100 * distinct.cast("long") < 50 * n.cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    )
    bits = [F.when(fail, F.lit(1 << k)).otherwise(F.lit(0)) for k, fail in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def facts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, doc_id, part, code) of every row, with a digest in place of the text."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, DIGEST).alias("digest"),
        own_mask(text).alias("mask"),
    )
    # Rows without an id have no label; they must not meet in one task of the join either.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SALTS))).otherwise(F.lit(0))
    joined = rows.withColumn("salt", salt).join(labels.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    marks = F.coalesce("marks", F.lit(0))
    return joined.select(F.col("digest").alias("text"), "doc_id", "part", (F.col("mask") + marks).cast("int").alias("code"))


def label_marks(labels: DataFrame) -> DataFrame:
    """(doc_id, marks) of labelled documents; of several rows with one id any that says 1 counts."""
    quality, toxic = (F.max(F.when(F.col(c) == 1, 1).otherwise(0)) for c in ("quality", "toxic"))
    marks = (quality * QUALITY + toxic * TOXIC).cast("int").alias("marks")
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(marks)


class _Least:
    """The smallest id of a text and how many of its rows there are by part and code.

    ``add`` takes more rows in and gives the changes to counters that are certain.
    """

    __slots__ = ("doc_id", "cells")

    def __init__(self):
        self.doc_id, self.cells = None, {}

    def add(self, doc_id: int, cells: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Rows of one id; what comes back is counted for good, with the fifth filter failed."""
        if self.doc_id is not None and doc_id > self.doc_id:
            return [(part, code | DUPLICATE, n) for part, code, n in cells]
        beaten = []
        if self.doc_id is None or doc_id < self.doc_id:
            beaten = [(part, code | DUPLICATE, n) for (part, code), n in self.cells.items()]
            self.doc_id, self.cells = doc_id, {}
        for part, code, n in cells:
            self.cells[part, code] = self.cells.get((part, code), 0) + n
        return beaten


def combined(keys: int):
    """Rows of a task with fewer rows per text: those of the smallest id, and counts of the others without a text.

    Texts have the keys from 0 to ``keys`` - 1, and counters that are certain have negative ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bytes, _Least] = {}
        certain: dict[tuple[str, int], int] = {}

        def count(cells):
            for part, code, n in cells:
                certain[part, code] = certain.get((part, code), 0) + n

        def flush():
            rows = [
                (int.from_bytes(text[:7], "little") % keys, text, least.doc_id, part, code, n)
                for text, least in texts.items()
                for (part, code), n in least.cells.items()
            ]
            # A counter comes from no more rows than there are tasks.
            rows += [
                (-1 - zlib.crc32(f"{code} {part}".encode()) % COUNTER_KEYS, None, None, part, code, n)
                for (part, code), n in certain.items()
            ]
            texts.clear()
            certain.clear()
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64())
                names = ["key", "text", "doc_id", "part", "code", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for text, doc_id, part, code in zip(*(c.to_pylist() for c in batch.columns)):
                if doc_id is None:
                    count([(part, code, 1)])
                else:
                    least = texts.get(text)
                    if least is None:
                        least = texts[text] = _Least()
                    count(least.add(doc_id, [(part, code, 1)]))
            if len(texts) >= HELD_TEXTS:
                yield from flush()
        yield from flush()

    return run


def _unpacked(state: tuple) -> dict[bytes, _Least]:
    texts, *lists = state
    found: dict[bytes, _Least] = {}
    for k, (doc_id, part, code, n) in enumerate(zip(*lists)):
        text = texts[k * DIGEST : (k + 1) * DIGEST]
        least = found.setdefault(text, _Least())
        least.doc_id = int(doc_id)
        least.cells[part, int(code)] = int(n)
    return found


def _packed(texts: dict[bytes, _Least]) -> tuple:
    rows = [(text, least.doc_id, *cell, n) for text, least in texts.items() for cell, n in least.cells.items()]
    digests, *lists = zip(*rows)
    return b"".join(digests), *map(list, lists)


def retract(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes to the counters from the rows of some texts in a micro-batch, and from what the state held before.

    Counters that are certain already pass through and leave no state.
    """
    texts = _unpacked(state.get) if state.exists else {}
    changes: dict[tuple[str, int], int] = {}
    before: dict[bytes, dict] = {}

    def change(part: str, code: int, n: int) -> None:
        changes[part, code] = changes.get((part, code), 0) + n

    for frame in frames:
        columns = (frame[c].tolist() for c in ("text", "doc_id", "part", "code", "n"))
        for text, doc_id, part, code, n in zip(*columns):
            if text is None:
                change(part, code, n)
                continue
            least = texts.get(text)
            if least is None:
                least = texts[text] = _Least()
            if text not in before:
                before[text] = dict(least.cells)
            for cell in least.add(int(doc_id), [(part, code, n)]):
                change(*cell)
    renewed = False
    for text, cells in before.items():
        now = texts[text].cells
        if now != cells:
            # What stood for the first of this text is taken back, and what stands for it now comes instead.
            renewed = True
            for (part, code), n in cells.items():
                change(part, code, -n)
            for (part, code), n in now.items():
                change(part, code, n)
    if renewed:
        state.update(_packed(texts))
    rows = [(part, code, n) for (part, code), n in changes.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=["part", "code", "n"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's changes."""
    sums: dict[tuple[str, int], int] = {}
    for batch in batches:
        for part, code, n in zip(*(c.to_pylist() for c in batch.columns)):
            sums[part, code] = sums.get((part, code), 0) + n
    rows = [(part, code, n) for (part, code), n in sums.items() if n]
    if rows:
        arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "code", "n"])


def _kept_number(spark: SparkSession, path: str, make: Callable[[], int]) -> int:
    """The number written at ``path``; the first call makes it."""
    spark.range(1).select(F.lit(make()).cast("long").alias("number")).write.mode("ignore").parquet(path)
    return spark.read.parquet(path).first().number


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Settings for the time in which a stream starts and runs."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def counters(
    spark: SparkSession, documents: str, labels: DataFrame, folder: str | None = None, batches: int = BATCHES
) -> DataFrame:
    """(part, code, n) of all rows of the Parquet files at ``documents`` (doc_id, text, source).

    The code has a bit for each filter of ``FILTERS`` that the rows fail, and
    two more for quality and toxicity by ``labels`` (doc_id, quality, toxic).
    Null texts are empty, null sources the empty part; a row without doc_id
    neither fails the fifth filter nor makes others fail it, and has no label.
    Rows of one doc_id with the same text do not make each other fail.  Further
    columns are ignored.

    ``folder`` holds the stream's progress, its state and the counters; with
    the folder of an earlier call only files that are new are read (labels are
    those of the time when a file is read).  The files that are there come in
    about ``batches`` micro-batches, so the state is written that many times.
    """
    folder = folder or new_folder(spark, "filter-audit")
    table = spark.read.parquet(documents)
    files = len(table.inputFiles())
    # Parquet knows its rows without reading them.
    keys = _kept_number(spark, f"{folder}/keys", lambda: 1 + table.count() // TEXTS_PER_KEY)
    marks = stored(label_marks(labels))
    if files:
        with _settings(
            spark,
            spark__sql__execution__arrow__maxRecordsPerBatch="10000",
            spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
            spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
            # There are few batches: a store is closed after each, and takes no memory until the next.
            spark__sql__streaming__stateStore__unloadOnCommit="true",
            # Else every store holds some megabytes of disk in advance.
            spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
        ):
            # As a pattern the path may also name a single file.
            pattern = f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]"
            stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(pattern)
            changes = (
                facts(stream, marks)
                .mapInArrow(combined(keys), _CHANGES)
                .groupBy("key")
                .applyInPandasWithState(retract, _COUNTERS, _STATE, "append", GroupStateTimeout.NoTimeout)
                .mapInArrow(summed, _COUNTERS)
            )
            query = (
                changes.writeStream.format("parquet")
                .outputMode("append")
                .option("checkpointLocation", f"{folder}/progress")
                .option("path", f"{folder}/counters")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        found = spark.read.schema(_COUNTERS).parquet(f"{folder}/counters")
    else:
        found = spark.createDataFrame([], _COUNTERS)
    return found.groupBy("part", "code").agg(F.sum("n").alias("n")).filter("n != 0")


def _weights() -> np.ndarray:
    """By code, order, step and number of the report: what a row of that code adds."""
    found = np.zeros((CODES, len(_ORDERS), len(FILTERS), len(_NUMBERS)), dtype=np.int64)
    for code in range(CODES):
        for o, order in enumerate(_ORDERS):
            gone = False
            for s, name in enumerate(order):
                bit = 1 << FILTERS.index(name)
                fails = bool(code & bit)
                removed = fails and not gone
                redundant = fails and gone
                gone = gone or fails
                alone = fails and not code & (2 * DUPLICATE - 1 & ~bit)
                lost = removed and bool(code & QUALITY), removed and bool(code & TOXIC)
                found[code, o, s, :6] = not gone, removed, redundant, alone, *lost
    # A filter's removals over all orders, wherever it stands.
    for k, name in enumerate(FILTERS):
        at = np.array([order.index(name) for order in _ORDERS])
        over_all = found[:, np.arange(len(_ORDERS)), at, 1].sum(axis=1)
        found[:, np.arange(len(_ORDERS)), at, 6] = over_all[:, None]
    return found


def report(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from counters (part, code, n)."""
    columns = ", ".join(["part string", "filter_order string", "step int", *(f"{c} long" for c in _NUMBERS)])
    # A part has at most CODES counters.
    parts = counted.groupBy("part").agg(F.collect_list("code").alias("codes"), F.collect_list("n").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _weights().reshape(CODES, -1)
        orders = [o for o in _ORDERS for _ in FILTERS]
        steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(_ORDERS))
        for batch in batches:
            for part, codes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                numbers = (np.array(counts, dtype=np.int64) @ weights[codes]).reshape(-1, len(_NUMBERS))
                arrays = [pa.array([part] * len(orders), pa.string()), pa.array(orders), pa.array(steps)]
                arrays += [pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(len(_NUMBERS))]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "filter_order", "step", *_NUMBERS])

    return parts.mapInArrow(run, columns)


def audit(
    spark: SparkSession, documents: str, labels: DataFrame, folder: str | None = None, batches: int = BATCHES
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Per part and order of the filters: rows kept after a step; removed in it;
    failing its filter, but removed before; failing no other filter; removed in
    it and of quality, or toxic; and the removals of its filter summed over all
    orders.  A table without rows has no parts.  See :func:`counters`.
    """
    return report(counters(spark, documents, labels, folder, batches))
