"""Tables that grow batch by batch: a batch counts once the manifest names it, and once only.

``folder/parts`` holds one folder per attempt, ``folder/manifest`` one row per
batch that counts.  An attempt that dies leaves a part that nothing names, so
a repeated call adds what is missing and never the same rows twice.  Two
writers at a time are refused: the second finds its number taken.
"""

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.features import feature_index

_ENTRY = "batch int, part string, rows long"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def batches(spark: SparkSession, folder: str) -> list:
    """Entries of the manifest, one per batch: number, part, rows."""
    if not _exists(spark, f"{folder}/manifest"):
        return []
    return sorted(spark.read.schema(_ENTRY).parquet(f"{folder}/manifest/*").collect())


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows that count."""
    parts = [f"{folder}/parts/{b.part}" for b in batches(spark, folder)]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def publish(spark: SparkSession, folder: str, frame: DataFrame) -> None:
    """Adds the rows of ``frame`` as the next batch; without rows nothing changes."""
    batch, part = len(batches(spark, folder)), uuid4().hex
    frame.write.parquet(f"{folder}/parts/{part}")
    rows = spark.read.schema(frame.schema).parquet(f"{folder}/parts/{part}").count()
    if rows:
        entry = spark.createDataFrame([(batch, part, rows)], _ENTRY)
        entry.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest/{batch:08d}")


def append_once(spark: SparkSession, folder: str, rows: DataFrame, key: str) -> None:
    """Adds those ``rows`` whose ``key`` no earlier batch has; rows of one key come in one call.

    The keys that are there are distinct rows of one column, combined before
    they meet the new ones.  A null key is a key like any other.
    """
    kind = rows.schema[key].dataType.simpleString()
    there = read(spark, folder, f"`{key}` {kind}").select(F.col(key).alias("_there")).distinct()
    fresh = rows.join(there, F.col(key).eqNullSafe(F.col("_there")), "left_anti")
    publish(spark, folder, fresh)


VOCABULARY = "source string, feature string, idx int"


def grow_vocabulary(spark: SparkSession, folder: str, names: DataFrame, index: Callable = feature_index) -> DataFrame:
    """(source, feature, idx) of all names so far; those of ``names`` that are new get the positions behind the others.

    Positions never change, so vectors and models of earlier batches stay valid.
    """
    known = read(spark, folder, VOCABULARY)
    first = sum(b.rows for b in batches(spark, folder))
    fresh = names.select("source", "feature").distinct().join(known, ["source", "feature"], "left_anti")
    placed = index(fresh).select("source", "feature", (F.col("idx") + first).cast("int").alias("idx"))
    publish(spark, folder, placed)
    return read(spark, folder, VOCABULARY)
