"""How the operators deal with cluster settings, stored intermediates and hot keys."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# No salted group holds more than about one part in HOT_SHARES of all rows, and
# there are fewer than HOT_SHARES hot keys, whatever the size of the data.
HOT_SHARES = 1000
# Below this many rows a key is never worth splitting.
HOT_MIN_ROWS = 1_000_000
# A list of keys up to this long is sent to every task, after it has been counted.
LISTED_ROWS = 100_000

SALT = "_salt"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="riskweave-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_place(spark: SparkSession, name: str) -> str:
    """Path of a folder that does not exist yet, below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# What a write has shuffled is of no use once the table is there.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query inside has shuffled is removed as soon as it ends."""
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written to the checkpoint folder and read back.

    This cuts the lineage: what follows no longer depends on executors that may
    be lost, and reads columns of a table whose size Spark knows.  The shuffles
    behind it are removed at once; the table stays until :func:`release`.
    """
    spark = frame.sparkSession
    path = new_place(spark, "riskweave")
    with clean_shuffles(spark):
        frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found.stored_at = path
    return found


def release(*frames: DataFrame | None) -> None:
    """Deletes tables that :func:`stored` has written and that nothing will read again."""
    for frame in frames:
        path = getattr(frame, "stored_at", None)
        if path is not None:
            context = frame.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def hot_keys(
    sizes: DataFrame, key: str, rows: str, min_rows: int = HOT_MIN_ROWS, shares: int = HOT_SHARES
) -> Column:
    """Map from keys with too many rows for one task to the number of parts to cut them into.

    ``sizes`` has one row per key and its number of rows; a null key joins with nothing and is never hot.  A hot key has more
    than one part in ``shares`` of all rows, so the map has fewer than
    ``shares`` entries by construction, at any scale.  It is a scalar subquery:
    nothing runs before the query that uses it, and no join is needed to look
    a key up.
    """
    sizes = sizes.filter(F.col(key).isNotNull())
    total = sizes.agg(F.sum(rows)).scalar()
    limit = F.greatest(F.lit(float(min_rows)), total / F.lit(float(shares)))
    parts = F.ceil(F.col(rows) / limit).cast("int")
    hot = sizes.filter(F.col(rows) > limit).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), parts))))
    return hot.scalar()


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, longer by as many strokes as it takes to be no column of ``frames``."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(
    big: DataFrame, small: DataFrame, key: str | list[str], hot: Column, salt: Column, how: str = "inner"
) -> DataFrame:
    """Equi-join whose hot keys are cut into parts; ``how`` is inner, left or left_anti.

    With several columns as the key, the map ``hot`` has structs of them.

    Rows of ``big`` with a hot key are dealt to its parts by ``salt``, and the
    rows of ``small`` with that key are repeated once per part; all other keys
    have a single part.  Every pair comes out exactly once.  How the join is
    done is left to Spark, which knows the sizes after the shuffles.
    """
    name = free_name(SALT, big, small)
    keys = [key] if isinstance(key, str) else key
    parts = F.coalesce(F.try_element_at(hot, F.col(key) if isinstance(key, str) else F.struct(*key)), F.lit(1))
    dealt = big.withColumn(name, F.pmod(salt, parts).cast("int"))
    repeated = small.withColumn(name, F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(repeated, [*keys, name], how).drop(name)


def keep_listed(
    frame: DataFrame,
    wanted: DataFrame,
    key: str,
    min_rows: int = HOT_MIN_ROWS,
    listed_rows: int = LISTED_ROWS,
) -> DataFrame:
    """Rows of ``frame`` whose ``key`` is in the table ``wanted``, of any size.

    A list of at most ``LISTED_ROWS`` keys, which is counted first, goes to
    every task, and ``frame`` is not shuffled.  With a longer one both sides
    are shuffled and hot keys are cut into parts.
    """
    listed = stored(wanted.select(key).filter(F.col(key).isNotNull()).distinct())
    if listed.limit(listed_rows + 1).count() <= listed_rows:
        return frame.join(F.broadcast(listed), key, "left_semi").select(frame.columns)
    sizes = frame.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    salt = row_salt(*[c for c in frame.columns if c != "text"])
    hot = hot_keys(sizes, key, "n", min_rows)
    return spread_join(frame, listed, key, hot, salt).select(frame.columns)


def row_salt(*columns: str) -> Column:
    """Deals rows by their content and input split.

    Both stay the same when a task runs again; the split tells equal rows apart.
    """
    return F.xxhash64(F.spark_partition_id(), *columns)
