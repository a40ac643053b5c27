"""Reproducible buckets from identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the seed of the train/test split.
SPLIT_SEED = 6250


def hash_bucket(key, buckets: int, seed=SPLIT_SEED) -> Column:
    """Bucket 0..buckets-1 from the MD5 of ``seed:key``.

    It depends on the key alone: not on the row order, the partitioning, the
    engine or the other rows, so a re-run or a lost task gives the same answer.
    """
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")
