"""Training and test sets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.hashing import SPLIT_SEED, hash_bucket

# Tenths of the entities in the training set.
TRAIN_TENTHS = 6
TENTHS = 10


def hash_split(frame: DataFrame, key: str = "subject_id", train_tenths: int = TRAIN_TENTHS) -> DataFrame:
    """Adds ``split``, 'train' or 'test', from a hash of the entity."""
    train = hash_bucket(key, TENTHS) < train_tenths
    return frame.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))


def random_split(frame: DataFrame, train_share: float = 0.6, seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """Spark's own split; it depends on the partitioning of ``frame``."""
    train, test = frame.randomSplit([train_share, 1.0 - train_share], seed=seed)
    return train, test


def split_by_ids(frame: DataFrame, train_ids: DataFrame, test_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the entities in two given lists."""
    return (
        frame.join(train_ids.select("subject_id"), "subject_id", "left_semi"),
        frame.join(test_ids.select("subject_id"), "subject_id", "left_semi"),
    )
