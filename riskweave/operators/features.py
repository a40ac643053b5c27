"""Feature tuples, their vocabulary and one sparse vector per entity."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import codes
from riskweave.operators.events import keep_codes
from riskweave.operators.runtime import HOT_MIN_ROWS, hot_keys, spread_join, stored

TUPLE_COLUMNS = ["subject_id", "source", "feature", "value"]


def _per_code(frame, wanted, value: Column) -> DataFrame:
    if wanted is not None:
        frame = keep_codes(frame, wanted)
    return frame.groupBy("subject_id", F.col("code").alias("feature")).agg(value.alias("value"))


def count_features(events: DataFrame, wanted: DataFrame | Iterable[str] | None = None) -> DataFrame:
    """Number of events per entity and code; ``wanted`` restricts the codes first."""
    return _per_code(events, wanted, F.count(F.lit(1)).cast("double"))


def mean_features(measurements: DataFrame, wanted: DataFrame | Iterable[str] | None = None) -> DataFrame:
    """Mean value per entity and code."""
    return _per_code(measurements, wanted, F.avg("value"))


def sum_word_features(word_counts: DataFrame) -> DataFrame:
    """Total count per entity and word."""
    return word_counts.groupBy("subject_id", F.col("word").alias("feature")).agg(
        F.sum("cnt").cast("double").alias("value")
    )


def mean_word_features(scores: DataFrame) -> DataFrame:
    """Mean score per entity and word."""
    return scores.groupBy("subject_id", F.col("word").alias("feature")).agg(F.avg("tfidf").alias("value"))


def event_features(events: DataFrame) -> DataFrame:
    """Tuples of all coded sources in one aggregation.

    Counts are sums of ones and measurements are averaged, so one pass with
    partial aggregation before the shuffle serves every source.
    """
    value = F.when(F.col("source") == codes.LAB, F.avg("value")).otherwise(F.sum("value"))
    return events.groupBy("subject_id", "source", F.col("code").alias("feature")).agg(value.alias("value"))


def word_features(features: DataFrame) -> DataFrame:
    """Marks per-word features as a source of their own, apart from the codes."""
    return features.select("subject_id", F.lit(codes.WORD).alias("source"), "feature", "value")


def union_tuples(*tuples: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(TUPLE_COLUMNS) for t in tuples])


def feature_names(tuples: DataFrame, min_entities: int = 1) -> DataFrame:
    """Distinct (source, feature) that at least ``min_entities`` entities have."""
    if min_entities <= 1:
        return tuples.select("source", "feature").distinct()
    # A tuple stands for one entity, so counting tuples counts entities.
    counted = tuples.groupBy("source", "feature").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_entities).select("source", "feature")


def vocabulary_size(tuples: DataFrame) -> DataFrame:
    return feature_names(tuples).agg(F.count(F.lit(1)).alias("n_features"))


def feature_index(names: DataFrame) -> DataFrame:
    """(source, feature, idx) with idx 0..n-1 in the order of source and name.

    The names are sorted in ranges and written as a table with their place in
    their range; the number of names before each range, one row per range, turns
    places into positions.  No task sees more than a range, and the written
    places do not change when a task runs again.
    """
    placed = stored(
        names.repartitionByRange("source", "feature")
        .sortWithinPartitions("source", "feature")
        # By definition the range number above 33 bits and the row number below.
        .withColumn("place", F.monotonically_increasing_id())
    ).select(
        "source",
        "feature",
        F.shiftright("place", 33).alias("part"),
        F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    # One row per range of the sort: bounded by the number of partitions.
    return placed.join(F.broadcast(offsets), "part").select(
        "source", "feature", (F.col("before") + F.col("at")).cast("int").alias("idx")
    )


def indexed_tuples(tuples: DataFrame, index: DataFrame, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """(subject_id, idx, value): the sparse matrix in long form.

    Names that more than one in ``HOT_SHARES`` tuples has are cut into parts.
    """
    named = tuples.withColumn("name", F.concat_ws("\x00", "source", "feature"))
    sizes = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    places = index.select(F.concat_ws("\x00", "source", "feature").alias("name"), "idx")
    hot = hot_keys(sizes, "name", "n", min_rows)
    joined = spread_join(named, places, "name", hot, F.xxhash64("subject_id"))
    return joined.select("subject_id", "idx", "value")


def sparse_rows(indexed: DataFrame) -> DataFrame:
    """(subject_id, indices, values) per entity, in ascending index order.

    A row has at most one entry per name of the vocabulary.
    """
    entries = F.sort_array(F.collect_list(F.struct("idx", "value")))
    return (
        indexed.groupBy("subject_id")
        .agg(entries.alias("entries"))
        .select("subject_id", F.col("entries.idx").alias("indices"), F.col("entries.value").alias("values"))
    )


def vector_struct(size, indices="indices", values="values") -> Column:
    """The stored layout of a sparse vector.

    A table written with it can be read with a vector column, which builds the
    vectors without leaving the JVM.
    """
    return F.struct(
        F.lit(0).cast("byte").alias("type"),
        size.alias("size"),
        F.col(indices).alias("indices"),
        F.col(values).alias("values"),
    )
