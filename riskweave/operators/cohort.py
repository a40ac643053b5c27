"""Selection and description of a cohort."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.codes import DIAGNOSIS
from riskweave.operators.runtime import HOT_MIN_ROWS, LISTED_ROWS, keep_listed, stored

# The code range of the cohort, codes stored without the dot.
COHORT_LOW, COHORT_HIGH, COHORT_DIGITS = "2500", "2590", 4


def select_cohort(
    diagnoses: DataFrame,
    low: str = COHORT_LOW,
    high: str = COHORT_HIGH,
    digits: int | None = COHORT_DIGITS,
    prefix: str = DIAGNOSIS,
) -> DataFrame:
    """Entities with a code from ``low`` to ``high``, compared on the first ``digits`` characters."""
    start = len(prefix) + 1
    bare = F.substring("code", start, digits) if digits else F.substring("code", start, 1 << 30)
    return diagnoses.filter(F.col("code").startswith(prefix) & bare.between(low, high)).select("subject_id").distinct()


def restrict(
    frame: DataFrame, cohort: DataFrame, min_rows: int = HOT_MIN_ROWS, listed_rows: int = LISTED_ROWS
) -> DataFrame:
    """Rows of the cohort."""
    return keep_listed(frame, cohort, "subject_id", min_rows, listed_rows)


def cohort_stats(
    cohort: DataFrame, everyone: DataFrame, notes: DataFrame, labels: DataFrame, tuples: DataFrame
) -> DataFrame:
    """One row: sizes, notes per entity with zero notes included, share deceased, features."""
    per_entity = notes.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    described = (
        cohort.join(per_entity, "subject_id", "left")
        .join(labels, "subject_id", "left")
        .select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("label", F.lit(0.0)).alias("label"))
    )
    n_all = everyone.agg(F.countDistinct("subject_id")).scalar()
    n_features = tuples.select("source", "feature").distinct().agg(F.count(F.lit(1))).scalar()
    return described.agg(
        F.count(F.lit(1)).alias("n_cohort"),
        F.avg("n").alias("notes_mean"),
        F.min("n").alias("notes_min"),
        F.max("n").alias("notes_max"),
        F.count_if(F.col("n") == 0).alias("n_without_notes"),
        F.count_if(F.col("label") > 0).alias("n_deceased"),
        F.avg("label").alias("share_deceased"),
    ).select("*", n_all.alias("n_all"), n_features.alias("n_features"))


def codes_in_ranges(codes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(code) of the distinct ``codes`` that lie in some range of ``ranges`` (low, high), ends included.

    Ranges may overlap and lie in each other.  Codes and lower ends are sorted
    together in parts; a code is in a range if the largest upper end of those
    that begin up to it, in its part or before, reaches it.  Nothing is held
    against every range.
    """
    begins = ranges.filter("low <= high").select(F.col("low").alias("value"), F.lit(0).alias("kind"), "high")
    wanted = codes.select(F.col("code").alias("value")).filter("value IS NOT NULL").distinct()
    marks = begins.unionByName(wanted.withColumns({"kind": F.lit(1), "high": F.lit(None).cast("string")}))
    # Equal values come to one part.
    placed = stored(marks.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part of the sort.
    before = placed.groupBy("part").agg(F.max("high").alias("top")).select("part", F.max("top").over(earlier).alias("before"))
    within = Window.partitionBy("part").orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = placed.withColumn("here", F.max("high").over(within)).join(F.broadcast(before), "part")
    return swept.filter((F.col("kind") == 1) & (F.greatest("here", "before") >= F.col("value"))).select(F.col("value").alias("code"))


def select_by_ranges(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct entities with a code in some range of ``ranges`` (low, high)."""
    listed = codes_in_ranges(events, ranges)
    return keep_listed(events.select("subject_id", "code"), listed, "code").select("subject_id").distinct()
