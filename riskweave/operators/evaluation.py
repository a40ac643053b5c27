"""Quality of hard 0/1 predictions and of clusterings, each in one aggregation."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.runtime import stored

GROUP = ("variant", "model")


def _cell(actual: int, predicted: int) -> Column:
    return F.count_if((F.col("label") == actual) & (F.col("prediction") == predicted))


def accuracy(predictions: DataFrame, by=GROUP) -> DataFrame:
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return predictions.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def confusion(predictions: DataFrame, by=GROUP) -> DataFrame:
    """c00 c01 c10 c11: actual class, then predicted class; empty cells are 0."""
    return predictions.groupBy(*by).agg(
        *[_cell(a, p).alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)]
    )


def _recall(hits: str, misses: str) -> Column:
    return F.try_divide(F.col(hits).cast("double"), F.col(hits) + F.col(misses))


def class_recall(predictions: DataFrame, by=GROUP) -> DataFrame:
    """Share of each actual class that is predicted as such; missing if there is none."""
    return confusion(predictions, by).select(
        *by, _recall("c00", "c01").alias("recall_0"), _recall("c11", "c10").alias("recall_1")
    )


def auroc_hard(predictions: DataFrame, by=GROUP) -> DataFrame:
    """Area under the ROC curve of predictions without scores.

    The curve has one inner point, so the area is the mean of both recalls.
    """
    recall = class_recall(predictions, by)
    return recall.select(*by, ((F.col("recall_0") + F.col("recall_1")) / 2).alias("auroc_hard"))


def auroc(predictions: DataFrame, by=GROUP, score: str = "score") -> DataFrame:
    """Area under the ROC curve of scores: the share of pairs of both classes that are in order, ties counting half.

    Equal scores are one row with their counts.  These are sorted in ranges; the
    negatives below a score are those of the ranges before, one number per range
    and group, and those before it in its own range.  Missing if a class is.
    """
    counted = predictions.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros")
    )
    placed = stored(counted.repartitionByRange(*by, "score").withColumn("range", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range of the sort and group in it.
    before = placed.groupBy(*by, "range").agg(F.sum("zeros").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    within = Window.partitionBy(*by, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    here = placed.withColumn("below", F.coalesce(F.sum("zeros").over(within), F.lit(0))).join(
        before.drop("n"), [*by, "range"]
    )
    won = F.col("ones").cast("double") * (F.col("before") + F.col("below") + F.col("zeros") / 2.0)
    pairs = F.sum("ones").cast("double") * F.sum("zeros")
    return here.groupBy(*by).agg(F.try_divide(F.sum(won), pairs).alias("auroc"))


def report(predictions: DataFrame, by=GROUP) -> DataFrame:
    """One row per (variant, model): accuracy, AUROC and the four cells."""
    cells = confusion(predictions, by)
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    return cells.select(
        *by,
        F.try_divide((F.col("c00") + F.col("c11")).cast("double"), n).alias("accuracy"),
        ((_recall("c00", "c01") + _recall("c11", "c10")) / 2).alias("auroc_hard"),
        "c00",
        "c01",
        "c10",
        "c11",
    )


def purity(assignments: DataFrame, cluster: str = "cluster", klass: str = "class") -> DataFrame:
    """Share of rows that belong to the largest class of their cluster."""
    cells = assignments.groupBy(cluster, klass).agg(F.count(F.lit(1)).alias("n"))
    clusters = cells.groupBy(cluster).agg(F.max("n").alias("largest"), F.sum("n").alias("size"))
    return clusters.agg((F.sum("largest") / F.sum("size")).alias("purity"))
