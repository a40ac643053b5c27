"""Models as tables, and predictions by joins and sums over the long form of the features.

A linear model has a row per feature with its weight; trees have a row per
node.  Entities without entries are rows of zeros.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.runtime import HOT_MIN_ROWS, hot_keys, spread_join


def linear_weights(spark: SparkSession, model) -> DataFrame:
    """(idx, weight) of the features of a fitted linear classifier that count; the model itself is on the driver."""
    weights = model.coefficients
    places = range(weights.size) if not hasattr(weights, "indices") else weights.indices.tolist()
    rows = [(int(i), float(w)) for i, w in zip(places, weights.values.tolist()) if w]
    return spark.createDataFrame(rows, "idx int, weight double")


def linear_margins(
    matrix: DataFrame, entities: DataFrame, weights: DataFrame, intercept: float = 0.0, min_rows: int = HOT_MIN_ROWS
) -> DataFrame:
    """(subject_id, margin): the sum of value times weight of every entity of ``entities``.

    ``matrix`` is a stored table (subject_id, idx, value).  Features of more
    than one in ``HOT_SHARES`` entries are cut into parts, and what meets is
    summed per entity before the shuffle.
    """
    sizes = matrix.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    met = spread_join(matrix, weights, "idx", hot_keys(sizes, "idx", "n", min_rows), F.xxhash64("subject_id"))
    sums = met.groupBy("subject_id").agg(F.sum(F.col("value") * F.col("weight")).alias("sum"))
    joined = entities.select("subject_id").join(sums, "subject_id", "left")
    return joined.select("subject_id", (F.coalesce("sum", F.lit(0.0)) + F.lit(intercept)).alias("margin"))


def linear_predictions(margins: DataFrame) -> DataFrame:
    """(subject_id, probability, prediction) of a logistic model."""
    probability = 1 / (1 + F.exp(-F.col("margin")))
    return margins.select(
        "subject_id", probability.alias("probability"), (F.col("margin") > 0).cast("double").alias("prediction")
    )


def tree_values(matrix: DataFrame, entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(subject_id, tree, weight, value): the prediction of the leaf of each tree that an entity ends in.

    ``nodes`` has the columns tree, node, idx, cut, prediction and weight; values
    up to the cut go to node 2k, others to 2k + 1.  An entity needs the features
    only that some node splits at; they are put together once, and every level
    is a look-up in the table of nodes.
    """
    nodes = nodes.select("tree", "node", "idx", "cut", "prediction", "weight")
    used = nodes.filter("idx IS NOT NULL").select("idx").distinct()
    entries = matrix.join(F.broadcast(used), "idx", "left_semi")
    own = entries.groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("own"))
    depth = nodes.agg(F.max(F.floor(F.log2("node")))).first()[0]
    trees = nodes.filter("node = 1").select("tree", "node")
    here = entities.select("subject_id").join(own, "subject_id", "left")
    # Every entity goes through every tree; there are as many trees as the model has.
    here = here.withColumn("at", F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), F.lit(1).cast("long").alias("node")) for (t, _) in sorted(map(tuple, trees.collect()))))))
    here = here.select("subject_id", "own", "at.*")
    lookup = F.broadcast(nodes.select("tree", "node", "idx", "cut").filter("idx IS NOT NULL"))
    for _ in range(int(depth or 0)):
        met = here.join(lookup, ["tree", "node"], "left")
        value = F.coalesce(F.try_element_at("own", F.col("idx")), F.lit(0.0))
        child = F.col("node") * 2 + (value > F.col("cut")).cast("int")
        here = met.select("subject_id", "own", "tree", F.when(F.col("idx").isNull(), F.col("node")).otherwise(child).alias("node"))
    leaves = nodes.select("tree", "node", "weight", F.col("prediction").alias("value"))
    return here.join(F.broadcast(leaves), ["tree", "node"]).select("subject_id", "tree", "weight", "value")


def tree_predictions(values: DataFrame, boosted: bool = False) -> DataFrame:
    """(subject_id, score, prediction): of boosted trees the sign of the weighted sum, else the class of the leaf.

    The score of one tree is what its nodes predict: a class in Spark's, a
    share of ones in :func:`riskweave.operators.trees.fit_tree`'s.
    """
    score = F.sum(F.col("weight") * F.col("value"))
    limit = 0.0 if boosted else 0.5
    return values.groupBy("subject_id").agg(score.alias("score")).withColumn(
        "prediction", (F.col("score") > limit).cast("double")
    )
