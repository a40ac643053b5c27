"""Queries whose models are tables: trees grown by aggregation, scores by joins, and their SQL."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import features, labels, learning, model_tables, splits, trees
from riskweave.operators.runtime import new_place, stored
from riskweave.plans import catalog, oracles, pipelines
from riskweave.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]

# Bins and depth of the tree that SQL grows too.
BINS, DEPTH = 8, 2
BOOSTED = {"iterations": 3, "max_depth": 3}
# Trees made up by a rule: node k of tree t splits at feature (STEP * t + k) % FEATURES.
TREES, STEP, FEATURES = 10, 7, 30
HOT_ROWS = catalog.HOT_ROWS


def baseline_matrix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored long matrix of the coded features, entities with label and split, and the index of the features."""
    source = catalog.event_tables(spark, folder)
    tuples = stored(pipelines.event_tuples(source, catalog.settings(spark)))
    index = stored(features.feature_index(features.feature_names(tuples)))
    matrix = stored(features.indexed_tuples(tuples, index))
    entities = splits.hash_split(tuples.select("subject_id").distinct())
    entities = stored(entities.join(labels.entity_labels(source.admissions), "subject_id"))
    return matrix, entities, index


def _training(matrix: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    train = entities.filter("split = 'train'").select("subject_id", F.col("label").alias("target"))
    return stored(matrix.join(train.select("subject_id"), "subject_id", "left_semi")), train


def tree_nodes(spark, folder):
    """Nodes of a tree of two levels."""
    matrix, entities, _ = baseline_matrix(spark, folder)
    nodes = trees.fit_tree(*_training(matrix, entities), max_depth=DEPTH, max_bins=BINS, method="width")
    return nodes.select(
        "node", "idx", "bin", F.round("cut", 6).alias("cut"), F.round("gain", 9).alias("gain"), "n", F.round("prediction", 9).alias("prediction")
    )


def tree_wide_predictions(spark, folder):
    """Own trees fitted on the training set; all entities get a prediction, and it beats the largest class."""
    matrix, entities, _ = baseline_matrix(spark, folder)
    data = _training(matrix, entities)
    found = []
    for name, nodes, boosted in (
        ("tree", trees.fit_tree(*data, max_depth=5), False),
        ("boosted", trees.fit_boosted(*data, **BOOSTED), True),
    ):
        values = model_tables.tree_values(matrix, entities, nodes)
        made = model_tables.tree_predictions(values, boosted).join(entities, "subject_id")
        train = F.col("split") == "train"
        hits = F.avg(F.when(train, (F.col("prediction") == F.col("label")).cast("double")))
        ones = F.avg(F.when(train, F.col("label")))
        found.append(
            made.agg(
                F.count(F.lit(1)).alias("n_entities"), (hits >= F.greatest(ones, 1 - ones) - 1e-9).alias("beats_majority")
            ).select(F.lit(name).alias("model"), "*")
        )
    return reduce(DataFrame.unionByName, found)


def _made_up_weight(idx):
    digest = F.md5(F.concat(F.lit("w:"), idx.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 2001 - 1000) / F.lit(1000.0)


def linear_scores(spark, folder, min_rows=HOT_ROWS):
    """Margins under made-up weights, with common features cut."""
    matrix, entities, index = baseline_matrix(spark, folder)
    weights = index.select("idx", _made_up_weight(F.col("idx")).alias("weight"))
    found = model_tables.linear_margins(matrix, entities, weights, 0.25, min_rows)
    return found.select("subject_id", F.round("margin", 6).alias("margin"))


def made_up_trees(spark: SparkSession) -> DataFrame:
    """Trees of two levels: nodes 1 to 3 split, 4 to 7 are leaves."""
    t, k = F.col("tree"), F.col("node")
    inner = k < 4
    return spark.range(TREES).select(F.col("id").cast("int").alias("tree"), F.explode(F.sequence(F.lit(1), F.lit(7)).cast("array<long>")).alias("node")).select(
        "tree",
        "node",
        F.when(inner, (t * STEP + k) % FEATURES).cast("int").alias("idx"),
        F.when(inner, k / 2.0).alias("cut"),
        F.when(inner, F.lit(0.0)).otherwise(k * 0.5 - t * 0.25).alias("prediction"),
        F.when(t == 0, F.lit(1.0)).otherwise(F.lit(0.5)).alias("weight"),
    )


def tree_scores(spark, folder):
    """Weighted sums over made-up trees."""
    matrix, entities, _ = baseline_matrix(spark, folder)
    values = model_tables.tree_values(matrix, entities, made_up_trees(spark))
    found = model_tables.tree_predictions(values, boosted=True)
    return found.select("subject_id", F.round("score", 6).alias("score"), "prediction")


def model_tables_agree(spark, folder):
    """Spark's models, written, read as tables and scored by joins, say the same as the models themselves."""
    matrix, entities, index = baseline_matrix(spark, folder)
    rows = splits.hash_split(features.sparse_rows(matrix))
    data = learning.stored_examples(rows, index, entities.select("subject_id", "label"), "split")
    train = data.filter("split = 'train'")
    found = []
    for name, options in (("logistic", {"reg_param": 0.01, "fit_intercept": True}), ("tree", {"max_depth": 5}), ("gbt", BOOSTED)):
        model = learning.estimator(name, **options).fit(train)
        place = new_place(spark, name)
        sinks.write_model(model, place)
        if name == "logistic":
            margins = model_tables.linear_margins(matrix, entities, model_tables.linear_weights(spark, model), float(model.intercept))
            ours = model_tables.linear_predictions(margins)
        else:
            values = model_tables.tree_values(matrix, entities, trees.spark_nodes(spark, place))
            ours = model_tables.tree_predictions(values, boosted=name == "gbt")
        theirs = learning.predict(model, data).withColumnRenamed("prediction", "theirs")
        both = theirs.join(ours, "subject_id")
        found.append(both.select(F.lit(name).alias("model"), "subject_id", (F.col("prediction") == F.col("theirs")).alias("same")))
    return reduce(DataFrame.unionByName, found)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (tree_nodes, tree_wide_predictions, linear_scores, tree_scores, model_tables_agree)}


_MATRIX = f"""
WITH {oracles._pipeline("baseline")}, {oracles.INDEX}, {oracles.SPLIT},
matrix AS (SELECT subject_id, idx, value FROM tuples JOIN feature_idx USING (source, feature)),
entities AS (
  SELECT subject_id, label, split FROM (SELECT DISTINCT subject_id FROM tuples) JOIN labels_all USING (subject_id)
  JOIN split USING (subject_id))"""


def _level(k: int) -> str:
    """Best split of every node at{k}, over all entities and features, and the nodes of the next level."""
    return f"""
hist{k} AS (
  SELECT node, idx, bin, count(*) AS n, sum(target) AS s FROM binned JOIN at{k} USING (subject_id) GROUP BY ALL),
sides{k} AS (
  SELECT node, idx, bin, sum(n) OVER upto AS nl, sum(s) OVER upto AS sl,
         sum(n) OVER (PARTITION BY node, idx) AS na, sum(s) OVER (PARTITION BY node, idx) AS sa
  FROM hist{k} WINDOW upto AS (PARTITION BY node, idx ORDER BY bin)),
gains{k} AS (
  SELECT *, (sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na) / na AS gain FROM sides{k} WHERE nl < na),
best{k} AS (
  SELECT node, idx, bin AS split_bin, gain FROM gains{k} WHERE gain > 1e-12
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, idx, bin) = 1),
at{k + 1} AS (
  SELECT subject_id, target, CASE WHEN split_bin IS NULL THEN node ELSE node * 2 + CAST(bin > split_bin AS BIGINT) END AS node
  FROM at{k} LEFT JOIN best{k} USING (node) LEFT JOIN binned USING (subject_id, idx))"""


def oracle_sql() -> dict[str, str]:
    return {
        "tree_nodes": f"""{_MATRIX},
at1 AS (SELECT subject_id, label AS target, CAST(1 AS BIGINT) AS node FROM entities WHERE split = 'train'),
entries AS (SELECT * FROM matrix WHERE subject_id IN (SELECT subject_id FROM at1)),
ends AS (SELECT idx, least(min(value), 0) AS low, greatest(max(value), 0) AS high FROM entries GROUP BY idx),
cells AS (
  SELECT subject_id, idx, low, high, coalesce(value, 0) AS v
  FROM (SELECT subject_id, ends.* FROM at1, ends) LEFT JOIN entries USING (subject_id, idx)),
binned AS (
  SELECT subject_id, idx, CAST(len([k FOR k IN range(1, {BINS}) IF low + (high - low) * k / {BINS} < v]) AS INTEGER) AS bin FROM cells),
{_level(1)}, {_level(2)},
best AS (SELECT * FROM best1 UNION ALL SELECT * FROM best2),
found AS (
  SELECT DISTINCT node, count(*) AS n, avg(target) AS prediction
  FROM (SELECT 1 AS level, * FROM at1 UNION ALL SELECT 2, * FROM at2 UNION ALL SELECT 3, * FROM at3) GROUP BY level, node)
SELECT node, idx, split_bin AS bin, round(low + (high - low) * (split_bin + 1) / {BINS}, 6) AS cut, round(gain, 9) AS gain, n,
       round(prediction, 9) AS prediction
FROM found LEFT JOIN best USING (node) LEFT JOIN ends USING (idx)""",
        "tree_wide_predictions": f"""{_MATRIX}
SELECT model, count(*) AS n_entities, true AS beats_majority
FROM entities, (VALUES ('tree'), ('boosted')) m(model) GROUP BY model""",
        "linear_scores": f"""{_MATRIX},
weights AS (
  SELECT idx, (CAST('0x' || substr(md5('w:' || idx), 1, 8) AS BIGINT) % 2001 - 1000) / 1000.0 AS weight FROM feature_idx)
SELECT subject_id, round(sum(value * weight) + 0.25, 6) AS margin
FROM entities JOIN matrix USING (subject_id) JOIN weights USING (idx) GROUP BY subject_id""",
        "tree_scores": f"""{_MATRIX},
trees AS (SELECT unnest(range({TREES})) AS tree),
seen AS (
  SELECT subject_id, tree,
         max(CASE WHEN idx = (tree * {STEP} + 1) % {FEATURES} THEN value ELSE 0 END) AS v1,
         max(CASE WHEN idx = (tree * {STEP} + 2) % {FEATURES} THEN value ELSE 0 END) AS v2,
         max(CASE WHEN idx = (tree * {STEP} + 3) % {FEATURES} THEN value ELSE 0 END) AS v3
  FROM matrix, trees GROUP BY ALL),
leaves AS (
  SELECT subject_id, tree,
         CASE WHEN v1 <= 0.5 THEN CASE WHEN v2 <= 1.0 THEN 4 ELSE 5 END
              ELSE CASE WHEN v3 <= 1.5 THEN 6 ELSE 7 END END AS node
  FROM seen),
sums AS (
  SELECT subject_id, sum((node * 0.5 - tree * 0.25) * CASE WHEN tree = 0 THEN 1.0 ELSE 0.5 END) AS score
  FROM leaves GROUP BY subject_id)
SELECT subject_id, round(CAST(score AS DOUBLE), 6) AS score, CAST(score > 0 AS DOUBLE) AS prediction
FROM entities JOIN sums USING (subject_id)""",
        "model_tables_agree": f"""{_MATRIX}
SELECT model, subject_id, true AS same FROM entities, (VALUES ('logistic'), ('tree'), ('gbt')) m(model)""",
    }
