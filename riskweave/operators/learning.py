"""Classifiers on stored feature tables."""

import uuid

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.features import vector_struct
from riskweave.operators.runtime import checkpoint_folder

MODELS = ("logistic", "tree", "gbt")
TREES = ("tree", "gbt")
# Spark's trees take 4 bytes a feature for every row and about 768 a feature for every node: 64 KB and 13 MB at this width.
DENSE_WIDTH = 1 << 14


def write_examples(rows: DataFrame, index: DataFrame, labels: DataFrame, *extra: str) -> str:
    """Folder with (subject_id, features, label, extra columns of ``rows``) in the stored layout of vectors.

    Fitting passes over the examples many times, so they are written to the
    checkpoint folder: a lost executor costs a re-read, not the whole pipeline.
    """
    size = index.agg(F.count(F.lit(1)).cast("int")).scalar()
    examples = rows.join(labels, "subject_id").select(
        "subject_id", vector_struct(size).alias("features"), "label", *extra
    )
    path = f"{checkpoint_folder(rows.sparkSession)}/riskweave-{uuid.uuid4().hex}"
    examples.write.parquet(path)
    return path


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples with a vector column, built by Spark's reader."""
    fields = [
        T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType)
        for f in spark.read.parquet(path).schema.fields
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def stored_examples(rows: DataFrame, index: DataFrame, labels: DataFrame, *extra: str) -> DataFrame:
    """:func:`write_examples`, read back."""
    return read_examples(rows.sparkSession, write_examples(rows, index, labels, *extra))


def example_entries(spark: SparkSession, path: str) -> DataFrame:
    """Written examples entry by entry: the size of the vector, and place and value of what is not zero."""
    raw = spark.read.parquet(path)
    others = [c for c in raw.columns if c != "features"]
    entry = F.explode(F.arrays_zip("features.indices", "features.values")).alias("entry")
    return raw.select(*others, F.col("features.size").alias("size"), entry).select(
        *others, "size", F.col("entry.indices").alias("idx"), F.col("entry.values").alias("value")
    )


def width(spark: SparkSession, path: str) -> int:
    """Size of the vectors of written examples; 0 if there are none."""
    row = spark.read.parquet(path).select("features.size").first()
    return row["size"] if row else 0


def logistic(reg_param: float = 0.0, fit_intercept: bool = False, max_iter: int = 100) -> LogisticRegression:
    return LogisticRegression(
        regParam=reg_param, fitIntercept=fit_intercept, maxIter=max_iter, family="binomial"
    )


def tree(max_depth: int = 10, max_bins: int = 32, max_memory_mb: int = 256) -> DecisionTreeClassifier:
    """``max_memory_mb`` bounds the statistics of one pass: raise it for wide vocabularies."""
    return DecisionTreeClassifier(
        impurity="gini", maxDepth=max_depth, maxBins=max_bins, maxMemoryInMB=max_memory_mb
    )


def gbt(
    iterations: int = 50, max_depth: int = 5, step_size: float = 0.1, max_memory_mb: int = 256, seed: int = 0
) -> GBTClassifier:
    return GBTClassifier(
        maxIter=iterations,
        maxDepth=max_depth,
        stepSize=step_size,
        lossType="logistic",
        maxMemoryInMB=max_memory_mb,
        seed=seed,
    )


def estimator(model: str, **parameters):
    """Estimator by its name in ``MODELS``."""
    return {"logistic": logistic, "tree": tree, "gbt": gbt}[model](**parameters)


def predict(model, examples: DataFrame) -> DataFrame:
    """(subject_id, prediction, label) with hard classes."""
    return model.transform(examples).select("subject_id", "prediction", "label")

