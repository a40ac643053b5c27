"""Writers for word tables, models and reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_word_counts(counts: DataFrame, path: str, mode: str = "append") -> None:
    """One row per (note, word), added to what the folder already holds."""
    counts.select(
        "subject_id",
        "word",
        F.col("cnt").alias("count"),
        F.coalesce(F.date_format("event_date", "yyyy-MM-dd HH:mm:ss"), F.lit("nan")).alias("charttime"),
    ).write.mode(mode).option("header", True).csv(path)


def write_tfidf(scores: DataFrame, path: str) -> None:
    """Replaces what the folder held."""
    scores.select("subject_id", "word", "tfidf").write.mode("overwrite").option("header", True).csv(path)


def write_model(model, path: str) -> None:
    """One folder per (variant, model)."""
    model.write().overwrite().save(path)


def write_nodes(nodes: DataFrame, path: str) -> None:
    """A tree model as its table of nodes, in the place of :func:`write_model`'s folder."""
    nodes.write.mode("overwrite").parquet(path)


def write_metrics(report: DataFrame, path: str) -> None:
    """The report rows of :func:`riskweave.operators.evaluation.report` as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_metrics_lines(report: DataFrame, path: str) -> None:
    """Six text lines per report row: accuracy, AUROC and the four cells in reading order."""
    values = ["accuracy", "auroc_hard", "c00", "c01", "c10", "c11"]
    lines = F.posexplode(F.array(*[F.col(c).cast("double").cast("string") for c in values]))
    (
        report.select("variant", "model", lines.alias("line", "value"))
        .repartitionByRange(1, "variant", "model", "line")
        .sortWithinPartitions("variant", "model", "line")
        .drop("line")
        .write.mode("overwrite")
        .partitionBy("variant", "model")
        .text(path)
    )
