"""Outcome per entity, joined to its features."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.codes import binarise, strict_double


def outcomes(admissions: DataFrame) -> DataFrame:
    """(subject_id, mortality): the flag of every admission, as text."""
    return admissions.select("subject_id", F.col("hospital_expire_flag").alias("mortality"))


def entity_labels(admissions: DataFrame) -> DataFrame:
    """(subject_id, label): 1.0 if any admission was fatal."""
    flags = outcomes(admissions).groupBy("subject_id").agg(F.sum(strict_double("mortality")).alias("deaths"))
    return flags.select("subject_id", binarise("deaths").alias("label"))


def labeled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of entities that have a label; entities without one drop out."""
    return features.join(labels, "subject_id")
