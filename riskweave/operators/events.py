"""One frame for all kinds of events: subject_id, source, code, value, event_date."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import codes
from riskweave.operators.runtime import keep_listed

EVENT_COLUMNS = ["subject_id", "source", "code", "value", "event_date"]


def _as_events(frame: DataFrame, source: str, value) -> DataFrame:
    return frame.select(
        "subject_id",
        F.lit(source).alias("source"),
        "code",
        value.cast("double").alias("value"),
        "event_date",
    )


def stack_sources(
    diagnoses: DataFrame | None = None,
    medication: DataFrame | None = None,
    labs: DataFrame | None = None,
) -> DataFrame:
    """Union of the given sources; a counted event has the value 1.

    With the source as a column, all later steps (window join, aggregation)
    happen once for all sources.
    """
    frames = []
    if diagnoses is not None:
        frames.append(_as_events(diagnoses, codes.DIAGNOSIS, F.lit(1.0)))
    if medication is not None:
        frames.append(_as_events(medication, codes.MEDICATION, F.lit(1.0)))
    if labs is not None:
        frames.append(_as_events(labs, codes.LAB, F.col("value")))
    return reduce(DataFrame.unionByName, frames)


def event_dates(events: DataFrame) -> DataFrame:
    """Distinct (entity, day) pairs over all sources."""
    return events.select("subject_id", "event_date").distinct()


def drop_incomplete(frame: DataFrame) -> DataFrame:
    """Rows without any missing field."""
    return frame.na.drop("any")


def fatal(admissions: DataFrame) -> DataFrame:
    return admissions.filter(F.col("hospital_expire_flag") == "1")


def survived(admissions: DataFrame) -> DataFrame:
    return admissions.filter(F.col("hospital_expire_flag") == "0")


def undetermined(admissions: DataFrame) -> DataFrame:
    return admissions.filter(F.col("hospital_expire_flag").isNull())


def keep_codes(frame: DataFrame, wanted: DataFrame | Iterable[str], column: str = "code") -> DataFrame:
    """Rows whose code is in a list, or in the first column of a table."""
    if isinstance(wanted, DataFrame):
        return keep_listed(frame, wanted.select(F.col(wanted.columns[0]).alias(column)), column)
    return frame.filter(F.col(column).isin(list(wanted)))
