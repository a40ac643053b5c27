"""Codes, dates and casts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that keep the code systems apart, and the text
# formats in which the input files carry points in time and days.
DIAGNOSIS = "DIAG"
MEDICATION = "MED"
LAB = "LAB"
WORD = "WORD"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_FORMAT = "yyyy-MM-dd"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def namespaced_code(prefix: str, code, drop_null: bool = False) -> Column:
    """``prefix`` followed by ``code``.

    A missing code becomes the text ``null`` after the prefix, so that it still
    is a feature of its own; with ``drop_null`` it stays missing instead.
    """
    text = _col(code).cast("string")
    if not drop_null:
        text = F.coalesce(text, F.lit("null"))
    return F.concat(F.lit(prefix), text)


def parse_day(value, fmt: str = TIMESTAMP_FORMAT) -> Column:
    """Calendar day of a timestamp given as text; bad text is an error.

    Parsed without a time zone, so the day never depends on the session.
    """
    return F.to_timestamp_ntz(_col(value), F.lit(fmt)).cast("date")


def parse_date(value, fmt: str = DATE_FORMAT) -> Column:
    """Day given as text in ``fmt``."""
    return F.to_date(_col(value), fmt)


def strict_double(value) -> Column:
    """Number from text; under ANSI mode (the default) bad text is an error."""
    return _col(value).cast("double")


def strict_int(value) -> Column:
    return _col(value).cast("int")


def lenient_double(value) -> Column:
    """Number from text, missing where the text is not a number."""
    return _col(value).try_cast("double")


def lenient_int(value) -> Column:
    return _col(value).try_cast("int")


def binarise(value) -> Column:
    """1.0 where ``value`` is above zero, else 0.0."""
    return F.when(_col(value) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
