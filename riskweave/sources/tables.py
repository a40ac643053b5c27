"""Readers for delimited text with a header row.

Files are read as text columns and projected by position, so the names in the
header are free; casts are explicit afterwards.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import codes
from riskweave.sources.quoted import read_quoted

# Fixed value: the part of a path that names a view.
VIEW_NAME = re.compile(r"(\w+)(\.csv)?$")


def read_table(spark: SparkSession, path, schema: T.StructType | None = None) -> DataFrame:
    """Comma-separated text; rows with a wrong number of fields are dropped.

    Pruning inside the CSV parser is off: with it, a query that needs only some
    of the columns would not notice that a row is malformed and keep it.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", ",")
        .option("mode", "DROPMALFORMED")
        .option("columnPruning", False)
    )
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def infer_view_name(path: str) -> str:
    """``dir/file.csv`` → ``file``; ``x.tsv`` → ``tsv``; otherwise the path itself."""
    found = VIEW_NAME.search(path)
    return found.group(1) if found else path


def load_table_as_view(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """Read a table and register it as a temporary view."""
    table = read_table(spark, path)
    table.createOrReplaceTempView(infer_view_name(path) if view is None else view)
    return table


def _at(table: DataFrame, position: int):
    return table[f"`{table.columns[position]}`"]


def read_admissions(spark: SparkSession, path) -> DataFrame:
    """Entity, day of death (missing for survivors) and the outcome flag as text."""
    raw = read_table(spark, path)
    return raw.select(
        _at(raw, 0).alias("subject_id"),
        codes.parse_day(_at(raw, 1)).alias("deathtime"),
        _at(raw, 2).alias("hospital_expire_flag"),
    )


def _read_coded(spark, path, prefix, drop_null_codes) -> DataFrame:
    raw = read_table(spark, path)
    coded = raw.select(
        _at(raw, 0).alias("subject_id"),
        codes.namespaced_code(prefix, _at(raw, 2), drop_null_codes).alias("code"),
        codes.parse_day(_at(raw, 3)).alias("event_date"),
    )
    return coded.filter(F.col("code").isNotNull()) if drop_null_codes else coded


def read_diagnoses(spark: SparkSession, path, drop_null_codes: bool = False) -> DataFrame:
    return _read_coded(spark, path, codes.DIAGNOSIS, drop_null_codes)


def read_medication(spark: SparkSession, path, drop_null_codes: bool = False) -> DataFrame:
    return _read_coded(spark, path, codes.MEDICATION, drop_null_codes)


def read_labs(spark: SparkSession, path) -> DataFrame:
    """Measurements; rows with any missing field are dropped."""
    raw = read_table(spark, path).na.drop("any")
    return raw.select(
        _at(raw, 0).alias("subject_id"),
        codes.namespaced_code(codes.LAB, _at(raw, 2)).alias("code"),
        codes.strict_double(_at(raw, 3)).alias("value"),
        codes.parse_day(_at(raw, 4)).alias("event_date"),
    )


def read_notes(spark: SparkSession, path, split: bool = False) -> DataFrame:
    """Free-text notes with columns subject_id, charttime and text.

    Texts may hold line breaks and doubled quotes, so one file is one task,
    unless ``split`` has its ranges read by several, see
    :mod:`riskweave.sources.quoted`.  Notes get an identifier from all their
    content; equal notes of one entity share it.
    """
    if split:
        raw = read_quoted(spark, path)
    else:
        raw = (
            spark.read.option("header", True)
            .option("multiLine", True)
            .option("quote", '"')
            .option("escape", '"')
            .csv(path)
        )
    return raw.select(
        F.sha2(F.to_json(F.struct("subject_id", "charttime", "text")), 256).alias("note_id"),
        "subject_id",
        F.to_date(F.nullif("charttime", F.lit("nan"))).alias("event_date"),
        "text",
    )


def read_note_table(spark: SparkSession, path, note_id: str | None = None) -> DataFrame:
    """Notes from a columnar table with subject_id, charttime and text, read in as many tasks as it has splits.

    ``note_id`` names a column that identifies them; without it they get an
    identifier from their content, as in :func:`read_notes`.
    """
    raw = spark.read.parquet(path)
    made = F.sha2(F.to_json(F.struct("subject_id", "charttime", "text")), 256)
    return raw.select(
        (made if note_id is None else F.col(note_id)).alias("note_id"),
        "subject_id",
        F.to_date(F.nullif(F.col("charttime").cast("string"), F.lit("nan"))).alias("event_date"),
        "text",
    )


def read_word_counts(spark: SparkSession, path) -> DataFrame:
    """Word counts per note; notes without a time (``nan`` or missing) are left out."""
    raw = read_table(spark, path)
    dated = drop_nan_time(raw, raw.columns[3])
    return dated.select(
        _at(raw, 0).alias("subject_id"),
        _at(raw, 1).alias("word"),
        codes.strict_int(_at(raw, 2)).cast("bigint").alias("cnt"),
        codes.parse_day(_at(raw, 3)).alias("event_date"),
    )


def read_tfidf(spark: SparkSession, path) -> DataFrame:
    """Scores per entity and word, as :func:`riskweave.sources.sinks.write_tfidf` leaves them."""
    raw = read_table(spark, path)
    return raw.select(
        _at(raw, 0).alias("subject_id"),
        _at(raw, 1).alias("word"),
        codes.strict_double(_at(raw, 2)).alias("tfidf"),
    )


def read_id_list(spark: SparkSession, path) -> DataFrame:
    """Distinct identifiers from the first column of a file."""
    raw = read_table(spark, path)
    return raw.select(_at(raw, 0).alias("subject_id")).distinct()


def drop_nan_time(table: DataFrame, column: str) -> DataFrame:
    """Rows whose time is given; ``nan`` as text counts as missing."""
    return table.filter(F.col(f"`{column}`") != "nan")
