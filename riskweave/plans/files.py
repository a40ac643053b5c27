"""Queries that write tables as files and read them back with the library's readers.

Every seventh row of a delimited file has a field too many and is dropped by
the reader.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import evaluation, features, splits
from riskweave.operators.events import stack_sources
from riskweave.operators.runtime import checkpoint_folder
from riskweave.plans import catalog
from riskweave.sources import ledger, sinks, star, tables

TIME = "yyyy-MM-dd HH:mm:ss"
BAD_EVERY = 7
# Line items with this number have no reading.
UNREAD_LINE = 3


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def _spare(key: str):
    """A field nobody reads; in every seventh row it falls apart into two."""
    return F.when(F.col(key) % BAD_EVERY == 0, F.lit("a,b")).otherwise(F.lit("a")).alias("spare")


def _written(frame: DataFrame, name: str) -> str:
    path = _place(frame.sparkSession, name)
    frame.write.option("header", True).option("quote", "").csv(path)
    return path


def vocabulary_growth(spark, folder):
    """Positions after two batches: the features of entities with even keys first, then those of all."""
    tuples = features.event_features(star.events(spark, folder))
    place = _place(spark, "vocabulary")
    ledger.grow_vocabulary(spark, place, features.feature_names(tuples.filter("subject_id % 2 = 0 AND source != 'DIAG'")))
    return ledger.grow_vocabulary(spark, place, features.feature_names(tuples))


def word_counts_once(spark, folder):
    """Word counts of notes after two calls whose notes overlap, each note once."""
    counts = catalog.note_word_count_plain(spark, folder).select("note_id", "word", "cnt")
    place = _place(spark, "word-counts")
    ledger.append_once(spark, place, counts.filter("note_id % 3 != 0"), "note_id")
    ledger.append_once(spark, place, counts.filter("note_id % 2 = 0 OR note_id % 3 = 0"), "note_id")
    ledger.append_once(spark, place, counts, "note_id")
    return ledger.read(spark, place, "note_id long, word string, cnt long")


def csv_admissions(spark, folder):
    orders = star.admissions(spark, folder).withColumn("deathtime", F.date_format("deathtime", TIME))
    return tables.read_admissions(spark, _written(orders, "admissions.csv"))


def csv_events(spark, folder):
    orders = star.table(spark, folder, "orders")
    lines = star.table(spark, folder, "lineitem")
    parts = star.table(spark, folder, "part")
    ordered = F.date_format(F.col("o_orderdate").cast("timestamp"), TIME).alias("at")
    diagnoses = orders.select("o_custkey", _spare("o_orderkey"), "o_orderpriority", ordered)
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(
        parts, lines["l_partkey"] == parts["p_partkey"]
    )
    medication = joined.select("o_custkey", _spare("l_orderkey"), "p_brand", ordered)
    reading = F.when(F.col("l_linenumber") != UNREAD_LINE, F.col("l_quantity")).alias("reading")
    shipped = F.date_format(F.col("l_shipdate").cast("timestamp"), TIME).alias("at")
    labs = joined.select("o_custkey", _spare("l_orderkey"), "p_type", reading, shipped)
    return stack_sources(
        diagnoses=tables.read_diagnoses(spark, _written(diagnoses, "diagnoses.csv")),
        medication=tables.read_medication(spark, _written(medication, "drgcodes.csv")),
        labs=tables.read_labs(spark, _written(labs, "labevents.csv")),
    )


def csv_view(spark, folder):
    """A file as a view that is named after it."""
    nations = star.table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = _written(nations, "nations_on_file.csv")
    tables.load_table_as_view(spark, path)
    return spark.sql("SELECT n_regionkey AS region, count(*) AS n FROM nations_on_file GROUP BY n_regionkey")


def _note_rows(spark, folder) -> DataFrame:
    day = F.coalesce(F.col("event_date").cast("string"), F.lit("nan"))
    return star.notes(spark, folder).select("note_id", "subject_id", day.alias("charttime"), "text")


def _quoted_notes(spark, folder) -> str:
    path = _place(spark, "noteevents.csv")
    quoted = F.concat(F.lit('"note"\n'), "text")
    (
        _note_rows(spark, folder)
        .select("subject_id", "charttime", quoted.alias("text"))
        .write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def csv_notes(spark, folder):
    """Texts with quotation marks and line breaks."""
    return tables.read_notes(spark, _quoted_notes(spark, folder)).drop("note_id")


def csv_notes_split(spark, folder):
    """The same, ranges of a file read by several tasks."""
    return tables.read_notes(spark, _quoted_notes(spark, folder), split=True).drop("note_id")


def table_notes(spark, folder):
    """Notes as a columnar table."""
    path = _place(spark, "notes")
    _note_rows(spark, folder).write.parquet(path)
    return tables.read_note_table(spark, path, "note_id")


def csv_word_counts(spark, folder):
    path = _place(spark, "wordCount.csv")
    sinks.write_word_counts(catalog.note_word_count(spark, folder), path)
    return tables.read_word_counts(spark, path)


def csv_tfidf(spark, folder):
    path = _place(spark, "wordCount_tfidf.csv")
    sinks.write_tfidf(catalog.entity_scores(spark, folder), path)
    return tables.read_tfidf(spark, path).withColumn("tfidf", F.round("tfidf", 6))


def csv_id_split(spark, folder):
    nations = star.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    lists = [
        tables.read_id_list(spark, _written(nations.filter(F.col("c_nationkey").between(*part)), name))
        for part, name in ((catalog.TRAIN_NATIONS, "trainIDs.csv"), (catalog.TEST_NATIONS, "testIDs.csv"))
    ]
    labels = catalog.entity_label(spark, folder).withColumn("subject_id", F.col("subject_id").cast("string"))
    train, test = splits.split_by_ids(labels, *lists)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def _report(spark, folder) -> DataFrame:
    return evaluation.report(catalog.predictions(spark, folder))


def metrics_lines(spark, folder):
    path = _place(spark, "result")
    sinks.write_metrics_lines(_report(spark, folder), path)
    lines = spark.read.text(path)
    return lines.select("variant", "model", F.round(F.col("value").cast("double"), 6).alias("value"))


def metrics_table(spark, folder):
    path = _place(spark, "report")
    sinks.write_metrics(_report(spark, folder), path)
    found = spark.read.json(path)
    return found.withColumns({c: F.round(c, 6) for c in ("accuracy", "auroc_hard")})


def queries() -> dict[str, catalog.Query]:
    found = (
        vocabulary_growth,
        word_counts_once,
        csv_admissions,
        csv_events,
        csv_view,
        csv_notes,
        csv_notes_split,
        table_notes,
        csv_word_counts,
        csv_tfidf,
        csv_id_split,
        metrics_lines,
        metrics_table,
    )
    return {f.__name__: f for f in found}
