"""Event tables out of a sales star schema stored as Parquet.

Customers are the entities.  Orders give admissions and diagnoses, line items
give medication and measurements, documents give notes.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import codes
from riskweave.operators.events import stack_sources
from riskweave.operators.runtime import hot_keys, spread_join


NOTES_PER_ENTITY = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("subject_id"))


def admissions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order; the last order of a customer in debt is the fatal one.

    The earlier orders of debtors with an odd key have no flag, so that the
    window policies differ.
    """
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") < 0).alias("in_debt")
    )
    last = orders.groupBy("o_custkey").agg(
        F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("last_order"),
        F.count(F.lit(1)).alias("n_orders"),
    )
    fatal = F.col("in_debt") & (F.col("o_orderkey") == F.col("last_order"))
    hot = hot_keys(last, "o_custkey", "n_orders")
    owned = spread_join(orders, customers.join(last, "o_custkey"), "o_custkey", hot, F.xxhash64("o_orderkey"))
    unknown = F.col("in_debt") & (F.col("o_custkey") % 2 != 0)
    return owned.select(
        F.col("o_custkey").alias("subject_id"),
        F.when(fatal, F.col("o_orderdate").cast("date")).alias("deathtime"),
        F.when(fatal, F.lit("1")).when(~unknown, F.lit("0")).alias("hospital_expire_flag"),
    )


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        codes.namespaced_code(codes.DIAGNOSIS, "o_orderpriority").alias("code"),
        F.col("o_orderdate").cast("date").alias("event_date"),
    )


def _lines(spark, folder) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    parts = table(spark, folder, "part")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(
        parts, lines["l_partkey"] == parts["p_partkey"]
    )


def medication(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select(
        F.col("o_custkey").alias("subject_id"),
        codes.namespaced_code(codes.MEDICATION, "p_brand").alias("code"),
        F.col("o_orderdate").cast("date").alias("event_date"),
    )


def labs(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select(
        F.col("o_custkey").alias("subject_id"),
        codes.namespaced_code(codes.LAB, "p_type").alias("code"),
        F.col("l_quantity").alias("value"),
        F.col("l_shipdate").cast("date").alias("event_date"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """All coded events in one frame.

    Every line item gives a medication and a measurement, so the joined lines
    are read once and turned into two rows, not read and joined twice.
    """
    coded = stack_sources(diagnoses=diagnoses(spark, folder))
    both = _lines(spark, folder).select(
        F.col("o_custkey").alias("subject_id"),
        F.inline(
            F.array(
                F.struct(
                    F.lit(codes.MEDICATION).alias("source"),
                    codes.namespaced_code(codes.MEDICATION, "p_brand").alias("code"),
                    F.lit(1.0).alias("value"),
                    F.col("o_orderdate").cast("date").alias("event_date"),
                ),
                F.struct(
                    F.lit(codes.LAB).alias("source"),
                    codes.namespaced_code(codes.LAB, "p_type").alias("code"),
                    F.col("l_quantity").alias("value"),
                    F.col("l_shipdate").cast("date").alias("event_date"),
                ),
            )
        ),
    )
    return coded.unionByName(both)


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Last day and number of :func:`events` per entity.

    Line items are combined per order first, and parts are not needed.
    """
    shipped = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.max(F.col("l_shipdate").cast("date")).alias("shipped"), F.count(F.lit(1)).alias("lines")
    )
    orders = table(spark, folder, "orders")
    joined = orders.join(shipped, orders["o_orderkey"] == shipped["l_orderkey"], "left")
    return joined.groupBy(F.col("o_custkey").alias("subject_id")).agg(
        F.max(F.greatest(F.col("o_orderdate").cast("date"), "shipped")).alias("last_date"),
        F.sum(1 + 2 * F.coalesce("lines", F.lit(0))).alias("n_events"),
    )


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """One note per document; four documents in a row belong to one entity, every seventeenth has no date."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    day = F.date_add(F.lit("1995-01-01").cast("date"), ((F.col("doc_id") * 37) % 2400).cast("int"))
    return documents.select(
        F.col("doc_id").alias("note_id"),
        F.floor(F.col("doc_id") / NOTES_PER_ENTITY).alias("subject_id"),
        F.when(F.col("doc_id") % 17 != 0, day).alias("event_date"),
        "text",
    )
