"""Quoted delimited text whose fields hold line breaks, one file read by many tasks.

Whether a line begins a record shows only from the number of quotes before it
in its file.  So a first pass counts the quotes of each byte range (the splits
that Spark reads anyway), a running sum over the ranges of a file says which of
them begin inside a quoted field, and a second pass puts the lines of records
together.  Records that lie within a range never leave their task; of the
others each range gives at most its first and its last part, which meet by the
range where the record begins.

Quotes inside quoted fields are doubled, and fields that hold a quote, a comma
or a line break are quoted; lines end with ``\\n`` or ``\\r\\n``.  Each file
begins with a header of one record.  Empty lines between records are skipped,
and empty fields are null, quoted or not.
Files that cannot be split, such as compressed ones, are one range.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.operators.runtime import LISTED_ROWS, stored

QUOTE = '"'
PARSING = {"quote": QUOTE, "escape": QUOTE, "maxCharsPerColumn": "-1"}

LINES = "file string, block long, owner long, inside boolean, text string"
PARTS = "file string, owner long, block long, header boolean, text string"


def read_lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, line, text, odd): lines with the split that holds them, in order by ``line`` within it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").alias("text"),
        (quotes % 2).alias("odd"),
    )


def ranges(lines: DataFrame) -> DataFrame:
    """(file, block, inside, owner) per range that holds the beginning of a line.

    ``inside`` says that it begins within a quoted field, and ``owner`` is then
    the range in which that record begins.
    """
    counted = lines.groupBy("file", "block").agg(
        F.sum("odd").alias("odd"),
        # Also a range that begins inside a record begins another one, unless its last line is the first that ends a field.
        (F.min(F.when(F.col("odd") == 1, F.col("line"))) < F.max("line")).alias("begins_later"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entered = counted.withColumn("inside", F.coalesce(F.sum("odd").over(before) % 2 == 1, F.lit(False)))
    begins = ~F.col("inside") | F.coalesce("begins_later", F.lit(False))
    return entered.select(
        "file", "block", "inside", F.last(F.when(begins, F.col("block")), True).over(before).alias("owner")
    )


def _joined(whole: bool):
    """Puts lines together: whole records of a range, or else the parts of records that cross its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, owner, inside, held, begun, header, rows = None, None, False, [], False, False, []

        def give(complete: bool) -> None:
            if held and (begun and complete) == whole:
                rows.append((at[0], at[1] if begun else owner, at[1], header, "\n".join(held)))

        def filled() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)] or [[]] * 5
            rows.clear()
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            names = ["file", "owner", "block", "header", "text"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for file, block, owned, began_inside, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at:
                    give(not inside)
                    at, owner, inside, held, begun, header = (file, block), owned, began_inside, [], False, False
                    first = block == 0
                if not inside:
                    give(True)
                    held, begun, header, first = [], True, first, False
                held.append(text)
                inside ^= bool(text.count(QUOTE) & 1)
            yield filled()
        give(not inside)
        yield filled()

    return run


def read_records(spark: SparkSession, path) -> DataFrame:
    """(file, header, text): every record as it stands in its file, line breaks in fields included."""
    lines = read_lines(spark, path)
    known = stored(ranges(lines))
    if known.limit(LISTED_ROWS + 1).count() <= LISTED_ROWS:
        placed = lines.join(F.broadcast(known), ["file", "block"])
    else:
        placed = lines.join(known, ["file", "block"]).sortWithinPartitions("file", "block", "line")
    placed = placed.select("file", "block", "owner", "inside", "text")
    whole = placed.mapInArrow(_joined(True), PARTS).select("file", "header", "text")
    parts = placed.mapInArrow(_joined(False), PARTS).groupBy("file", "owner").agg(
        F.max("header").alias("header"), F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts")
    )
    across = parts.select("file", "header", F.array_join("parts.text", "\n").alias("text"))
    return whole.unionByName(across).withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def read_quoted(spark: SparkSession, path) -> DataFrame:
    """The fields of all records as text, named by the header; missing fields are null, further ones are left out."""
    names = spark.read.option("header", True).option("multiLine", True).options(**PARSING).csv(path).columns
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    records = read_records(spark, path).filter(~F.col("header") & (F.col("text") != ""))
    return records.select(F.from_csv("text", F.lit(schema), PARSING).alias("fields")).select("fields.*")
