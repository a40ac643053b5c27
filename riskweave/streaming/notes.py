"""Word counts of new notes, appended to a table as the notes arrive."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.functions.text import ENGLISH_STOP_WORDS
from riskweave.operators.words import note_word_counts


def append_word_counts(
    notes: DataFrame,
    path: str,
    checkpoint: str,
    stop: Iterable[str] = tuple(ENGLISH_STOP_WORDS),
) -> StreamingQuery:
    """Starts a query that handles all notes there are and then ends.

    A note is counted inside its row, so the stream has no state and no shuffle:
    every note is written once, also after a restart from ``checkpoint``.
    """
    counts = note_word_counts(notes, stop=stop)
    return (
        counts.withColumn("event_date", F.col("event_date").cast("date"))
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
