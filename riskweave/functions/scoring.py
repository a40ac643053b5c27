"""Scores of words."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def tfidf(count, norm, documents, document_frequency) -> Column:
    """``count / norm * ln((documents + 1) / (document_frequency + 1))``."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    idf = F.log((as_col(documents) + 1) / (as_col(document_frequency) + 1))
    return as_col(count) / as_col(norm) * idf
