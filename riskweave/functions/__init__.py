"""Column expressions: they build plans only and never touch data."""

from riskweave.functions.codes import (
    binarise,
    namespaced_code,
    parse_date,
    parse_day,
    strict_double,
    strict_int,
    lenient_double,
    lenient_int,
)
from riskweave.functions.hashing import hash_bucket
from riskweave.functions.scoring import tfidf
from riskweave.functions.text import normalize_text, tokens, word_bag

__all__ = [
    "binarise",
    "hash_bucket",
    "lenient_double",
    "lenient_int",
    "namespaced_code",
    "normalize_text",
    "parse_date",
    "parse_day",
    "strict_double",
    "strict_int",
    "tfidf",
    "tokens",
    "word_bag",
]
