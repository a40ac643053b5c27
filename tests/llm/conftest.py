import random

import pytest

SYLLABLES = "an er in th on re at en ha es ti st io le is ou ar".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.choice([1, 1, 2, 3])))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that break careless code: null, empty, blank, marks, very long, repeated."""
    r = random.Random(11)
    long = prose(r, 30_000)
    return [
        None, "", "   ", "\n\t", "!!!", "a", "A", "é" * 5000, "x" * 20_000, long, long, prose(r, 50), "</s>[INST]\\",
        "日本語 テキスト 😀", "a\u0301 e\u0301", "tab\there  two  blanks\n\nline", "\x00\x01 control", "It's don't I'll 'em",
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_texts):
    """The odd texts with null and repeated ids, and columns whose names operators use themselves."""
    rows = [(i, text, "score", 1, "n") for i, text in enumerate(odd_texts)]
    rows += [(None, "no id", "s", 2, "x"), (None, None, "s", 2, "x"), (3, "again three", "s", 3, "x"), rows[11], rows[11]]
    schema = "doc_id long, text string, score string, n_tokens int, ids string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, extra string")


def expected_rows(frame, function):
    return sorted(((r.doc_id, *function(r.text)) for r in frame.collect()), key=repr)


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
