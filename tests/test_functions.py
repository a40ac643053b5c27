import datetime
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.functions import codes, hash_bucket, normalize_text, tfidf, tokens, word_bag
from riskweave.functions import text
from riskweave.functions.text import ENGLISH_STOP_WORDS, PUNCTUATION


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_namespaced_code(spark):
    frame = spark.createDataFrame([("25000",), (None,)], "code string")
    got = [tuple(r) for r in frame.select(codes.namespaced_code("DIAG", "code"), codes.namespaced_code("DIAG", "code", True)).collect()]
    assert got == [("DIAG25000", "DIAG25000"), ("DIAGnull", None)]


def test_days(spark):
    assert one(spark, codes.parse_day("t"), t="2084-07-03 23:59:59") == datetime.date(2084, 7, 3)
    assert one(spark, codes.parse_date("t"), t="2084-07-03") == datetime.date(2084, 7, 3)
    assert one(spark, codes.parse_date("t", "dd/MM/yyyy"), t="03/07/2084") == datetime.date(2084, 7, 3)
    with pytest.raises(Exception):
        one(spark, codes.parse_day("t"), t="yesterday")


def test_casts(spark):
    assert one(spark, codes.strict_double("t"), t="1.5") == 1.5
    assert one(spark, codes.strict_int("t"), t="7") == 7
    assert one(spark, codes.lenient_double("t"), t="seven") is None
    assert one(spark, codes.lenient_int("t"), t="seven") is None
    with pytest.raises(Exception):
        one(spark, codes.strict_double("t"), t="seven")


def test_binarise(spark):
    frame = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "n double")
    assert [r[0] for r in frame.select(codes.binarise("n")).collect()] == [0.0, 1.0, 1.0]


def test_hash_bucket_depends_on_key_only(spark):
    ids = spark.range(1000)
    once = {r[0]: r[1] for r in ids.select("id", hash_bucket("id", 10)).collect()}
    again = {r[0]: r[1] for r in ids.repartition(5).select("id", hash_bucket(F.col("id").cast("string"), 10)).collect()}
    assert once == again
    assert set(once.values()) == set(range(10))


def test_tfidf(spark):
    import math

    assert one(spark, tfidf("c", "n", "d", "f"), c=3, n=4, d=9, f=1) == pytest.approx(0.75 * math.log(5))


def words_by_scan(text):
    """One pass over the characters: white space and digits end a word, marks around it do not count."""
    found, word = [], None
    for character in text:
        if character.isspace() or unicodedata.category(character) == "Nd":
            if word is not None:
                found.append(word)
            word = None
        else:
            word = (word or "") + character.lower()
    if word is not None:
        found.append(word)
    bare = []
    for word in found:
        inside = [k for k, c in enumerate(word) if c not in PUNCTUATION]
        bare.append(word[inside[0] : inside[-1] + 1] if inside else "")
    return bare


# Texts and their words, by hand; an empty word is one of marks only.
TEXTS = [
    ("", []),
    ("   ", []),
    ("Plain words here", ["plain", "words", "here"]),
    ("  -- Hello, (World)!  --  ", ["", "hello", "world", ""]),
    ("x-ray b/p 120/80mmHg\nnext\tline\r\nlast.", ["x-ray", "b/p", "", "mmhg", "next", "line", "last"]),
    ("don't 'quote' \"double\" a--b --c-- ...", ["don't", "quote", "double", "a--b", "c", ""]),
    ("123 456", []),
    ("1a2b3c", ["a", "b", "c"]),
    ("été\xa0naïve Straße ÑANDÚ", ["été", "naïve", "straße", "ñandú"]),
    ("====================== title ======================", ["", "title", ""]),
    ("tab\x0bvertical\x1cseparator", ["tab", "vertical", "separator"]),
    ("٣ arabic ４２ wide", ["arabic", "wide"]),
    ("a" * 30000 + " " + "!" * 30000, ["a" * 30000, ""]),
]


def test_texts(spark):
    frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(TEXTS)], "i int, text string")
    rows = frame.select(
        "i", normalize_text("text").alias("n"), tokens("text").alias("t"), word_bag(tokens("text")).alias("b")
    ).collect()
    for row in rows:
        text, words = TEXTS[row["i"]]
        assert words_by_scan(text) == words
        kept = [w for w in words if w]
        assert row["n"] == " ".join(words)
        assert row["t"] == kept
        assert {b["word"]: b["cnt"] for b in row["b"]} == Counter(kept)


def test_tokens_of_normalized_text(spark):
    frame = spark.createDataFrame([(t,) for t, _ in TEXTS], "text string")
    twice = frame.select(tokens("text").alias("a"), tokens(normalize_text("text"), normalized=True).alias("b"))
    assert twice.filter("a <> b").count() == 0


def test_separator(spark):
    frame = spark.createDataFrame([("The patient's wife can't, b/p 120/80",)], "text string")
    cut = frame.select(tokens("text", separator=r"\s+|(?='s\b)|(?=n't\b)").alias("t")).first()["t"]
    assert cut == ["the", "patient", "'s", "wife", "ca", "n't", "b/p"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB é9.,-'\"\n\t x_", max_size=60), min_size=1, max_size=20))
def test_any_text(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for row in frame.select("i", normalize_text("text").alias("n"), word_bag(tokens("text")).alias("b")).collect():
        words = words_by_scan(texts[row["i"]])
        assert row["n"] == " ".join(words)
        assert {b["word"]: b["cnt"] for b in row["b"]} == Counter(w for w in words if w)


def test_missing_text(spark):
    frame = spark.createDataFrame([(None,)], "text string")
    assert frame.select(F.inline(word_bag(tokens("text")))).count() == 0


def test_stop_words():
    assert len(ENGLISH_STOP_WORDS) == len(set(ENGLISH_STOP_WORDS)) == 179


# What the conventions give for these texts.
@pytest.mark.parametrize(
    "text, expected",
    [
        ("They'll save and invest more.", "They 'll save and invest more ."),
        ("hi, my name can't hello,", "hi , my name ca n't hello ,"),
        ('"Hello," she said. "I cannot."', "`` Hello , '' she said. `` I can not . ''"),
        ("It's $3.88, or 1,000 (x-ray) -- why?!", "It 's $ 3.88 , or 1,000 ( x-ray ) -- why ? !"),
        ("gonna wanna 'tis [a]{b}<c>; d: e", "gon na wan na 't is [ a ] { b } < c > ; d : e"),
        ("the dogs' bowls... I'd I'm I've", "the dogs ' bowls ... I 'd I 'm I 've"),
        ("a\n\tb  c", "a b c"),
        ("", ""),
        ("   ", ""),
        (".", "."),
    ],
)
def test_treebank_tokens(spark, text, expected):
    from riskweave.functions.text import treebank_tokens

    got = spark.createDataFrame([(text,)], "text string").select(treebank_tokens("text").alias("w")).first().w
    assert " ".join(got) == expected


def test_words_at_single_blanks(spark):
    """Every character that parts words does, runs and ends give no words, and no class of characters is split at."""
    texts = [f"{w}a{w}{w}B-c{w}--{w}'d1e2{w}" for w in text.WHITESPACE] + ["", " ", "\u0663x\u0664", "x" * 50, None, "--", "a\u00a0\u2003b"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.filter(text._stripped_words("t"), lambda w: w != "")
    assert frame.filter(~text.tokens("t").eqNullSafe(old)).count() == 0
    assert "translate" in str(text.tokens("t")._jc.toString())
