"""Bags of words and tf-idf."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scoring import tfidf
from riskweave.functions.text import ENGLISH_STOP_WORDS, normalize_text, tokens, word_bag
from riskweave.operators.runtime import HOT_MIN_ROWS, LISTED_ROWS, hot_keys, spread_join, stored


# Endings of nouns in the plural, and what stands there in the singular.
NOUN_ENDINGS = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]
# A map is searched from its start, so up to so many lemmas are looked up in one; more are joined.
FEW_LEMMAS = 32


def normalized_notes(notes: DataFrame) -> DataFrame:
    return notes.withColumn("text", normalize_text("text"))


def note_tokens(notes: DataFrame, *keep: str) -> DataFrame:
    """One row per token, in columns ``keep`` and ``word``."""
    return exploded_tokens(notes, tokens("text"), *keep)


def exploded_tokens(notes: DataFrame, words: Column, *keep: str) -> DataFrame:
    """One row per element of ``words``, none of which is null.

    From a plain explode Spark infers a filter on the size of the array, and
    works the whole array out again for it; an outer one makes it once.
    """
    return notes.select(*keep, F.explode_outer(words).alias("word")).filter(F.col("word").isNotNull())


def word_sizes(words: DataFrame) -> DataFrame:
    """(word, n): the number of rows of each word."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def lemmatize(
    words: DataFrame, lemmas: DataFrame, min_rows: int | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """``word`` replaced by its lemma where the table (form, lemma) has one.

    Forms must be unique in the table.  It is broadcast only while Spark finds
    it small; with ``min_rows`` both sides are shuffled, and words with more
    rows are cut into parts; ``sizes`` are the :func:`word_sizes` if the caller
    has them already.
    """
    forms = lemmas.select(F.col("form").alias("word"), "lemma")
    if min_rows is None:
        found = words.join(forms, "word", "left")
    else:
        salt = F.xxhash64(*words.columns)
        sizes = word_sizes(words) if sizes is None else sizes
        found = spread_join(words, forms, "word", hot_keys(sizes, "word", "n", min_rows), salt, "left")
    return found.withColumn("word", F.coalesce("lemma", "word")).select(words.columns)


def noun_lemmas(words: DataFrame, nouns: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(form, lemma) of the distinct values of ``word`` that are not their own lemma.

    A form in ``exceptions`` (form, lemma) has that lemma if it is a noun.  From others
    the endings of ``NOUN_ENDINGS`` are detached, and what is in ``nouns``, a
    table with one column, is a lemma, as is the form itself; of several the
    shortest, then the first by name, counts.  While there is none, endings are
    detached from what came out.  Words without a lemma stay as they are.

    Candidates of distinct words meet the nouns, never those of all tokens.
    """
    # Written, as every round looks candidates up in it.
    known = stored(nouns.select(F.col(nouns.columns[0]).alias("candidate")).distinct())
    forms = stored(words.select(F.col("word").alias("form")).filter("form IS NOT NULL").distinct())
    if exceptions is not None:
        # An irregular form is not detached from, whether or not its lemma is a noun.
        listed = exceptions.select("form", F.col("lemma").alias("candidate"))
        irregular = listed.unionByName(listed.select("form", F.col("form").alias("candidate"))).distinct()
        irregular = irregular.join(forms, "form", "left_semi")
        regular = forms.join(listed.select("form").distinct(), "form", "left_anti")
    else:
        irregular, regular = None, forms
    shortest = F.min(F.struct(F.length("candidate"), "candidate"))["candidate"].alias("lemma")

    def chosen(candidates: DataFrame) -> DataFrame:
        return candidates.join(known, "candidate", "left_semi").groupBy("form").agg(shortest)

    found = [chosen(irregular)] if irregular is not None else []
    here = regular.select("form", F.col("form").alias("stem"))
    first = True
    while True:
        detached = stored(here.select("form", F.explode(_detached("stem")).alias("candidate")).distinct())
        tried = detached.unionByName(regular.select("form", F.col("form").alias("candidate"))).distinct() if first else detached
        done = stored(chosen(tried))
        found.append(done)
        # Every ending that may come off again is longer than what replaces it, so this ends with the longest word.
        here = stored(detached.join(done, "form", "left_anti").select("form", F.col("candidate").alias("stem")))
        first = False
        if here.isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.filter("form != lemma")


def _detached(stem: str) -> Column:
    """What is left of a word without each ending that it has."""
    word = F.col(stem)
    cut = [
        F.when(word.endswith(old), F.concat(F.substring(word, F.lit(1), F.length(word) - len(old)), F.lit(new)))
        for old, new in NOUN_ENDINGS
    ]
    return F.array_compact(F.array(*cut))


def lemma_table(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """(form, lemma) from a short list; a dictionary comes as a table instead."""
    rows = [F.struct(F.lit(form).alias("form"), F.lit(lemma).alias("lemma")) for form, lemma in pairs]
    return spark.range(1).select(F.inline(F.array(*rows)))


def remove_stop_words(
    words: DataFrame, stop: DataFrame | Iterable[str] = ENGLISH_STOP_WORDS, min_rows: int | None = None
) -> DataFrame:
    """Rows whose word is not a stop word, given as a list or as the first column of a table.

    With ``min_rows`` both tables are shuffled, and words with more rows are cut into parts.
    """
    if isinstance(stop, DataFrame):
        stop = stop.select(F.col(stop.columns[0]).alias("word")).distinct()
        if min_rows is None:
            return words.join(stop, "word", "left_anti").select(words.columns)
        hot = hot_keys(word_sizes(words), "word", "n", min_rows)
        return spread_join(words, stop, "word", hot, F.xxhash64(*words.columns), "left_anti").select(words.columns)
    return words.filter(~F.col("word").isin(list(stop)))


def bagged(notes: DataFrame, separator: str | None = None) -> DataFrame:
    """Notes with the counts of their words in place of the text, counted inside the row without a shuffle."""
    return notes.withColumn("bag", word_bag(tokens("text", separator=separator))).drop("text")


def _clean_bags(notes, lemmas, stop, separator, keep) -> DataFrame:
    """Words with counts, lemmatised, then without stop words; lemmas may repeat in a note.

    Notes that are :func:`bagged` already are taken as they are.
    """
    bags = notes if "bag" in notes.columns else bagged(notes, separator)
    # As with exploded_tokens: outer, so that the bag is made once.
    words = bags.select(*keep, F.inline_outer("bag")).filter(F.col("word").isNotNull())
    if lemmas is not None:
        words = lemmatize(words, lemmas)
    if stop is not None:
        words = remove_stop_words(words, stop)
    return words


def clean_words(
    notes: DataFrame, lemmas: DataFrame | None = None, stop: DataFrame | Iterable[str] | None = ENGLISH_STOP_WORDS
) -> DataFrame:
    """(word, cnt) of every note, lemmatised and without stop words; a word comes at least once for a note."""
    return _clean_bags(notes, lemmas, stop, None, [])


def note_word_counts(
    notes: DataFrame,
    lemmas: DataFrame | None = None,
    stop: DataFrame | Iterable[str] | None = ENGLISH_STOP_WORDS,
    separator: str | None = None,
) -> DataFrame:
    """(note_id, subject_id, event_date, word, cnt).

    Words are counted inside each note first, so lemmas and stop words meet
    every word of a note once.  Only lemmas make a shuffle necessary, because
    two forms of a word may become one.  A table of a few lemmas is met before
    the words are counted, and then only notes that come several times are
    shuffled, as their counts are added up.
    """
    keep = ["note_id", "subject_id", "event_date"]
    known = None if lemmas is None or "bag" in notes.columns else _few_lemmas(lemmas)
    if known is None:
        words = _clean_bags(notes, lemmas, stop, separator, keep)
        return words if lemmas is None else _summed(words, keep)

    def counted(some: DataFrame) -> DataFrame:
        # One lookup in a constant map for a word, as often as it comes.
        forms = F.transform(tokens("text", separator=separator), lambda w: F.coalesce(F.try_element_at(known, w), w))
        return _clean_bags(some.withColumn("bag", word_bag(forms)).drop("text"), None, stop, separator, keep)

    again = stored(notes.groupBy(*keep).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    listed = again.limit(LISTED_ROWS + 1).count()
    if listed == 0:
        return counted(notes)
    if listed > LISTED_ROWS:
        return _summed(counted(notes), keep)
    # A null id is a key like any other.
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in keep]
    again = F.broadcast(again.select(*(F.col(c).alias(f"_{c}") for c in keep)))
    once = counted(notes.join(again, same, "left_anti"))
    return once.unionByName(_summed(counted(notes.join(again, same, "left_semi")), keep))


def _summed(words: DataFrame, keep: list[str]) -> DataFrame:
    return words.groupBy(*keep, "word").agg(F.sum("cnt").alias("cnt"))


def _few_lemmas(lemmas: DataFrame) -> Column | None:
    """A table of at most ``FEW_LEMMAS`` different forms as a constant map; None for any other."""
    rows = lemmas.select("form", "lemma").filter("form IS NOT NULL").limit(FEW_LEMMAS + 1).collect()
    if not 0 < len(rows) <= FEW_LEMMAS or len({r.form for r in rows}) < len(rows):
        return None
    return F.create_map(*(F.lit(x).cast("string") for r in rows for x in (r.form, r.lemma)))


def entity_word_counts(word_counts: DataFrame) -> DataFrame:
    """Total count per entity and word over all its notes."""
    return word_counts.groupBy("subject_id", "word").agg(F.sum("cnt").alias("cnt"))


def entity_bags(
    notes: DataFrame,
    lemmas: DataFrame | None = None,
    stop: DataFrame | Iterable[str] | None = ENGLISH_STOP_WORDS,
    separator: str | None = None,
) -> DataFrame:
    """:func:`entity_word_counts` straight from notes, with one shuffle of counts."""
    return entity_word_counts(_clean_bags(notes, lemmas, stop, separator, ["subject_id"]))


def entity_term_counts(counts: DataFrame) -> DataFrame:
    """Number of distinct words, and of tokens, per entity."""
    return counts.groupBy("subject_id").agg(
        F.count("cnt").alias("term_count"), F.sum("cnt").alias("token_count")
    )


def document_frequencies(counts: DataFrame) -> DataFrame:
    """Number of entities per word."""
    return counts.groupBy("word").agg(F.count("cnt").alias("doc_freq"))


def corpus_size(counts: DataFrame) -> DataFrame:
    """One row: entities with a word, and words."""
    return counts.agg(
        F.countDistinct("subject_id").alias("n_entities"), F.countDistinct("word").alias("n_words")
    )


# What the count of a word is divided by.
NORMS = {"distinct_terms": "term_count", "total_tokens": "token_count"}


def entity_tfidf(
    counts: DataFrame, norm: str = "distinct_terms", min_rows: int = HOT_MIN_ROWS, owners: DataFrame | None = None
) -> DataFrame:
    """(subject_id, word, cnt, term_count, doc_freq, tfidf) from counts per entity and word.

    ``counts`` is used four times here.  Every use keeps its ``cnt``, so the
    shuffle that makes ``counts`` is the same in all of them and runs once.

    With ``owners`` (subject_id, owner) there is a column ``owner`` too, and a
    row for each owner of an entity; they meet the entities, not the scores.
    """
    terms = entity_term_counts(counts)
    frequencies = document_frequencies(counts)
    documents = terms.agg(F.count_if(F.col("token_count") > 0)).scalar()
    salt = F.xxhash64("word", "subject_id")
    met, kept = (terms, []) if owners is None else (terms.join(owners, "subject_id"), ["owner"])
    joined = spread_join(counts, met, "subject_id", hot_keys(terms, "subject_id", "term_count", min_rows), salt)
    joined = spread_join(joined, frequencies, "word", hot_keys(frequencies, "word", "doc_freq", min_rows), salt)
    return joined.select(
        "subject_id",
        "word",
        "cnt",
        "term_count",
        "doc_freq",
        tfidf("cnt", NORMS[norm], documents, "doc_freq").alias("tfidf"),
        *kept,
    )
