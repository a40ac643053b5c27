"""Free text to words, as native expressions on whole texts (no Python per row)."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation characters, and the characters that
# count as white space.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
DIGITS = r"\p{Nd}+"

# The common public list of English stop words (179 entries).
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()


# The treebank's conventions for words, as rewritings in this order, and words that are two.
TREEBANK_RULES = [
    # quotes that open
    (r'^"', "`` "),
    (r"``", " `` "),
    (r"([ (\[{<])(\"|'')", r"\1 `` "),
    # punctuation; a full stop only at the end of the text
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])\z", r" \1 "),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&])", r" \1 "),
    (r"([^.])(\.)([\])}>\"']*)[ \t\n\f\r]*\z", r"\1 \2\3 "),
    (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    # brackets and dashes
    (r"([\]\[(){}<>])", r" \1 "),
    (r"--", " -- "),
    # quotes that close, and what follows an apostrophe
    (r"''", " '' "),
    (r'"', " '' "),
    (r"([^' ])('[sSmMdD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
]
TREEBANK_PAIRS = [
    ("can", "not"),
    ("d", "'ye"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("more", "'n"),
    ("wan", "na"),
    ("'t", "is"),
    ("'t", "was"),
]
TREEBANK_SPACE = r"[ \t\n\x0b\f\r]+"


def treebank_tokens(text) -> Column:
    """Words of a text by the treebank's conventions, in order and with their case.

    Contractions fall apart (``do n't``), double quotes become `` and '', marks and
    brackets stand by themselves, numbers keep their commas.  A full stop is a
    word only at the end of the text: texts are not cut into sentences.
    """
    text = F.col(text) if isinstance(text, str) else text
    # Rules on what ends a word see a blank behind the last one.
    now = F.concat(F.regexp_replace(text, TREEBANK_SPACE, " "), F.lit(" "))
    now = F.regexp_replace(now, r" +\z", "")
    for at, (pattern, put) in enumerate(TREEBANK_RULES):
        if at == TREEBANK_PADDED:
            now = F.concat(F.lit(" "), now, F.lit(" "))
        now = F.regexp_replace(now, pattern, put.replace("\\", "$"))
    words = F.filter(F.split(now, " +"), lambda w: w != "")
    pairs = F.create_map(*(F.lit(x) for a, b in TREEBANK_PAIRS for x in (a + b, len(a))))

    def parted(w: Column) -> Column:
        first = F.try_element_at(pairs, F.lower(w))
        return F.when(first.isNull(), F.array(w)).otherwise(
            F.array(F.substring(w, F.lit(1), first), F.substring(w, first + 1, F.length(w)))
        )

    return F.flatten(F.transform(words, parted))


# From this rule on the text has a blank at both ends.
TREEBANK_PADDED = 12


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain reference would be copied into every lambda that uses it and then
    be evaluated again for each element.
    """
    return F.transform(F.array(value), body)[0]


def _stripped_words(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(F.lower(text), DIGITS, " ")
    words = F.split(F.btrim(plain, F.lit(WHITESPACE)), f"[{WHITESPACE}]+")
    return F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION)))


def _spaced_words(text) -> Column:
    """The same but for empty words: a split at one blank is about twice as fast as one at a class of characters."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(F.lower(text), DIGITS, " ")
    words = F.split(F.translate(plain, WHITESPACE, " " * len(WHITESPACE)), " ")
    return F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION)))


def normalize_text(text) -> Column:
    """Lower-case text without digits and without punctuation around words.

    Runs of digits become one space; words are what lies between white space;
    punctuation goes from both ends of a word but stays inside it (``x-ray``).
    """
    return F.array_join(_stripped_words(text), " ")


def tokens(text, normalized: bool = False, separator: str | None = None) -> Column:
    """Words of a text in order, without empty ones.

    ``normalized`` says that the text has been through :func:`normalize_text`.
    ``separator`` is a regular expression for what parts words, by default
    white space.  With look-around it also cuts inside words: ``\\s+|(?='s\\b)``
    makes two words of ``patient's``.
    """
    if normalized or separator:
        plain = normalize_text(text) if not normalized else F.col(text) if isinstance(text, str) else text
        words = F.split(plain, separator or f"[{WHITESPACE}]+")
    else:
        words = _spaced_words(text)
    return F.filter(words, lambda w: w != "")


def word_bag(words: Column) -> Column:
    """``array<struct<word, cnt>>`` of a token array, counted inside the row.

    Sorting the tokens puts equal ones side by side, so the starts of the runs
    give both the words and their counts.  The bag of a note therefore needs no
    shuffle, whatever the number of notes.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(ordered, lambda _, i: i),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return _bind(
            starts,
            lambda begin: F.transform(
                begin,
                lambda at, k: F.struct(
                    F.get(ordered, at).alias("word"),
                    (F.coalesce(F.get(begin, k + 1), F.size(ordered)) - at).cast("bigint").alias("cnt"),
                ),
            ),
        )

    return _bind(F.sort_array(words), runs)
