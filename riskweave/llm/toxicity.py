"""Toxicity by noisy-channel deobfuscation.

Insults are written as "1d10t", "i.d.i.o.t" or "idiooot" to slip past word
lists.  A span that looks like that becomes a lattice: each character may stand
for letters, for the boundary of a word, or for nothing.  A Viterbi search
finds the reading with the lowest cost under that channel and a character
language model counted over all documents.  The restored words are scored by
the log-odds of their beginnings in labelled documents, and a logistic model
over the highest word scores of a document gives its score.
"""

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import map_column, map_rows
from riskweave.operators.runtime import stored

# Labelled rows the word scores and the logistic model are fitted on.
FIT_ROWS = 20_000
# A word beginning counts from this many toxic documents on.
MIN_TOXIC = 3
SHORTEST, LONGEST = 4, 7
HIT = 1.5
# Words kept with their score in each worker; beyond it the store starts anew.
KEPT_WORDS = 400_000
# Characters of a text that are counted at once.
SLICE = 1 << 20

# Letters are 1 to 26, everything between words is 0; the model reads three symbols back.
SYMBOLS, ORDER = 27, 4
GRAMS = SYMBOLS**ORDER
BLANK = " "
# What a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e",
}
SEPARATORS = " ._*-"
JUNK = ".,!?:;#$%&*|\"'()[]{}<>-_"
# Costs of the channel, in nats.
STANDS_FOR, DOUBLED, REPEATED, JOINED, BROKEN = 1.0, 2.0, 0.5, 0.3, 1.0

_TRIPLED = re.compile(r"(.)\1\1")
_LEETED = re.compile(r"[^\W\d_][^\s]*[0-9@$!|+(€][^\s]*[^\W\d_]|[0-9@$!|+(€][^\W\d_]{2}|[^\W\d_]{2}[0-9@$]$")
_SPELLED = re.compile(r"\w(?:[._*-]+\w){2,}$")


def folded(character: str) -> int:
    """1 to 26 for a letter, whatever its case and accents; else 0."""
    base = unicodedata.normalize("NFKD", character.lower())[:1]
    return ord(base) - 96 if "a" <= base <= "z" else 0


# Up to this code point the symbols come from a table.
TABLE_END = 0x250
_TABLE = np.array([folded(chr(c)) for c in range(TABLE_END)] + [0], dtype=np.int64)


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _TABLE[np.minimum(codes, TABLE_END)]


def character_counts(documents: DataFrame) -> DataFrame:
    """(gram, n): how often each run of four symbols occurs in the texts of ``documents``.

    A task counts into one array and returns what is not zero, so the shuffle
    holds at most ``GRAMS`` rows for a task.  Null texts count as empty.
    """

    def count(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        total = np.zeros(GRAMS, dtype=np.int64)
        edge = np.zeros(ORDER - 1, dtype=np.int64)
        for batch in batches:
            own = []
            for (text,) in batch:
                own.append(edge)
                own += [symbols(text[at : at + SLICE]) for at in range(0, len(text or ""), SLICE)]
            if not own:
                continue
            line = np.concatenate([*own, edge])
            codes = line[: -ORDER + 1].copy()
            for k in range(1, ORDER):
                codes *= SYMBOLS
                codes += line[k : len(line) - ORDER + 1 + k]
            total += np.bincount(codes, minlength=GRAMS)
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 10_000):
            part = seen[at : at + 10_000]
            yield list(zip(part.tolist(), total[part].tolist()))

    counts = map_rows(documents.select("text"), count, "gram int, n long")
    return counts.groupBy("gram").agg(F.sum("n").alias("n"))


def character_costs(counts: DataFrame) -> np.ndarray:
    """Negative log probability of a symbol behind three others, smoothed by shorter contexts.

    The array has ``GRAMS`` entries whatever the input, and so has what the
    driver reads.
    """
    whole = np.zeros(GRAMS)
    for row in counts.toLocalIterator():
        whole[row.gram] = row.n
    shorter = [whole.reshape((SYMBOLS,) * ORDER)]
    for _ in range(ORDER - 1):
        shorter.append(shorter[-1].sum(axis=0))
    chance = np.full(SYMBOLS, 1 / SYMBOLS)
    for grams in reversed(shorter):
        weight = float(SYMBOLS)
        chance = (grams + weight * chance) / (grams.sum(axis=-1, keepdims=True) + weight)
    return -np.log(chance).ravel().astype(np.float32)


def options(observed: str) -> Iterator[list[tuple[int | None, float]]]:
    """For each character the symbols it may stand for, None for nothing, with costs."""
    last = ""
    for at, c in enumerate(observed):
        letter = folded(c)
        # A doubled letter is usual, a tripled one is not.
        again = REPEATED if c * 3 in observed[max(0, at - 2) : at + 3] else DOUBLED
        if letter:
            found = [(letter, 0.0)]
            if c == last:
                found.append((None, again))
        elif c in LEET:
            found = [(ord(x) - 96, STANDS_FOR) for x in LEET[c]] + [(0, STANDS_FOR + BROKEN)]
            if c == last:
                found.append((None, again))
        elif c in SEPARATORS:
            found = [(0, BROKEN), (None, JOINED)]
        else:
            found = [(0, 0.0)]
        yield found
        last = c


def restored(observed: str, costs: np.ndarray) -> str:
    """The reading of a span with the lowest cost: words of a-z between blanks."""
    keep = SYMBOLS ** (ORDER - 2)
    # The state is the last three symbols; the value its cost and the symbols that led there, as a chain.
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for choices in [*options(observed), [(0, 0.0)]]:
        reached: dict[int, tuple[float, tuple | None]] = {}
        for state, (cost, chain) in states.items():
            for symbol, extra in choices:
                if symbol is None:
                    to, total, link = state, cost + extra, chain
                else:
                    to = state % keep * SYMBOLS + symbol
                    total = cost + extra + float(costs[state * SYMBOLS + symbol])
                    link = (symbol, chain)
                if to not in reached or total < reached[to][0]:
                    reached[to] = (total, link)
        states = reached
    chain = min(states.values(), key=lambda x: x[0])[1]
    found = []
    while chain is not None:
        found.append(chr(chain[0] + 96) if chain[0] else BLANK)
        chain = chain[1]
    return "".join(reversed(found)).strip(BLANK)


def beginnings(word: str) -> list[str]:
    """The word with its end, and its beginnings."""
    return [word + "$", *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


class Reader:
    """Words of a text, with what obfuscated ones are restored to."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs

    def forms(self, word: str) -> list[str]:
        """A lower-case word without marks around it, and the words it may stand for."""
        plain = word.strip(JUNK)
        found = [plain] if plain else []
        if _TRIPLED.search(word) or _LEETED.search(word) or _SPELLED.search(plain):
            found += restored(word.strip(".,?:;#%&\"'<>"), self.costs).split()
            # Marks behind a word are more often marks than letters.
            if plain != word and plain:
                found += restored(plain, self.costs).split()
        return found

    def spelled(self, words: list[str]) -> Iterator[str]:
        """Words restored from runs of three or more single characters."""
        run: list[str] = []
        for word in [*words, "  "]:
            if len(word) == 1:
                run.append(word)
                continue
            if len(run) > 2:
                yield from restored(BLANK.join(run), self.costs).split()
            run = []


class Scores(dict):
    """Score of a word as written, looked up or worked out."""

    def __init__(self, reader: Reader, odds: dict[str, float]):
        super().__init__()
        self.reader, self.odds = reader, odds

    def form(self, word: str) -> float:
        return max((self.odds.get(b, 0.0) for b in beginnings(word)), default=0.0)

    def __missing__(self, word: str) -> float:
        score = max((self.form(f) for f in self.reader.forms(word)), default=0.0)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = score
        return score

    def features(self, text: str | None) -> list[float]:
        """1, the three highest word scores, and how many words and what share of them are hits."""
        words = (text or "").lower().split()
        values = list(map(self.__getitem__, words))
        if any(len(a) == 1 and len(b) == 1 for a, b in zip(words, words[1:])):
            values += [self.form(w) for w in self.reader.spelled(words)]
        scores = np.array(values + [0.0, 0.0, 0.0], dtype=np.float32)
        top = np.sort(np.partition(scores, len(scores) - 3)[-3:])[::-1]
        hits = int((scores > HIT).sum())
        return [1.0, *top.tolist(), float(np.log1p(hits)), hits / len(values) if values else 0.0]


N_FEATURES = 6


@dataclass(frozen=True)
class Model:
    costs: np.ndarray
    odds: dict[str, float]
    weights: np.ndarray


def _half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2)).cast("int")


def fit(documents: DataFrame, labels: DataFrame, train: Column, fit_rows: int = FIT_ROWS) -> Model:
    """Model from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Only labelled rows for which ``train`` holds are used, at most
    ``fit_rows`` of them, chosen by a hash of the id; null labels and ids are
    left out, and of several labels of a document the highest counts.  The
    character model is counted over all documents.  Word scores come from one
    half of the sample while the logistic model is fitted on the other, and
    from both halves in the end.  Without labels of both kinds every score is
    the smoothed share of toxic labels.
    """
    spark = documents.sparkSession
    costs = character_costs(character_counts(documents))
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(train)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # At most fit_rows rows of two numbers.
    sample = stored(
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select(_half(F.col("doc_id")).alias("half"), F.col("toxic").cast("int").alias("toxic"), "text")
    )
    sizes = {(r.half, r.toxic): r.n for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    share = spark.sparkContext.broadcast(costs)
    toxic = _beginning_counts(sample.filter("toxic = 1"), share, None)
    toxic = toxic.groupBy("word").agg(
        *[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)]
    )
    ours = {r.word: (r.n0, r.n1) for r in toxic.filter(f"n0 + n1 >= {MIN_TOXIC}").toLocalIterator()}
    clean = _beginning_counts(sample.filter("toxic = 0"), share, spark.sparkContext.broadcast(frozenset(ours)))
    clean = clean.groupBy("word").agg(
        *[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)]
    )
    theirs = {r.word: (r.n0, r.n1) for r in clean.toLocalIterator()}

    def odds(halves: tuple[int, ...]) -> dict[str, float]:
        a = sum(sizes.get((h, 1), 0) for h in halves)
        b = sum(sizes.get((h, 0), 0) for h in halves)
        if not a or not b:
            return {}
        found = {}
        for word, counts in ours.items():
            p = sum(counts[h] for h in halves)
            n = sum(theirs.get(word, (0, 0))[h] for h in halves)
            if p >= MIN_TOXIC:
                value = log((p + a / (a + b)) / (n + b / (a + b)) * b / a)
                if value > 0:
                    found[word] = value
        return found

    rows = _features(sample.filter("half = 1"), spark.sparkContext.broadcast((costs, odds((0,)))))
    x, y = _matrix(rows)
    every = np.array([sum(n for (_, t), n in sizes.items() if t == k) for k in (0, 1)], dtype=float)
    return Model(costs, odds((0, 1)), logistic(x, y, every))


def _beginning_counts(sample: DataFrame, costs, wanted) -> DataFrame:
    """(half, word, n): documents of the bounded sample that hold a word beginning."""

    def count(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        reader, only = Reader(costs.value), None if wanted is None else wanted.value
        total: Counter = Counter()
        for batch in batches:
            for half, _, text in batch:
                words = (text or "").lower().split()
                forms = {f for w in set(words) for f in reader.forms(w)} | set(reader.spelled(words))
                found = {b for f in forms for b in beginnings(f)}
                total.update((half, b) for b in (found if only is None else found & only))
        yield [(half, word, n) for (half, word), n in total.items()]

    return map_rows(sample, count, "half int, word string, n long")


def _features(sample: DataFrame, parts) -> DataFrame:
    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        costs, odds = parts.value
        scores = Scores(Reader(costs), odds)
        for batch in batches:
            yield [(toxic, np.array(scores.features(text)).tobytes()) for _, toxic, text in batch]

    return map_rows(sample, run, "toxic int, features binary")


def _matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, which has at most as many rows as the parameter says."""
    found = rows.collect()
    x = np.array([np.frombuffer(r.features) for r in found]).reshape(-1, N_FEATURES)
    return x, np.array([r.toxic for r in found], dtype=float)


def logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method; with one kind of label only, the smoothed log-odds of the labels."""
    weights = np.zeros(N_FEATURES)
    if len(set(y.tolist())) < 2:
        weights[0] = log((counts[1] + 0.5) / (counts[0] + 1.5))
        return weights
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - chance) - ridge * weights
        curve = (x * (chance * (1 - chance))[:, None]).T @ x + ridge * np.eye(N_FEATURES)
        step = np.linalg.solve(curve, slope)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``documents`` (doc_id, text), without a shuffle.

    The score is between 0 and 1; empty and null texts have no hits and the
    score that follows.  Repeated rows and null ids keep their rows.
    """
    share = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        chance = chances(share.value)
        for batch in batches:
            found = [(doc_id, chance(text)) for doc_id, text in batch]
            yield [(doc_id, value, int(value >= 0.5)) for doc_id, value in found]

    return map_rows(documents.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def chances(model: Model) -> Callable[[str | None], float]:
    scores = Scores(Reader(model.costs), model.odds)
    weights = model.weights.tolist()

    def chance(text: str | None) -> float:
        value = sum(w * f for w, f in zip(weights, scores.features(text)))
        return 1 / (1 + exp(-max(-700.0, min(700.0, value))))

    return chance


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` whose text is not predicted to be toxic, with all their columns."""
    share = documents.sparkSession.sparkContext.broadcast(model)

    def start():
        chance = chances(share.value)
        return lambda texts: [chance(text) < 0.5 for text in texts]

    return map_column(documents, "text", start, keep=True)
