"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND by every passage.

The index holds, for each term, the items with it and what the term adds to
their score, as a share of the score an item has with itself.  Every passage
of every document is a query.  Upper bounds for each block of items come first,
for all passages of a text at once, from running sums; passages with a block
that may reach the threshold go through the index with WAND, which skips items
and blocks that cannot reach it.  What it finds is verified: enough of the
item's question and of its answer must stand in the passage.

Items are dealt to size classes, so that a passage is as long as the items it
is held against, and to shards that are bounded in items and words.  Tasks
build the indexes, one for each shard, and they are stored.  One at a time is
read and broadcast; the documents are searched with it and the hits written
before the next, so the documents are read once for each shard.
"""

import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import map_rows, small
from riskweave.operators.runtime import free_name, stored

K1, B = 1.2, 0.75
# Share of an item's own score that a passage must reach, and the shares of
# the question's word runs and the answer's words that must stand in it.
THRESHOLD = 0.5
QUESTION, ANSWER = 0.5, 0.5
RUN = 5
BLOCK = 4
# A shard holds at most so many items and words; an item with more words has one of its own.
SHARD_ITEMS, SHARD_WORDS = 2048, 1 << 17
SHORTEST_PASSAGE = 64
KEPT_WORDS = 400_000
# Words of a document that are handled at once.
WORDS_AT_ONCE = 1 << 12
# Rounding of running sums in single precision.
SLACK = 1e-2

EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"
NO_TERM, NO_WORD = -1, -2

HITS = (
    "doc_id long, item_id long, passages long, score double, question double, answer double, "
    "first_word long, last_word long"
)
_INDEXES = "shard int, data binary"


def words_of(text: str) -> list[str]:
    """Lower-case words without marks around them; what has nothing else is no word."""
    return [w for w in (part.strip(EDGES) for part in text.lower().split()) if w]


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer, which is its last sentence or line; one sentence is both."""
    cut = len(text.rstrip())
    body = text[:cut].rstrip(".!?\n ")
    place = max(body.rfind(mark) for mark in (". ", "? ", "! ", "\n"))
    question, answer = words_of(body[: place + 1]), words_of(body[place + 1 :])
    if not question or not answer:
        both = words_of(text)
        return both, both
    return question, answer


def runs(ids: list[int], size: int) -> set[tuple[int, ...]]:
    """All runs of ``size`` words."""
    return set(zip(*(ids[k:] for k in range(size))))


@dataclass
class Index:
    """Items of one shard with their inverted lists; items are numbered from 0."""

    items: list[int] = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[list[int]] = field(default_factory=list)
    shares: list[list[float]] = field(default_factory=list)
    most: np.ndarray | None = None
    blocks: np.ndarray | None = None
    # Length of the runs, which is that of the question if it is shorter, and the runs.
    questions: list[tuple[int, set[tuple[int, ...]]]] = field(default_factory=list)
    answers: list[set[int]] = field(default_factory=list)
    longest: int = 0

    def bound(self) -> None:
        """The highest share of each term in each block, and in all."""
        self.blocks = np.zeros((len(self.terms), (len(self.items) + BLOCK - 1) // BLOCK), dtype=np.float32)
        for t, (postings, shares) in enumerate(zip(self.postings, self.shares)):
            for at, share in zip(postings, shares):
                self.blocks[t, at // BLOCK] = max(self.blocks[t, at // BLOCK], share)
        # A little above, for sums in single precision.
        self.blocks *= np.float32(1.0001)
        self.most = self.blocks.max(axis=1)

    # The dense bounds are made anew where the index is read.
    def __getstate__(self) -> dict:
        return self.__dict__ | {"blocks": None, "most": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.bound()


def build(items: list[tuple[int, str]]) -> Index:
    """Index of items (id, text) that have words."""
    index = Index()
    texts = [(item_id, words_of(text), parts_of(text)) for item_id, text in items]
    n = len(texts)
    mean = sum(len(w) for _, w, _ in texts) / n
    for _, words, _ in texts:
        for word in words:
            index.terms.setdefault(word, len(index.terms))
    counts = []
    for item_id, words, _ in texts:
        own: dict[int, int] = {}
        for word in words:
            own[index.terms[word]] = own.get(index.terms[word], 0) + 1
        counts.append(own)
    df = np.zeros(len(index.terms))
    for own in counts:
        df[list(own)] += 1
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    index.postings = [[] for _ in index.terms]
    index.shares = [[] for _ in index.terms]
    for at, ((item_id, words, (question, answer)), own) in enumerate(zip(texts, counts)):
        norm = K1 * (1 - B + B * len(words) / mean)
        gains = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in own.items()}
        whole = sum(gains.values())
        for t, gain in gains.items():
            index.postings[t].append(at)
            index.shares[t].append(float(gain / whole))
        index.items.append(item_id)
        size = min(RUN, len(question))
        index.questions.append((size, runs([index.terms[w] for w in question], size)))
        index.answers.append({index.terms[w] for w in answer})
        index.longest = max(index.longest, len(words))
    index.bound()
    return index


def wand(index: Index, terms: list[int], threshold: float) -> dict[int, float]:
    """Items whose score for the distinct ``terms`` reaches the threshold, exactly."""
    found: dict[int, float] = {}
    lists = [(index.postings[t], index.shares[t], float(index.most[t]), t) for t in terms if index.postings[t]]
    places = [0] * len(lists)
    # (next item, list) of every list that has not ended, by item.
    heads = sorted((p[0], k) for k, (p, *_) in enumerate(lists))
    while heads:
        bound, pivot = 0.0, None
        for at, (item, k) in enumerate(heads):
            bound += lists[k][2]
            if bound >= threshold:
                pivot = at
                break
        if pivot is None:
            break
        item = heads[pivot][0]
        while pivot + 1 < len(heads) and heads[pivot + 1][0] == item:
            pivot += 1
        ahead = heads[: pivot + 1]
        block = item // BLOCK
        if float(index.blocks[[lists[k][3] for _, k in ahead], block].sum()) < threshold:
            # No item of this block reaches it with these lists: go on behind the block, or where the next list begins.
            target = (block + 1) * BLOCK
            if pivot + 1 < len(heads):
                target = min(target, heads[pivot + 1][0])
            target = max(target, item + 1)
        elif heads[0][0] == item:
            score = sum(lists[k][1][places[k]] for _, k in ahead)
            if score >= threshold:
                found[item] = score
            target = item + 1
        else:
            target = item
        moved = heads[pivot + 1 :]
        for at, k in ahead:
            postings = lists[k][0]
            if at < target:
                places[k] = bisect_left(postings, target, places[k])
            if places[k] < len(postings):
                moved.append((postings[places[k]], k))
        heads = sorted(moved)
    return found


class Terms(dict):
    """Term number of a word as written; NO_TERM if no item has it, NO_WORD for marks alone."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, part: str) -> int:
        word = part.strip(EDGES)
        number = self.terms.get(word, NO_TERM) if word else NO_WORD
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(part) <= 64:
            self[part] = number
        return number


class Searcher:
    """Runs whole texts against one index."""

    def __init__(self, index: Index, threshold: float = THRESHOLD):
        self.index, self.threshold = index, threshold
        self.terms = Terms(index.terms)
        self.size = max(SHORTEST_PASSAGE, index.longest)
        self.step = self.size // 2

    def ids(self, text: str) -> np.ndarray:
        parts = text.lower().split()
        ids = np.fromiter(map(self.terms.__getitem__, parts), dtype=np.int32, count=len(parts))
        return ids[ids != NO_WORD]

    def passages(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(from, to) of the passages whose upper bound reaches the threshold.

        Passages overlap by half, and the last one ends with the text.
        """
        starts = np.arange(0, max(1, len(ids) - self.step), self.step)
        # One passage at least, however long the items are.
        many = max(1, WORDS_AT_ONCE // self.step)
        for at in range(0, len(starts), many):
            part = starts[at : at + many]
            ends = np.minimum(part + self.size, len(ids))
            low = int(part[0])
            own = ids[low : int(ends[-1])]
            places = np.flatnonzero(own >= 0)
            sums = np.zeros((len(places) + 1, self.index.blocks.shape[1]), dtype=np.float32)
            np.cumsum(self.index.blocks[own[places]], axis=0, out=sums[1:])
            first, last = np.searchsorted(places, part - low), np.searchsorted(places, ends - low)
            # A word that comes twice counts twice here, and once in the next bound.
            bounds = (sums[last] - sums[first]).max(axis=1)
            for k in np.flatnonzero(bounds >= self.threshold - SLACK):
                found = np.unique(own[places[first[k] : last[k]]])
                if self.index.blocks[found].sum(axis=0).max() >= self.threshold:
                    yield int(part[k]), int(ends[k])

    def hits(self, text: str) -> list[tuple]:
        """(item_id, passages, score, question, answer, first_word, last_word) of every verified item."""
        ids = self.ids(text)
        best: dict[int, list] = {}
        for start, end in self.passages(ids):
            found = ids[start:end]
            terms = np.unique(found[found >= 0]).tolist()
            for item, score in wand(self.index, terms, self.threshold).items():
                first, last = max(0, start - self.step), min(len(ids), end + self.step)
                around = ids[first:last].tolist()
                (size, questions), answers = self.index.questions[item], self.index.answers[item]
                question = len(questions & runs(around, size)) / len(questions)
                answer = len(answers.intersection(around)) / len(answers)
                if question < QUESTION or answer < ANSWER:
                    continue
                one = best.get(item)
                if one is None:
                    best[item] = [1, score, question, answer, start, end]
                else:
                    one[0] += 1
                    one[1:4] = [max(a, b) for a, b in zip(one[1:4], (score, question, answer))]
                    one[5] = end
        return [(self.index.items[item], *one) for item, one in sorted(best.items())]


@dataclass(frozen=True)
class Shards:
    """Stored indexes (shard, data) of all items; one at a time is read."""

    table: DataFrame
    count: int

    def __iter__(self) -> Iterator[Index]:
        for shard in range(self.count):
            yield pickle.loads(self.table.filter(F.col("shard") == shard).select("data").first().data)


def shards(items: DataFrame, per_shard: int = SHARD_ITEMS, words: int = SHARD_WORDS) -> Shards:
    """Indexes of ``items`` (item_id, text), by size class and then by number, each built in a task and stored.

    A shard has at most ``per_shard`` items and ``words`` words, or one longer
    item.  The driver sees how many items each range of the sorted items has of
    each size class, and no item.  Items without words, and null ones, can be
    found nowhere and are left out; repeated ones stay.
    """
    spark = items.sparkSession

    def sized(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            sizes = [(item_id, text, len(words_of(text))) for item_id, text in batch]
            # An item of class c has at most 2 ** c words.
            yield [(i, t, (max(n, SHORTEST_PASSAGE) - 1).bit_length()) for i, t, n in sizes if n]

    rows = items.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL AND item_id IS NOT NULL")
    rows = map_rows(rows, sized, "item_id long, text string, class int")
    rows = rows.repartitionByRange("class", "item_id", "text").withColumn("range", F.spark_partition_id())
    rows = stored(rows)
    places, begin, last = [], 0, None
    for row in sorted(rows.groupBy("class", "range").count().collect()):
        size = row["class"]
        if size != last:
            if last is not None:
                begin += -(-before // most)
            before, last, most = 0, size, max(1, min(per_shard, words >> size))
        places.append((size, row["range"], before, most, begin))
        before += row["count"]
    if not places:
        return Shards(spark.createDataFrame([], _INDEXES), 0)
    count = begin - (-before // most)
    where = spark.createDataFrame(places, "class int, range int, before long, most long, begin long")
    order = Window.partitionBy("class", "range").orderBy("item_id", "text")
    rows = rows.withColumn("at", F.row_number().over(order)).join(F.broadcast(where), ["class", "range"])
    shard = F.col("begin") + F.floor((F.col("before") + F.col("at") - 1) / F.col("most"))
    rows = rows.select(shard.cast("int").alias("shard"), "item_id", "text")
    return Shards(stored(rows.groupBy("shard").applyInArrow(_indexed, _INDEXES)), count)


def _indexed(rows: pa.Table) -> pa.Table:
    """The index of one shard."""
    held = sorted(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist()))
    data = pickle.dumps(build(held), protocol=pickle.HIGHEST_PROTOCOL)
    return pa.table({"shard": rows["shard"][:1].cast(pa.int32()), "data": pa.array([data], pa.binary())})


def _each_shard(texts: DataFrame, items: DataFrame, columns: str, function: Callable) -> Iterator[DataFrame]:
    """What ``function`` makes of the texts under every index: written, and the index given up, before the next is read."""
    for index in shards(items):
        share = texts.sparkSession.sparkContext.broadcast(index)
        found = stored(map_rows(texts, function(share), columns))
        share.destroy()
        yield found


def search(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified hits of ``items`` (item_id, text) in ``documents`` (doc_id, text).

    One row per document row and item: how many passages hit, the highest
    score, the highest shares of the question's word runs and the answer's
    words, and the places of the first and last word of the passages.  Null
    and empty texts have no hits; null ids and repeated rows keep theirs;
    further columns are ignored.  Without items there are no rows.
    """
    texts = documents.select("doc_id", "text").filter("text IS NOT NULL AND text != ''")
    hits = _each_shard(texts, items, HITS, lambda index: _searching(index, threshold))
    return reduce(DataFrame.unionByName, hits, documents.sparkSession.createDataFrame([], HITS))


def _searching(index, threshold: float):
    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        searcher = Searcher(index.value, threshold)
        for batch in batches:
            yield [(doc_id, *hit) for doc_id, text in batch for hit in searcher.hits(text)]

    return run


def clean(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` in which no item is found, with all their columns.

    Texts with an item are known by their digests, so rows with null or
    repeated ids are told apart.
    """
    texts = documents.select("text").filter("text IS NOT NULL AND text != ''")
    digests = _each_shard(texts, items, "_digest string", lambda index: _digests(index, threshold))
    found = reduce(DataFrame.unionByName, digests, documents.sparkSession.createDataFrame([], "_digest string"))
    found = small(stored(found.distinct().toDF(name := free_name("_digest", documents))))
    return documents.join(found, F.sha2("text", 256) == F.col(name), "left_anti")


def _digests(index, threshold: float):
    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        searcher = Searcher(index.value, threshold)
        for batch in batches:
            yield [(sha256(text.encode()).hexdigest(),) for (text,) in batch if searcher.hits(text)]

    return run
