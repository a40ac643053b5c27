"""N-gram Jaccard join by partitions of the universe and the pigeonhole principle.

A text is the set of its word shingles, as 64-bit hashes.  Sets of similar
size form a band.  In a band, two sets that link differ in at most H hashes,
so of H + 1 segments of the hash range at least one is equal in both; a
signature is the sum over a segment.  Sets of neighbouring bands meet in the
signatures of the larger band.  Empty segments say little, so a band has some
segments to spare, and a set with no more empty ones than that has signatures
of the others only.

The sets with one signature are a list.  First every set is held against the
smallest one it shares a list with, so that copies of one text hang together.
Lists whose sets are then still in several components give more pairs of
different components: short ones all, long ones those with a pivot.  If a long
list is in several components even then, the segments of its sets are
allocated anew by cost: a segment may count for nothing (level 0), be looked
up as it is (1), or be looked up with its one-deletion neighbourhood (2, it
may then differ in one hash).  Levels that sum up to H + 1 find every link,
and each set takes the levels that meet the fewest others.

Candidates whose sizes or bit parities rule a link out are left.  The others
are held against each other by sketches, the first 16 bits of every hash: sets
differ in at least as many hashes as their sketches.  Only those that may link
even then are verified on the whole sets, which are made anew from the texts
of these few.  Copies, sets that are equal, are one class from the start.
"""

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil, exp, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import map_rows, small
from riskweave.llm.components import connected
from riskweave.operators.runtime import hot_keys, release, spread_join, stored

# Words kept with their hash in a task; beyond it the store starts anew.  Most rare words never come again, and a worker
# that goes on to other work shouldn't hold them.
KEPT_WORDS = 100_000
# Lists up to this length give all pairs.
SHORT_LIST = 8
PIVOT_ROUNDS = 1
# Parities that candidates are held against, a power of two: sets of up to about a thousand shingles
# that have little in common differ in more of them than links may.
PARITY_WORDS = 8
PARITIES = [f"p{k}" for k in range(PARITY_WORDS)]
# Pairs with one set from which they are dealt to several tasks.
HOT_PAIRS = 1000
# Sizes of a band grow by this factor.
BAND = 1.5

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
# Signatures are counted and listed in this many slices of their range, one after the other, so that no more than
# a slice of them is being shuffled at a time.
SLICES = 8
_SLICES = [f"signatures{k}" for k in range(SLICES)]
_BITS = ", ".join(f"{p} long" for p in PARITIES)
_SETS = ", ".join(
    ["doc_id long, n int, c1 long, c2 long", _BITS, "sketch binary", *(f"{name} array<long>" for name in _SLICES)]
)
# Values of the parts of hashes that a sketch holds.
SKETCH_VALUES = 1 << 16


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Words(dict):
    """Hash of a word, looked up or worked out."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_words = Words()


def forget_words() -> None:
    """Empties the store of a worker.  A function of its own: the store's name in a task's closure would be a copy."""
    _words.clear()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of fewer words the whole sequence is one."""
    # Bytes: only A-Z get lower case, and words part at blanks and the characters 9 to 13.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    values = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = mixed(total) * _ODD[0] + values[k : k + len(total)]
    return np.unique(mixed(total))


def parities(hashes: np.ndarray) -> list[int]:
    """Words of 64 bits, each bit the parity of the hashes that fall on it.

    A hash that one of two sets has turns one bit, so the sets differ in at
    least as many hashes as their bits.
    """
    bits = 64 * PARITY_WORDS
    counts = np.bincount((mixed(hashes + _ODD[0]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return _signed(np.packbits(counts.astype(np.uint8)).view(np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """The first 16 bits of each of the sorted hashes."""
    return (hashes >> np.uint64(48)).astype("<u2").tobytes()


def may_link(rows: list[tuple], num: int, den: int) -> list[tuple]:
    """(a, b) of rows (a, b, sketch of a, sketch of b) whose sketches differ in no more values than links may."""
    found, last, counts = [], None, np.empty(0)
    for a, b, left, right in rows:
        if left != last:
            last, counts = left, np.bincount(np.frombuffer(left, dtype="<u2"), minlength=SKETCH_VALUES)
        values, n = np.unique(np.frombuffer(right, dtype="<u2"), return_counts=True)
        both = (len(left) + len(right)) // 2
        differ = both - 2 * int(np.minimum(counts[values], n).sum())
        if differ * (den + num) <= both * (den - num):
            found.append((a, b))
    return found


class Bands:
    """Size bands and numbers of segments for links with ``den * intersection >= num * union``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND), self.reach(self.starts[-1]) + 1))
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def reach(self, n: int) -> int:
        """The largest set that one of ``n`` hashes can link with."""
        return n * self.den // self.num

    def needed(self, band: int) -> int:
        """One more than the most hashes in which two sets of a band, or of it and the one below, can differ."""
        largest = self.starts[band + 1] - 1
        return 2 * largest * (self.den - self.num) // (self.den + self.num) + 1

    def spare(self, band: int) -> int:
        """Segments beyond the needed ones: about as many as the emptiest sets of the band have empty, if that is not many."""
        needed = self.needed(band)
        found = 0
        for _ in range(6):
            empty = (needed + found) * exp(-self.starts[band] / (needed + found))
            found = min(needed // 2, ceil(empty + 4 * sqrt(empty)))
        return found

    def segments(self, band: int) -> int:
        return self.needed(band) + self.spare(band)

    def groups(self, n: int) -> list[int]:
        """Bands in which a set is looked for: its own, and the next one if a link may reach it."""
        own = self.band(n)
        self.band(self.starts[own + 1])
        return [own, own + 1] if self.reach(n) >= self.starts[own + 1] else [own]


@lru_cache(maxsize=256)
def _edges(segments: int) -> np.ndarray:
    step = (1 << 64) // segments
    return np.array([k * step for k in range(1, segments)], dtype=np.uint64)


def segment_sums(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of mixed hashes by segment, and where each segment begins in the sorted hashes."""
    places = np.concatenate([[0], np.searchsorted(hashes, _edges(segments)), [len(hashes)]])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes + _ODD[1]), dtype=np.uint64)])
    return sums[places[1:]] - sums[places[:-1]], places


def segment_keys(sums: np.ndarray, band: int, places: np.ndarray | None = None) -> np.ndarray:
    """64-bit keys of sums that tell bands and segments apart."""
    at = np.arange(len(sums), dtype=np.uint64) if places is None else places.astype(np.uint64)
    own = np.uint64((band + 1) * int(_ODD[3]) & (1 << 64) - 1)
    return mixed(sums + mixed(at * _ODD[2] + own))


def _signed(values: np.ndarray) -> list[int]:
    return values.astype(np.uint64).view(np.int64).tolist()


def signatures(hashes: np.ndarray, band: int, bands: Bands) -> list[int]:
    """Keys of a set's segments; of the empty ones only if there are more than the band has to spare.

    Two sets that link have more equal segments than are spare, so an equal one
    that is not empty, unless both have more empty ones than that.
    """
    sums, places = segment_sums(hashes, bands.segments(band))
    keys, filled = segment_keys(sums, band), np.diff(places) > 0
    if len(keys) - filled.sum() <= bands.spare(band):
        keys = keys[filled]
    return _signed(keys)


def set_rows(documents: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Size, two checksums that name the class, parities, sketch and signatures of every row's set, each slice in a column."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        bands = Bands(num, den)
        for batch in batches:
            rows = []
            for doc_id, text in batch:
                hashes = shingles(text, size)
                found: list[int] = []
                if len(hashes):
                    for band in bands.groups(len(hashes)):
                        found += signatures(hashes, band, bands)
                marks = np.array(
                    [hashes.sum(dtype=np.uint64), mixed(hashes ^ _ODD[0]).sum(dtype=np.uint64)], dtype=np.uint64
                )
                slices: list[list[int]] = [[] for _ in range(SLICES)]
                for key in found:
                    slices[key % SLICES].append(key)
                rows.append((doc_id, len(hashes), *_signed(marks), *parities(hashes), sketch(hashes), *slices))
            yield rows
        forget_words()

    return map_rows(documents.select("doc_id", "text"), run, _SETS)


class Join:
    """The steps of one join; everything that several of them read is stored."""

    def __init__(self, documents: DataFrame, size: int, num: int, den: int):
        self.documents, self.size, self.num, self.den = documents, size, num, den
        self.held: list[DataFrame] = []
        self.sets = stored(set_rows(documents, size, num, den))
        named = self.sets.filter("n > 0 AND doc_id IS NOT NULL")
        classes = named.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
        self.copies = self.keep(classes.filter("rows > 1").drop("rows"))
        heads = named.join(small(self.copies), ["n", "c1", "c2"], "left").filter("rep IS NULL OR rep = doc_id")
        lists = []
        for name in _SLICES:
            rows = heads.select("doc_id", "n", F.explode(name).alias("key"))
            shared = stored(rows.groupBy("key").agg(F.count("*").alias("length")).filter("length > 1"))
            # Most signatures belong to one set; what is left of them is often small enough to spare a shuffle of all.
            lists.append(self.keep(rows.join(small(shared), "key")))
            release(shared)
        self.lists = reduce(DataFrame.unionByName, lists)
        # From here on the sets are needed without their signatures, and facts of those in lists alone.
        whole, listed = self.sets, stored(self.lists.select("doc_id").distinct())
        self.sets = self.keep(whole.select("doc_id", "n", "c1", "c2"))
        facts = named.select("doc_id", "n", *PARITIES, "sketch").join(small(listed), "doc_id", "left_semi")
        self.facts = self.keep(facts)
        release(whole, listed)
        self.links: DataFrame | None = None
        self.checked: DataFrame | None = None

    def keep(self, frame: DataFrame) -> DataFrame:
        """``frame`` stored until the join is closed."""
        self.held.append(stored(frame))
        return self.held[-1]

    def close(self) -> None:
        """Nothing of the join is read from here on."""
        release(*self.held)

    def members(self, wanted: DataFrame) -> DataFrame:
        """(doc_id, hashes) of the sets of ``wanted`` (doc_id), from their texts."""
        texts = self.documents.select("doc_id", "text").join(small(wanted), "doc_id", "left_semi")
        size = self.size

        def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
            for batch in batches:
                yield [(doc_id, _signed(shingles(text, size))) for doc_id, text in batch]
            forget_words()

        return map_rows(texts, run, "doc_id long, hashes array<long>")

    def side_by_side(self, pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
        """(a, b, left, right) of stored ``pairs`` (a, b), with ``column`` of ``held`` (doc_id, column) for both."""
        one = held.select(F.col("doc_id").alias("a"), F.col(column).alias("left"))
        two = held.select(F.col("doc_id").alias("b"), F.col(column).alias("right"))
        # Only one of each pair travels, and the first ones once; a first one with many others meets them in parts.
        sizes = self.keep(pairs.groupBy("a").agg(F.count("*").alias("n")))
        firsts = one.join(small(sizes.select("a")), "a", "left_semi")
        hot = hot_keys(sizes, "a", "n", HOT_PAIRS)
        return spread_join(two.join(small(pairs), "b"), firsts, "a", hot, F.xxhash64("b")).select("a", "b", "left", "right")

    def verify(self, pairs: DataFrame) -> None:
        """Adds those of ``pairs`` (a, b) to the links that link; no pair is held against each other twice."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        pairs = self.keep(pairs)
        num, den = self.num, self.den

        def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
            for batch in batches:
                yield may_link(batch, num, den)

        both = self.side_by_side(pairs, self.facts, "sketch")
        likely = stored(map_rows(both, run, "a long, b long").distinct())
        ends = stored(likely.selectExpr("explode(array(a, b)) AS doc_id").distinct())
        members = stored(self.members(ends))
        both = self.side_by_side(likely, members, "hashes")
        shared = F.size(F.array_intersect("left", "right"))
        union = F.size("left") + F.size("right") - shared
        found = self.keep(both.filter(den * shared >= num * union).select("a", "b").distinct())
        release(likely, ends, members)
        self.links = found if self.links is None else self.links.unionByName(found)
        self.checked = pairs if self.checked is None else self.checked.unionByName(pairs)

    def fits(self) -> str:
        return f"x.n * {self.num} <= y.n * {self.den} AND y.n * {self.num} <= x.n * {self.den}"

    def near(self) -> str:
        """What pairs that link satisfy by their sizes and parities."""
        differ = " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in PARITIES)
        return f"{self.fits()} AND ({differ}) * {self.den + self.num} <= (x.n + y.n) * {self.den - self.num}"

    def first_pairs(self) -> DataFrame:
        """Every set with the smallest one that it shares a list with."""
        least = self.lists.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("least"))
        met = self.lists.alias("x").join(least.selectExpr("key", "least.doc_id", "least.n").alias("y"), "key")
        met = met.filter(f"x.doc_id != y.doc_id AND {self.fits()}")
        return met.groupBy(F.col("x.doc_id").alias("b")).agg(F.min("y.doc_id").alias("a")).select("a", "b")

    def open_lists(self) -> DataFrame:
        """(key, doc_id, n, parities, length, component) of the lists with sets of several components."""
        known = stored(connected(self.links))
        named = self.lists.join(small(known), F.col("doc_id") == F.col("node"), "left")
        named = named.select("key", "doc_id", "n", "length", F.coalesce("component", "doc_id").alias("component"))
        several = named.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last"))
        several = stored(several.filter("first != last").select("key"))
        facts = self.facts.select("doc_id", *PARITIES).distinct()
        found = stored(named.join(small(several), "key").join(facts, "doc_id"))
        release(known, several)
        return found

    def short_pairs(self, lists: DataFrame) -> DataFrame:
        """All pairs of different components in short lists."""
        short = lists.filter(F.col("length") <= SHORT_LIST)
        pairs = short.alias("x").join(
            short.alias("y"),
            F.expr(f"x.key = y.key AND x.doc_id < y.doc_id AND x.component != y.component AND {self.near()}"),
        )
        return pairs.selectExpr("x.doc_id AS a", "y.doc_id AS b").distinct()

    def pivot_pairs(self, lists: DataFrame, salt: int) -> DataFrame:
        """Pairs of a pivot that a hash chooses with the members of its long list in other components."""
        lists = lists.filter(F.col("length") > SHORT_LIST)
        order = F.struct(F.xxhash64("doc_id", F.lit(salt)), "doc_id")
        chosen = lists.groupBy("key").agg(
            F.min_by(F.struct("doc_id", "n", "component", *PARITIES), order).alias("p")
        )
        chosen = chosen.selectExpr("key", "p.*")
        pairs = lists.alias("x").join(chosen.alias("y"), "key").filter(f"x.component != y.component AND {self.near()}")
        return pairs.selectExpr("x.doc_id AS a", "y.doc_id AS b").distinct()

    def neighbourhoods(self, lists: DataFrame) -> DataFrame:
        """(doc_id, band, segment, kind, key) of all segments of the members of open lists.

        kind 0 is a segment as it is, 1 a segment without one hash.
        """
        num, den = self.num, self.den

        def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
            bands = Bands(num, den)
            for batch in batches:
                for doc_id, hashes in batch:
                    values = np.array(hashes, dtype=np.int64).view(np.uint64)
                    one = mixed(values + _ODD[1])
                    rows = []
                    for band in bands.groups(len(values)):
                        sums, places = segment_sums(values, bands.segments(band))
                        at = np.repeat(np.arange(len(sums)), np.diff(places))
                        keys = _signed(segment_keys(sums, band))
                        less = _signed(segment_keys(sums[at] - one, band, at))
                        rows += [(doc_id, band, s, 0, k) for s, k in enumerate(keys)]
                        rows += [(doc_id, band, s, 1, k) for s, k in zip(at.tolist(), less)]
                    yield rows

        return map_rows(self.members(stored(lists.select("doc_id").distinct())), run, "doc_id long, band int, segment int, kind int, key long")

    def allocated_pairs(self, lists: DataFrame) -> DataFrame:
        """Pairs of different components that the allocation by cost finds."""
        every = self.neighbourhoods(lists)
        # A segment as it is meets such segments, and those of others without one hash; the other way round for
        # a segment without one hash.  Keys of one row meet nothing, and cost nothing either.
        sizes = every.groupBy("key").agg(
            F.count_if(F.col("kind") == 0).alias("whole"), F.count_if(F.col("kind") == 1).alias("less")
        )
        sizes = self.keep(sizes.filter("whole + less > 1"))
        index = self.keep(every.join(small(sizes), "key"))
        priced = index.groupBy("doc_id", "band", "segment").agg(
            F.sum(F.when(F.col("kind") == 0, F.col("whole") - 1).otherwise(0)).alias("price1"),
            F.sum(F.when(F.col("kind") == 0, F.col("whole") - 1 + F.col("less")).otherwise(F.col("whole"))).alias("price2"),
        )
        chosen = priced.groupBy("doc_id", "band").applyInPandas(
            _allocation(self.num, self.den), "doc_id long, band int, segment int, level int"
        )
        facts = self.keep(lists.select("doc_id", "n", "component", *PARITIES).distinct())
        rows = index.select("doc_id", "band", "segment", "kind", "key").join(small(facts), "doc_id")
        probes = rows.join(chosen, ["doc_id", "band", "segment"]).filter("level = 2 OR kind = 0")
        pairs = probes.alias("x").join(
            rows.alias("y"),
            F.expr(
                f"x.key = y.key AND x.component != y.component AND {self.near()}"
                " AND (y.kind = 0 OR x.kind = 0 AND x.level = 2)"
            ),
        )
        return pairs.selectExpr("x.doc_id AS a", "y.doc_id AS b").distinct()

    def run(self) -> None:
        self.verify(self.first_pairs())
        before = lists = self.open_lists()
        for salt in range(max(1, PIVOT_ROUNDS)):
            if lists.isEmpty():
                return
            pairs = [self.pivot_pairs(lists, salt)] * (PIVOT_ROUNDS > 0) + [self.short_pairs(lists)] * (salt == 0)
            self.verify(reduce(DataFrame.unionByName, pairs))
            # All pairs of the short lists have been seen.
            release(before)
            before = self.open_lists()
            lists = before.filter(F.col("length") > SHORT_LIST)
        if not lists.isEmpty():
            self.verify(self.allocated_pairs(lists))
        release(before)

    def result(self) -> DataFrame:
        sets = self.sets.select("doc_id", "n", "c1", "c2")
        named = sets.join(self.copies, ["n", "c1", "c2"], "left")
        rows = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
        # Rows with one id are one document, whatever their texts.
        repeated = rows.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
        same = rows.join(repeated, "doc_id", "left_semi").selectExpr("doc_id AS a", "rep AS b")
        known = self.keep(connected(self.links.unionByName(same)))
        joined = rows.join(known, F.col("rep") == F.col("node"), "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
        return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def _allocation(num: int, den: int):
    def allocate(prices: pd.DataFrame) -> pd.DataFrame:
        bands = Bands(num, den)
        band = int(prices["band"].iloc[0])
        while len(bands.starts) <= band + 1:
            bands.band(bands.starts[-1])
        # Segments that share no key have no row here and are free.
        price1, price2 = np.zeros(bands.segments(band)), np.zeros(bands.segments(band))
        at = prices["segment"].to_numpy()
        price1[at], price2[at] = prices["price1"], prices["price2"]
        levels = levels_of(price1, price2, bands.needed(band))[at]
        found = prices[["doc_id", "band", "segment"]].assign(level=levels)
        return found[found["level"] > 0]

    return allocate


def levels_of(price1: np.ndarray, price2: np.ndarray, needed: int) -> np.ndarray:
    """Levels of a set's segments whose sum is ``needed``, at the lowest price.

    Every step from level 0 to 1 or from 1 to 2 has its price; a step to 2 that
    costs less than the one before shares both.  The cheapest steps win.
    """
    m = len(price1)
    first, second = price1, price2 - price1
    even = second < first
    first, second = np.where(even, (first + second) / 2, first), np.where(even, (first + second) / 2, second)
    order = np.lexsort((np.tile(np.arange(m), 2), np.repeat([0, 1], m), np.concatenate([first, second])))
    return np.bincount(order[:needed] % m, minlength=m)


def components(documents: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``documents`` (doc_id, text).

    Two documents link when ``den * intersection >= num * union`` of their
    sets of shingles of ``size`` words; a component is named after its smallest
    doc_id.  Words are lower-cased in A-Z and part at blanks and the characters
    9 to 13.  Null and empty texts, and texts of blanks, have no shingles and
    no links.  Rows with one doc_id are one document; rows without have no
    links and no component.  Further columns are ignored.

    Links are not all written: a group of copies hangs together by its pivots.
    """
    join = Join(documents, size, num, den)
    join.run()
    found = stored(join.result())
    join.close()
    return found


def keep_one(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``documents`` with one row of each component, that of the smallest doc_id, and all rows without a doc_id.

    Of several rows with one doc_id the one with the smallest text stays.
    """
    found = components(documents, size, num, den).filter("doc_id IS NOT NULL")
    gone = found.filter("component_id != doc_id").select("doc_id").distinct()
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    gone, repeated = stored(gone), stored(repeated)
    alone = documents.join(small(stored(gone.unionByName(repeated).distinct())), "doc_id", "left_anti")
    repeated, gone = small(repeated), small(gone)
    several = documents.join(repeated, "doc_id", "left_semi").join(gone, "doc_id", "left_anti")
    first = several.groupBy("doc_id").agg(F.min_by(F.struct(*documents.columns), F.coalesce("text", F.lit(""))).alias("row"))
    return alone.unionByName(first.select("row.*"))
