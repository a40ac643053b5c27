import random

import numpy as np
import pytest

from riskweave.llm import jaccard, queries

WORDS = [f"w{k}" for k in range(400)]


def brute(rows, size=3, num=90, den=100):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        runs = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)] or [tuple(words)] * bool(words)
        sets.append(frozenset(runs))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            shared = len(sets[i] & sets[j])
            links = sets[i] and den * shared >= num * (len(sets[i]) + len(sets[j]) - shared)
            if links or rows[i][0] == rows[j][0]:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(
        ((d, len(s), least[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def near(r, n, length, edits):
    base = [r.choice(WORDS) for _ in range(length)]
    found = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        found.append(" ".join(words))
    return found


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = near(r, 40, 40, 2) + near(r, 40, 80, 3) + near(r, 30, 200, 8) + near(r, 20, 12, 1) + near(r, 15, 5, 1)
    texts += ["", "  ", None, "a", "A b", "a  b", "x y z"] * 2
    r.shuffle(texts)
    found = list(enumerate(texts))
    return found + [(3, texts[9]), (4, "zz yy"), (None, texts[0]), (None, None), found[7], found[7]]


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, key string, n int").repartition(4)
    return sorted((tuple(r) for r in jaccard.components(frame, **options).collect()), key=repr)


def test_against_all_pairs(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_allocation_alone(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT_LIST", 2)
    monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", 0)
    assert found(spark, rows, size=2, num=80, den=100) == brute(rows, 2, 80, 100)


def test_odd_texts(spark, odd_texts):
    rows = list(enumerate(odd_texts))
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_segments_find_every_link():
    """Sets that link agree in a segment of a band that both are looked for in."""
    r = np.random.default_rng(8)
    for num in (80, 90):
        bands = jaccard.Bands(num, 100)
        for _ in range(400):
            n = int(r.integers(1, 300))
            base = r.integers(0, 2**63, n).astype(np.uint64)
            drop, more = int(r.integers(0, n // 5 + 1)), int(r.integers(0, n // 5 + 1))
            one, two = np.unique(base), np.unique(np.concatenate([base[drop:], r.integers(0, 2**63, more).astype(np.uint64)]))
            shared = len(np.intersect1d(one, two))
            if not len(two) or 100 * shared < num * (len(one) + len(two) - shared):
                continue
            keys = []
            for values in (one, two):
                own = set()
                for band in bands.groups(len(values)):
                    own |= set(jaccard.signatures(values, band, bands))
                keys.append(own)
            assert keys[0] & keys[1]


def test_levels_sum_up():
    r = np.random.default_rng(9)
    for m in (1, 2, 5, 40):
        one = r.integers(0, 50, m).astype(float)
        levels = jaccard.levels_of(one, one + r.integers(0, 50, m), max(1, m - 1))
        assert levels.sum() == max(1, m - 1) and levels.max() <= 2


def test_keep_one(spark):
    text = " ".join(WORDS[:60])
    rows = [(5, text), (2, text), (2, text), (9, "other words here now"), (None, text), (None, None), (7, None), (7, "b")]
    frame = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(frame).collect()), key=repr)
    assert got == sorted([(2, text), (9, "other words here now"), (None, text), (None, None), (7, None)], key=repr)


def test_query(spark, small):
    docs = [tuple(x) for x in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op5_jaccard_join(spark, small).collect()), key=repr) == brute(docs)


def test_a_task_leaves_no_words_behind(monkeypatch):
    """A worker that goes on to another stage holds none of them, whatever the task has seen."""
    taken = {}
    monkeypatch.setattr(jaccard, "map_rows", lambda frame, run, columns: taken.setdefault("run", run))

    class Documents:
        def select(self, *columns):
            return self

    jaccard.set_rows(Documents(), 3, 90, 100)
    rows = [row for batch in taken["run"](iter([[(1, "one two three four"), (2, None)]])) for row in batch]
    assert [r[1] for r in rows] == [2, 0] and not jaccard._words


def test_sketches_rule_out_no_link():
    """A pair goes on if it may link; long sets that share half of their shingles don't."""
    r = np.random.default_rng(4)
    for n in (1, 7, 300, 4000, 90_000):
        base = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0.0, 0.02, 0.1, 0.3, 0.5):
            other = np.unique(np.concatenate([base[int(share * n) :], r.integers(0, 2**64, int(share * n), dtype=np.uint64)]))
            shared = len(np.intersect1d(base, other))
            links = 100 * shared >= 90 * (len(base) + len(other) - shared)
            goes_on = jaccard.may_link([(1, 2, jaccard.sketch(base), jaccard.sketch(other))], 90, 100) == [(1, 2)]
            assert goes_on or not links
            assert not goes_on or links or n == 90_000


def test_only_likely_pairs_travel_whole(spark, monkeypatch):
    """Long texts share a segment with many others; hashes of those that can't link are not stored or shuffled."""
    r = random.Random(6)
    base = [f"v{r.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base[:2000] + [f"u{k}x{j}" for j in range(1000)]) for k in range(6)]
    texts += [texts[0] + " and one more"]
    wanted = []
    before = jaccard.Join.members

    def members(self, ends):
        wanted.extend(x.doc_id for x in ends.collect())
        return before(self, ends)

    monkeypatch.setattr(jaccard.Join, "members", members)
    monkeypatch.setattr(jaccard.Join, "allocated_pairs", lambda self, lists: spark.createDataFrame([], "a long, b long"))
    rows = list(enumerate(texts))
    assert found(spark, rows) == brute(rows)
    assert set(wanted) == {0, 6}
