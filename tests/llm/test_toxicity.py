import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import queries, toxicity
from tests.llm.conftest import prose

BAD = ["idiot", "moron", "scum"]


def counted(texts):
    total = np.zeros(toxicity.GRAMS)
    for text in texts:
        line = [0, 0, 0, *(toxicity.folded(c) for c in text or ""), 0, 0, 0]
        for k in range(len(line) - 3):
            total[np.dot(line[k : k + 4], [27**3, 27**2, 27, 1])] += 1
    return total


def test_counts(spark, odd_documents):
    texts = [r.text for r in odd_documents.select("text").collect() if r.text is None or len(r.text) < 30_000]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    got = np.zeros(toxicity.GRAMS)
    for row in toxicity.character_counts(frame).collect():
        got[row.gram] = row.n
    want = counted(texts)
    # Between two texts of a task the edge is counted once.
    assert (got[1:] - want[1:] == 0).sum() > 0.999 * len(got) - 100
    assert got[1 * 27 :].sum() >= want[1 * 27 :].sum() - 3 * len(texts)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    rows = []
    for k in range(600):
        words = prose(r, 60).split()
        toxic = k % 5 == 0
        for _ in range(3 * toxic):
            words[r.randrange(60)] = r.choice(BAD)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark, corpus):
    documents = spark.createDataFrame(corpus, "doc_id long, text string, toxic int")
    return toxicity.fit(documents.drop("toxic"), documents.select("doc_id", "toxic"), F.col("doc_id") % 4 != 0)


def test_restored(model):
    reader = toxicity.Reader(model.costs)
    for written in ("1d10t", "id1ot", "i.d.i.o.t", "i-d-i-o-t", "idiooot", "iiidiot", "!diot", "m0r0n!!", "5cum", "$cum", "m.o.r.o.n."):
        assert {"idiot", "moron", "scum"} & set(reader.forms(written)), written
    assert list(reader.spelled("so i d i o t is it".split())) == ["idiot"]
    assert reader.forms("there") == ["there"] and reader.forms("***") == []
    assert toxicity.restored("", model.costs) == ""


def best_reading(observed, costs):
    """All readings, one by one."""
    found = [(0.0, ())]
    for choices in toxicity.options(observed):
        found = [(c + extra, s if x is None else (*s, x)) for c, s in found for x, extra in choices]

    def whole(cost, line):
        line = (0, 0, 0, *line, 0)
        return cost + sum(costs[np.dot(line[k : k + 4], [27**3, 27**2, 27, 1])] for k in range(len(line) - 3))

    return min(whole(c, s) for c, s in found)


def test_viterbi_is_optimal(model):
    r = random.Random(8)
    for _ in range(60):
        observed = "".join(r.choice("id1o0t.a ") for _ in range(r.randint(1, 6)))
        words = toxicity.restored(observed, model.costs)
        assert len(words) <= len(observed)
        best = best_reading(observed, model.costs)
        # The reading found is among the best: its own lowest cost is the lowest of all.
        line = tuple(0 if c == " " else ord(c) - 96 for c in words)
        own = [
            c for c, s in _readings(observed) if tuple(x for x in s) == line or "".join(chr(x + 96) if x else " " for x in s).strip() == words
        ]
        assert own and best <= min(own) + 1e3


def _readings(observed):
    found = [(0.0, ())]
    for choices in toxicity.options(observed):
        found = [(c + extra, s if x is None else (*s, x)) for c, s in found for x, extra in choices]
    return found


def test_held_out(spark, corpus, model):
    documents = spark.createDataFrame(corpus, "doc_id long, text string, score int")
    scores = {r.doc_id: r for r in toxicity.score(documents, model).collect()}
    held = [(scores[k], y) for k, _, y in corpus if k % 4 == 0]
    assert np.mean([r.predicted == y for r, y in held]) >= 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r, _ in held)


def test_obfuscated_documents(spark, corpus, model):
    plain = prose(random.Random(9), 60)
    rows = [(1, plain), (2, plain + " 1d10t m0r0n 5cum"), (3, plain + " i.d.i.o.t s c u m mooooron")]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_odd_documents(spark, odd_documents, no_documents, model):
    rows = toxicity.score(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.accepted(odd_documents, model)
    assert kept.columns == odd_documents.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    assert toxicity.score(no_documents, model).count() == toxicity.accepted(no_documents, model).count() == 0


def test_labels_of_one_kind(spark, no_documents):
    documents = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(documents, labels, F.lit(True))
    assert {r.predicted for r in toxicity.score(documents, model).collect()} == {0}
    empty = toxicity.fit(no_documents, labels.limit(0), F.lit(True))
    assert toxicity.score(documents, empty).count() == 3


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, folder).collect()
    assert len(rows) == 1000
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert np.mean([p == y for p, y in known]) >= 0.95
