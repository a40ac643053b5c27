import random
from itertools import permutations

import pytest

from riskweave.llm import filter_audit, queries
from tests.llm.conftest import prose

LABELS = "doc_id long, quality int, toxic int, part string"


def failures(rows):
    """Letters that every row (doc_id, text, source) fails, by looking at all rows for each."""
    found = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = text.encode().split()
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows):
            fails.add("E")
        found.append(fails)
    return found


def brute(rows, labels):
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t, _ in labels if t == 1 and d is not None}
    fails = failures(rows)
    found = {}
    for order in permutations("ABCDE"):
        for (doc_id, _, source), failed in zip(rows, fails):
            gone = False
            for step, name in enumerate(order, 1):
                cell = found.setdefault((source or "", "".join(order), step), [0] * 6)
                removed = name in failed and not gone
                cell[1] += removed
                cell[2] += name in failed and gone
                cell[3] += failed == {name}
                cell[4] += removed and doc_id in good
                cell[5] += removed and doc_id in bad
                gone = gone or removed
                cell[0] += not gone
    removals = {}
    for (part, order, step), cell in found.items():
        removals[part, order[step - 1]] = removals.get((part, order[step - 1]), 0) + cell[1]
    return sorted((*key, *cell, removals[key[0], key[1][key[2] - 1]]) for key, cell in found.items())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    texts = [prose(r, 250), prose(r, 20), "UP " + prose(r, 220) + " $", "word " * 300, "", None, "x#y", "Ab Cd", prose(r, 20_000), "\x1c \x85"]
    found = [(i, r.choice(texts), r.choice(["a", "b", None, ""])) for i in range(120)]
    found += [(None, texts[0], "a"), (None, None, None), (3, found[3][1], "b"), (3, found[3][1], "b"), (3, "else", "a"), (-5, texts[1], "c")]
    r.shuffle(found)
    return found


@pytest.fixture(scope="module")
def labels():
    r = random.Random(6)
    rows = [(i, r.choice([0, 1, None]), r.choice([0, 1]), "x") for i in range(60)]
    return rows + [(7, 1, 1, "x"), (7, 0, 0, "x"), (None, 1, 1, "x")]


def write(spark, place, rows, files, code=1):
    """Rows in the given number of files, with columns whose names the operator uses itself."""
    frame = spark.createDataFrame([(*x, code, "k", 2) for x in rows], "doc_id long, text string, source string, code int, key string, n int")
    frame.repartition(files).write.mode("append").parquet(place)


def got(frame):
    return sorted(tuple(row) for row in frame.collect())


@pytest.mark.parametrize("batches", [1, 3, 50])
def test_any_number_of_batches(spark, tmp_path, rows, labels, batches):
    write(spark, str(tmp_path / "t"), rows, 6)
    frame = filter_audit.audit(spark, str(tmp_path / "t"), spark.createDataFrame(labels, LABELS), batches=batches)
    assert frame.columns[:3] == ["part", "filter_order", "step"]
    assert got(frame) == brute(rows, labels)


def test_small_stores_and_many_copies(spark, tmp_path, monkeypatch, labels):
    """A third of all rows are one text, held by tasks that hand on what they hold at every batch."""
    monkeypatch.setattr(filter_audit, "HELD_TEXTS", 1)
    r = random.Random(9)
    rows = [(i, "the same text" if r.random() < 0.4 else prose(r, 3), r.choice("ab")) for i in range(400)]
    r.shuffle(rows)
    write(spark, str(tmp_path / "t"), rows, 5)
    counted = filter_audit.counters(spark, str(tmp_path / "t"), spark.createDataFrame(labels, LABELS), batches=2)
    fails = failures(rows)
    expected = {}
    for (doc_id, _, part), failed in zip(rows, fails):
        code = sum(1 << "ABCDE".index(x) for x in failed)
        code += 32 * any(d == doc_id and q == 1 for d, q, _, _ in labels) + 64 * any(d == doc_id and t == 1 for d, _, t, _ in labels)
        expected[part, code] = expected.get((part, code), 0) + 1
    assert {(x.part, x.code): x.n for x in counted.collect()} == expected


def test_files_that_come_later(spark, tmp_path, rows, labels):
    """A second call reads new files only, and takes back masks of texts whose smaller ids come then."""
    table, folder = str(tmp_path / "t"), str(tmp_path / "state")
    marks = spark.createDataFrame(labels, LABELS)
    write(spark, table, rows, 2)
    assert got(filter_audit.audit(spark, table, marks, folder)) == brute(rows, labels)
    more = [(-100 - i, text, "a") for i, (_, text, _) in enumerate(rows[:40])]
    write(spark, table, more, 3)
    assert got(filter_audit.audit(spark, table, marks, folder)) == brute(rows + more, labels)
    assert got(filter_audit.audit(spark, table, marks, folder)) == brute(rows + more, labels)


def test_empty(spark, tmp_path, labels):
    write(spark, str(tmp_path / "t"), [], 1)
    assert got(filter_audit.audit(spark, str(tmp_path / "t"), spark.createDataFrame(labels, LABELS))) == []


def test_query(spark, small):
    docs = [tuple(x) for x in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [(*x, "") for x in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(queries.op13_filter_audit(spark, small)) == brute(docs, labels)


def test_many_texts_of_one_key(spark, tmp_path, monkeypatch, rows, labels):
    monkeypatch.setattr(filter_audit, "TEXTS_PER_KEY", 10**6)
    write(spark, str(tmp_path / "t"), rows, 6)
    assert got(filter_audit.audit(spark, str(tmp_path / "t"), spark.createDataFrame(labels, LABELS), batches=6)) == brute(rows, labels)
