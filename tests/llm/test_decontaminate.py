import random

from riskweave.llm import decontaminate, queries
from tests.llm.conftest import prose


def items_of(r, n):
    return [(k, f"{prose(r, r.randint(10, 30))}? {prose(r, r.randint(4, 12))}.") for k in range(n)]


def test_wand_against_all_scores():
    r = random.Random(1)
    index = decontaminate.build(items_of(r, 90))
    for _ in range(300):
        terms = r.sample(range(len(index.terms)), r.randint(1, 60))
        scores = {}
        for t in terms:
            for item, share in zip(index.postings[t], index.shares[t]):
                scores[item] = scores.get(item, 0.0) + share
        threshold = r.choice([0.03, 0.08, 0.15, 0.3])
        got = decontaminate.wand(index, terms, threshold)
        assert {k for k, v in scores.items() if v >= threshold + 1e-9} <= set(got)
        assert all(abs(got[k] - scores[k]) < 1e-9 and got[k] >= threshold for k in got)


def test_no_passage_is_missed():
    """Passages that the bounds leave out have no item at the threshold."""
    r = random.Random(2)
    index = decontaminate.build(items_of(r, 40))
    for threshold in (0.2, 0.35):
        searcher = decontaminate.Searcher(index, threshold)
        for length in (0, 1, 40, 64, 65, 3000, 9000):
            ids = searcher.ids(prose(r, length))
            kept = set(searcher.passages(ids))
            ends = set()
            for start in range(0, max(1, len(ids) - searcher.step), searcher.step):
                end = min(start + searcher.size, len(ids))
                ends.add(end)
                terms = sorted({int(t) for t in ids[start:end] if t >= 0})
                assert (start, end) in kept or not decontaminate.wand(index, terms, threshold + 1e-6)
            assert max(ends) == len(ids)


def test_leaks(spark):
    r = random.Random(3)
    items = items_of(r, 50) + [(100, None), (101, ""), (102, "..."), (103, "Same words here again."), (104, "Same words here again.")]
    rows, leaks = [], set()
    for k in range(120):
        text = prose(r, r.randint(5, 400))
        if k % 4 == 0:
            item = r.randrange(50)
            words = items[item][1].upper().replace(" ", "  ").replace("?", " ??") if k % 8 else items[item][1]
            text = f"{text}\n{words} {prose(r, r.randint(0, 200))}"
            leaks.add((k, item))
        rows.append((k, text, "s", 1.0))
    documents = spark.createDataFrame(rows, "doc_id long, text string, item_id string, score double").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.search(documents, table).collect()
    assert {(h.doc_id, h.item_id) for h in hits} == leaks
    assert all(h.score >= 0.5 and h.question >= 0.5 and h.answer >= 0.5 for h in hits)
    kept = decontaminate.clean(documents, table)
    assert kept.columns == documents.columns
    assert {x.doc_id for x in kept.collect()} == {k for k, *_ in rows} - {d for d, _ in leaks}


def test_shards_and_classes(spark):
    r = random.Random(4)
    items = [(k, prose(r, n) + ". " + prose(r, 8)) for k, n in enumerate([20, 30, 200, 400, 25, 900])]
    table = spark.createDataFrame(items, "item_id long, text string")
    indexes = list(decontaminate.shards(table, per_shard=2))
    assert sorted(i for x in indexes for i in x.items) == list(range(6)) and max(len(x.items) for x in indexes) == 2
    documents = spark.createDataFrame([(k, f"{prose(r, 50)} {t} {prose(r, 700)}") for k, t in items], "doc_id long, text string")
    assert {(h.doc_id, h.item_id) for h in decontaminate.search(documents, table).collect()} == {(k, k) for k in range(6)}


def test_one_very_long_item(spark):
    r = random.Random(6)
    item = prose(r, 20_000) + ". " + prose(r, 8)
    documents = spark.createDataFrame(
        [(1, f"{prose(r, 300)} {item} {prose(r, 9000)}"), (2, prose(r, 25_000)), (3, prose(r, 40))], "doc_id long, text string"
    )
    table = spark.createDataFrame([(1, item), (2, prose(r, 20) + ". " + prose(r, 8))], "item_id long, text string")
    assert [(h.doc_id, h.item_id) for h in decontaminate.search(documents, table).collect()] == [(1, 1)]
    assert {x.doc_id for x in decontaminate.clean(documents, table).collect()} == {2, 3}


def test_shards_are_bounded_in_words(spark):
    r = random.Random(7)
    sizes = [2000] * 80 + [30] * 50 + [150_000]
    table = spark.createDataFrame([(k, prose(r, n)) for k, n in enumerate(sizes)], "item_id long, text string").repartition(4)
    indexes = [x.items for x in decontaminate.shards(table)]
    assert sorted(i for x in indexes for i in x) == list(range(131))
    assert all(len(x) == 1 or sum(sizes[i] for i in x) <= 1 << 17 for x in indexes)
    assert len(indexes) == 4


def test_one_shard_at_a_time(spark):
    """Nothing of an index is left when the hits are there, and rows with the same id or none are told apart."""
    r = random.Random(8)
    items = [(k, prose(r, n) + ". " + prose(r, 8)) for k, n in enumerate([20, 200, 400])]
    table = spark.createDataFrame(items, "item_id long, text string")
    clean = [(1, prose(r, 90)), (None, prose(r, 90)), (4, None), (4, "")]
    rows = clean + [(1, f"{prose(r, 50)} {items[0][1]}"), (None, items[1][1]), (None, items[1][1]), (3, f"{items[2][1]} {prose(r, 900)}")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.clean(documents, table)
    hits = decontaminate.search(documents, table)
    for frame in (kept, hits):
        assert "Arrow" not in frame._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(clean, key=repr)
    assert sorted(((h.doc_id, h.item_id) for h in hits.collect()), key=repr) == [(1, 0), (3, 2), (None, 1), (None, 1)]


def test_one_item_twice(spark):
    documents = spark.createDataFrame([(1, "well same words here again then"), (None, "same words here again"), (1, None)], "doc_id long, text string")
    table = spark.createDataFrame([(7, "Same words here again."), (8, "Same words here again.")], "item_id long, text string")
    got = sorted(((h.doc_id, h.item_id) for h in decontaminate.search(documents, table).collect()), key=repr)
    assert got == [(1, 7), (1, 8), (None, 7), (None, 8)]


def test_odd_documents(spark, odd_documents, no_documents):
    table = spark.createDataFrame(items_of(random.Random(5), 10), "item_id long, text string")
    assert decontaminate.search(odd_documents, table).count() == 0
    assert decontaminate.clean(odd_documents, table).count() == odd_documents.count()
    assert decontaminate.search(no_documents, table).count() == decontaminate.search(odd_documents, table.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    bare = lambda t: " ".join(decontaminate.words_of(t))
    items = {r.item_id: bare(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    texts = {r.doc_id: bare(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    inside = {(d, i) for d, t in texts.items() for i, w in items.items() if w in t}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontaminate(spark, folder).collect()}
    assert inside <= got
    # The others hold most of an item: more than half of its runs of five words.
    for doc, item in got - inside:
        runs = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
        assert len(runs(items[item]) & runs(texts[doc])) >= 0.4 * len(runs(items[item]))
