import math
import random

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from riskweave.operators import cohort, features, labels, learning, runtime, splits, words
from riskweave.operators import events as ev


def coded(spark, *names):
    return spark.createDataFrame([("p1", c) for c in names], "subject_id string, code string")


def measured(spark, *pairs):
    return spark.createDataFrame([("p1", c, float(v)) for c, v in pairs], "subject_id string, code string, value double")


def as_map(frame):
    rows = frame.collect()
    found = {(r["subject_id"], r["feature"]): r["value"] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize(
    "given, wanted, expected",
    [
        (["rash"], None, {"rash": 1.0}),
        (["rash", "gout", "rash", "rash"], None, {"rash": 3.0, "gout": 1.0}),
        (["rash", "gout", "rash"], ["gout", "croup"], {"gout": 1.0}),
        (["rash", "gout", "rash"], ["rash"], {"rash": 2.0}),
        ([], None, {}),
    ],
)
def test_counts(spark, given, wanted, expected):
    got = as_map(features.count_features(coded(spark, *given), wanted))
    assert got == {("p1", c): v for c, v in expected.items()}


READINGS = [("iron", 8), ("iron", 11), ("zinc", 250.5)]


@pytest.mark.parametrize(
    "given, wanted, expected",
    [
        ([("iron", 8)], None, {"iron": 8.0}),
        (READINGS, None, {"iron": 9.5, "zinc": 250.5}),
        (READINGS, ["zinc"], {"zinc": 250.5}),
        (READINGS, ["iron", "lead"], {"iron": 9.5}),
    ],
)
def test_means(spark, given, wanted, expected):
    got = as_map(features.mean_features(measured(spark, *given), wanted))
    assert got == {("p1", c): v for c, v in expected.items()}


def test_code_table(spark):
    wanted = spark.createDataFrame([("gout",)], "c string")
    assert as_map(features.count_features(coded(spark, "rash", "gout"), wanted)) == {("p1", "gout"): 1.0}


def test_all_sources_at_once(spark):
    stacked = ev.stack_sources(
        coded(spark, "DIAG1", "DIAG1").withColumn("event_date", F.current_date()),
        coded(spark, "MED1").withColumn("event_date", F.current_date()),
        measured(spark, ("LAB1", 2), ("LAB1", 4)).withColumn("event_date", F.current_date()),
    )
    got = {(r["source"], r["feature"]): r["value"] for r in features.event_features(stacked).collect()}
    assert got == {("DIAG", "DIAG1"): 2.0, ("MED", "MED1"): 1.0, ("LAB", "LAB1"): 3.0}


def vectors_of(spark, rows):
    tuples = spark.createDataFrame(rows, "subject_id string, feature string, value double").withColumn(
        "source", F.lit("DIAG")
    )
    index = features.feature_index(features.feature_names(tuples))
    table = features.sparse_rows(features.indexed_tuples(tuples, index))
    outcome = tuples.select("subject_id").distinct().withColumn("label", F.lit(1.0))
    path = learning.write_examples(table, index, outcome)
    entries = {(r["subject_id"], r["idx"]): r["value"] for r in learning.example_entries(spark, path).collect()}
    vectors = {r["subject_id"]: r["features"] for r in learning.read_examples(spark, path).collect()}
    assert entries == {(who, int(k)): v for who, x in vectors.items() for k, v in zip(x.indices, x.values)}
    return vectors


def test_vectors_in_name_order(spark):
    got = vectors_of(spark, [("p1", "wheeze", 7.0), ("p1", "cough", 5.0), ("p2", "fever", 3.0)])
    assert got == {"p1": SparseVector(3, {0: 5.0, 2: 7.0}), "p2": SparseVector(3, {1: 3.0})}
    assert got["p1"].toArray().tolist() == [5.0, 0.0, 7.0]


def test_names_that_most_entities_have_are_cut(spark):
    rows = [(f"p{i}", "WORD", name, float(i)) for i in range(200) for name in ("all", f"own{i}")]
    tuples = spark.createDataFrame(rows, "subject_id string, source string, feature string, value double")
    index = features.feature_index(features.feature_names(tuples))
    plain = sorted(tuple(r) for r in features.indexed_tuples(tuples, index).collect())
    assert sorted(tuple(r) for r in features.indexed_tuples(tuples, index, 10).collect()) == plain
    assert len(plain) == 400


def test_index_has_no_gaps(spark):
    random.seed(2)
    names = sorted({(random.choice(["DIAG", "LAB", "WORD"]), f"{random.randrange(10**6):06x}é") for _ in range(5000)})
    shuffled = random.sample(names, len(names))
    index = features.feature_index(spark.createDataFrame(shuffled, "source string, feature string").repartition(7))
    got = [(r["source"], r["feature"]) for r in index.orderBy("idx").collect()]
    assert got == names
    assert [r["idx"] for r in index.orderBy("idx").select("idx").collect()] == list(range(len(names)))


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], "source string, feature string")
    assert features.feature_index(empty).count() == 0


def test_same_name_in_two_sources(spark):
    tuples = spark.createDataFrame(
        [("p", "DIAG", "x", 1.0), ("p", "WORD", "x", 2.0)], "subject_id string, source string, feature string, value double"
    )
    index = features.feature_index(features.feature_names(tuples))
    row = features.sparse_rows(features.indexed_tuples(tuples, index)).first()
    assert (row["indices"], row["values"]) == ([0, 1], [1.0, 2.0])


def test_word_features(spark):
    counts = spark.createDataFrame([("p", "a", 2), ("p", "a", 3), ("p", "b", 1)], "subject_id string, word string, cnt long")
    assert as_map(features.sum_word_features(counts)) == {("p", "a"): 5.0, ("p", "b"): 1.0}
    scores = spark.createDataFrame([("p", "a", 0.5), ("p", "a", 1.0)], "subject_id string, word string, tfidf double")
    assert as_map(features.mean_word_features(scores)) == {("p", "a"): 0.75}


def test_rare_names(spark):
    tuples = spark.createDataFrame([("WORD", f) for f in "aaabbc"], "source string, feature string")
    assert {r["feature"] for r in features.feature_names(tuples, 2).collect()} == {"a", "b"}


NOTES = [
    ("n1", "p1", "The cats was here, cats!"),
    ("n2", "p1", "A cat has 2 mice"),
    ("n3", "p2", "Mice and mouse"),
    ("n4", "p3", "the of and"),
]


def notes(spark):
    frame = spark.createDataFrame(NOTES, "note_id string, subject_id string, text string")
    return frame.withColumn("event_date", F.to_date(F.lit("2000-01-01")))


def lemmas(spark):
    return words.lemma_table(spark, [("cats", "cat"), ("mice", "mouse"), ("was", "wa"), ("has", "ha")])


def counted(frame):
    return {(r["note_id"], r["word"]): r["cnt"] for r in frame.collect()}


def test_few_lemmas_need_no_shuffle_of_words(spark):
    """Only notes that come twice, also without an id, are added up; a table that is too long for a map gives the same."""
    rows = [(1, 1, "cats cat dogs"), (1, 1, "cats"), (None, 2, "dogs dog"), (None, 2, "cats"), (2, 1, "was cats cat"), (3, 1, None)]
    frame = spark.createDataFrame(rows, "note_id long, subject_id long, text string").withColumn("event_date", F.lit("2020-01-01").cast("date"))
    table = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), (None, "x"), ("was", None)], "form string, lemma string")
    got = words.note_word_counts(frame, table)
    expected = {(1, "cat"): 3, (1, "dog"): 1, (None, "dog"): 2, (None, "cat"): 1, (2, "cat"): 2}
    assert counted(got) == expected and got.count() == len(expected)
    long = table.unionByName(spark.range(40).selectExpr("concat('form', id) AS form", "'none' AS lemma"))
    assert counted(words.note_word_counts(frame, long)) == expected
    once = words.note_word_counts(frame.filter("note_id > 1"), table)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


def test_names_of_word_counts(spark):
    """The names of all tuples, without an aggregation by entity and word."""
    from riskweave.plans import catalog, pipelines

    source = catalog.event_tables(spark, "/root/testdata/sf0.001")
    chosen = catalog.settings(spark)
    got = pipelines.word_count_names(source, chosen)
    expected = features.feature_names(pipelines.feature_tuples("wordcount", source, chosen))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert "sum(cnt" not in got._jdf.queryExecution().executedPlan().toString()


def test_note_word_counts(spark):
    got = words.note_word_counts(notes(spark), lemmas(spark))
    # Lemmas come before stop words, so "wa" and "ha" are not stop words any more.
    assert counted(got) == {
        ("n1", "cat"): 2, ("n1", "wa"): 1,
        ("n2", "cat"): 1, ("n2", "ha"): 1, ("n2", "mouse"): 1,
        ("n3", "mouse"): 2,
    }
    assert counted(words.note_word_counts(notes(spark)))[("n1", "cats")] == 2
    assert ("n1", "was") not in counted(words.note_word_counts(notes(spark)))
    assert counted(words.note_word_counts(notes(spark), stop=None))[("n4", "of")] == 1
    stop = spark.createDataFrame([("cats",)], "w string")
    assert ("n1", "cats") not in counted(words.note_word_counts(notes(spark), stop=stop))


def test_entity_counts_agree(spark):
    per_note = words.entity_word_counts(words.note_word_counts(notes(spark), lemmas(spark)))
    direct = words.entity_bags(notes(spark), lemmas(spark))
    as_set = lambda f: {tuple(r) for r in f.select("subject_id", "word", "cnt").collect()}
    assert as_set(per_note) == as_set(direct)
    assert ("p1", "cat", 3) in as_set(direct)


def test_tfidf_by_hand(spark):
    counts = words.entity_bags(notes(spark), lemmas(spark))
    got = {(r["subject_id"], r["word"]): r for r in words.entity_tfidf(counts).collect()}
    # p1: cat 3, wa 1, ha 1, mouse 1; p2: mouse 2; p3 has stop words only.
    assert got[("p1", "cat")]["tfidf"] == pytest.approx(3 / 4 * math.log(3 / 2))
    assert got[("p1", "mouse")]["tfidf"] == pytest.approx(1 / 4 * math.log(3 / 3))
    assert got[("p2", "mouse")]["tfidf"] == pytest.approx(0.0)
    assert len(got) == 5
    total = {(r["subject_id"], r["word"]): r["tfidf"] for r in words.entity_tfidf(counts, "total_tokens").collect()}
    assert total[("p1", "cat")] == pytest.approx(3 / 6 * math.log(3 / 2))
    size = words.corpus_size(counts).first()
    assert (size["n_entities"], size["n_words"]) == (2, 4)


def test_tfidf_with_hot_words_and_entities(spark):
    random.seed(3)
    rows = {("hot", f"w{i}"): random.randrange(1, 9) for i in range(600)}
    rows.update({(f"p{i}", "hot"): random.randrange(1, 9) for i in range(600)})
    rows.update({(f"p{i}", f"w{random.randrange(600)}"): 1 for i in range(600)})
    counts = spark.createDataFrame([(a, b, n) for (a, b), n in rows.items()], "subject_id string, word string, cnt long")
    plain = {(r["subject_id"], r["word"]): r["tfidf"] for r in words.entity_tfidf(counts).collect()}
    cut = {(r["subject_id"], r["word"]): r["tfidf"] for r in words.entity_tfidf(counts, min_rows=50).collect()}
    terms, found = {}, {}
    for (who, word), n in rows.items():
        terms[who] = terms.get(who, 0) + 1
        found[word] = found.get(word, 0) + 1
    for (who, word), n in rows.items():
        expected = n / terms[who] * math.log((len(terms) + 1) / (found[word] + 1))
        assert plain[(who, word)] == pytest.approx(expected)
        assert cut[(who, word)] == pytest.approx(expected)
    assert len(plain) == len(cut) == len(rows)


def test_labels(spark):
    admissions = spark.createDataFrame(
        [("a", "0"), ("a", "1"), ("b", "0"), ("b", None), ("c", "1"), ("c", None)],
        "subject_id string, hospital_expire_flag string",
    )
    got = {r["subject_id"]: r["label"] for r in labels.entity_labels(admissions).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 1.0}
    left = spark.createDataFrame([("a", 1), ("z", 2)], "subject_id string, x int")
    assert [tuple(r) for r in labels.labeled(left, labels.entity_labels(admissions)).collect()] == [("a", 1, 1.0)]


def test_splits(spark):
    ids = spark.range(2000).withColumnRenamed("id", "subject_id")
    share = splits.hash_split(ids).filter("split = 'train'").count() / 2000
    assert 0.55 < share < 0.65
    train, test = splits.random_split(ids)
    assert train.intersect(test).count() == 0 and train.count() + test.count() == 2000
    some = ids.filter("subject_id < 10")
    train, test = splits.split_by_ids(ids, some, ids.filter("subject_id between 10 and 14"))
    assert (train.count(), test.count()) == (10, 5)


def test_cohort(spark):
    diagnoses = spark.createDataFrame(
        [("a", "DIAG25000"), ("b", "DIAG2590"), ("c", "DIAG2591"), ("d", "DIAG2499"), ("a", "DIAG25012"), ("e", "MED2500")],
        "subject_id string, code string",
    )
    chosen = cohort.select_cohort(diagnoses)
    assert {r[0] for r in chosen.collect()} == {"a", "b"}
    assert chosen.count() == 2
    assert cohort.restrict(diagnoses, chosen).count() == 3
    everyone = diagnoses.select("subject_id").distinct()
    some_notes = spark.createDataFrame([("a",), ("a",), ("z",)], "subject_id string")
    outcome = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "subject_id string, label double")
    tuples = spark.createDataFrame([("DIAG", "x"), ("DIAG", "y"), ("DIAG", "x")], "source string, feature string")
    stats = cohort.cohort_stats(chosen, everyone, some_notes, outcome, tuples).first()
    assert (stats["n_cohort"], stats["n_all"], stats["n_features"]) == (2, 5, 2)
    assert (stats["notes_mean"], stats["notes_min"], stats["notes_max"]) == (1.0, 0, 2)
    assert (stats["n_without_notes"], stats["n_deceased"], stats["share_deceased"]) == (1, 1, 0.5)


def test_noun_lemmas(spark):
    """Endings come off only where a noun is left; irregular forms go by their list; the shortest noun wins."""
    nouns = ["cat", "bus", "buss", "wolf", "wolv", "box", "church", "man", "city", "child", "dress", "as", "gas", "a"]
    forms = [
        "cats", "buses", "wolves", "boxes", "churches", "men", "cities", "children", "dress", "dresses", "gas", "as",
        "runs", "catsss", "mouses", "", None, "s",
    ]
    words_of = spark.createDataFrame([(w,) for w in forms + forms], "word string")
    table = spark.createDataFrame([(w,) for w in nouns], "noun string")
    irregular = spark.createDataFrame([("children", "child"), ("runs", "running")], "form string, lemma string")
    got = {r.form: r.lemma for r in words.noun_lemmas(words_of, table, irregular).collect()}
    assert got == {
        "cats": "cat", "buses": "bus", "wolves": "wolf", "boxes": "box", "churches": "church", "men": "man",
        "cities": "city", "children": "child", "dresses": "dress", "as": "a", "catsss": "cat",
    }
    plain = words.lemmatize(words_of, words.noun_lemmas(words_of, table, irregular))
    cut = words.lemmatize(words_of, words.noun_lemmas(words_of, table, irregular), min_rows=1)
    as_list = lambda f: sorted((r.word or "-") for r in f.collect())
    assert as_list(plain) == as_list(cut) == sorted((got.get(w, w) or "-") if w is not None else "-" for w in forms + forms)


def test_arrays_are_made_once(spark, small):
    """The optimised plan of exploded words works the array of words out in one place."""
    from riskweave.plans import catalog

    # A separator of one's own splits what is normalised, so it splits twice.
    for query, splits_ in ((catalog.tokenize, 1), (catalog.note_word_count_plain, 1), (catalog.tokenize_endings, 2)):
        plan = query(spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == splits_


def test_names_of_salts(spark):
    """A column of the caller's may have the name that the join would take."""
    big = spark.createDataFrame([(k % 3, k, k) for k in range(30)], "key int, _salt int, x int")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "key int, _SALT_ string")
    sizes = big.groupBy("key").agg(F.count("*").alias("n"))
    got = runtime.spread_join(big, small, "key", runtime.hot_keys(sizes, "key", "n", 2, 5), F.xxhash64("x"))
    assert sorted(got.columns) == sorted(["key", "_salt", "x", "_SALT_"]) and got.count() == 20


@pytest.mark.parametrize("parts", [1, 8])
def test_codes_in_ranges(spark, parts):
    """Nested, equal, touching and empty ranges, in any number of parts, against all pairs."""
    r = random.Random(12)
    name = lambda: "".join(r.choice("ABC") for _ in range(r.randint(0, 4)))
    codes = [name() for _ in range(80)] + [None]
    ranges = [tuple(name() for _ in range(2)) for _ in range(12)] + [("A", "A"), ("AB", "AC"), ("AC", "B"), (None, "C"), ("C", None)]
    frame = spark.createDataFrame([(c, 1) for c in codes], "code string, part int").repartition(parts)
    got = cohort.codes_in_ranges(frame, spark.createDataFrame(ranges, "low string, high string"))
    inside = {c for c in codes if c is not None and any(a is not None and b is not None and a <= c <= b for a, b in ranges)}
    assert sorted(x.code for x in got.collect()) == sorted(inside)
    empty = spark.createDataFrame([], "low string, high string")
    assert cohort.codes_in_ranges(frame, empty).count() == 0


def test_nouns_are_read_once(spark):
    """Several rounds of detaching look candidates up in one written table."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    nouns = spark.createDataFrame([("bus",), ("dress",), ("cat",)], "noun string").mapInArrow(counted, "noun string")
    forms = spark.createDataFrame([("cats",), ("dressesses",), ("buses",)], "word string")
    got = {r.form: r.lemma for r in words.noun_lemmas(forms, nouns).collect()}
    assert got["cats"] == "cat" and got["buses"] == "bus"
    assert read.value == 3


def test_given_sizes_of_words_serve(spark):
    tokens = spark.createDataFrame([(i, "cats" if i % 2 else "dog") for i in range(90)], "id int, word string")
    lemmas = spark.createDataFrame([("cats", "cat")], "form string, lemma string")
    sizes = words.word_sizes(tokens)
    got = words.lemmatize(tokens, lemmas, 10, sizes)
    assert sorted(map(tuple, got.collect())) == [(i, "cat" if i % 2 else "dog") for i in range(90)]


def test_owners_meet_entities_not_scores(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (3, "c", 4)], "subject_id long, word string, cnt long")
    owners = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (3, None), (None, 5)], "subject_id long, owner long")
    scores = words.entity_tfidf(counts)
    expected = scores.join(owners, "subject_id")
    got = words.entity_tfidf(counts, owners=owners)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.select(got.columns).collect()))
