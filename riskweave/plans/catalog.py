"""Named queries over the star schema, one per operator and pipeline."""

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import codes
from riskweave.functions.text import ENGLISH_STOP_WORDS, tokens, treebank_tokens
from riskweave.operators import cohort, evaluation, features, labels, learning, pca, splits, windows, words
from riskweave.operators import events as ev
from riskweave.operators.runtime import HOT_MIN_ROWS, release
from riskweave.plans import pipelines
from riskweave.plans.pipelines import Settings, Tables
from riskweave.sources import star, tables

Query = Callable[[SparkSession, str], DataFrame]

# Lemmas of some words of the documents.  Some forms are stop words and their
# lemmas are not (was, has), or the other way round (thes), so the order of
# both steps shows.
LEMMAS = [
    ("was", "wa"),
    ("has", "ha"),
    ("as", "a"),
    ("thes", "the"),
    ("ones", "one"),
    ("ores", "ore"),
    ("ates", "ate"),
    ("anes", "ane"),
    ("rees", "ree"),
    ("edes", "ede"),
    ("ines", "ine"),
    ("leaux", "leau"),
]

# Orders with one of the two highest priorities are the cohort.
COHORT_LOW, COHORT_HIGH = "1", "2-~"

# Ranges of codes, ends included.
CODE_RANGES = [
    ("DIAG1", "DIAG2-~"),
    ("DIAG1-U", "DIAG1-V"),
    ("DIAG5-LOW", "DIAG5-LOW"),
    ("LABE", "LABP"),
    ("LABS", "LABA"),
    ("MEDBrand#12", "MEDBrand#21"),
    ("MEDBrand#13", "MEDBrand#3"),
]

WANTED_DIAGNOSES = ["DIAG1-URGENT", "DIAG5-LOW"]
WANTED_LABS = ["LABECONOMY", "LABSTANDARD"]

BIG_PARTS = 50
MIN_ENTITIES = 5
# Words end before these endings as well as at white space.
WORD_SEPARATOR = r"\s+|(?=tion(?:\s|$))"

# Customers of these nations are the given training and test sets.
TRAIN_NATIONS, TEST_NATIONS = (0, 11), (12, 19)

PCA_COMPONENTS = 50
# Rows from which keys are cut in the queries that show it.
HOT_ROWS = 20

# Windows per entity, days between their ends, and how much longer each of five is than the one before.
MANY_WINDOWS, WINDOW_STEP, WINDOW_GROWTH = 50, 45, 40


def settings(spark: SparkSession, policy: str = "disjoint") -> Settings:
    return Settings(policy=policy, lemmas=words.lemma_table(spark, LEMMAS))


def event_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(
        star.admissions(spark, folder),
        star.events(spark, folder),
        star.notes(spark, folder),
        star.activity(spark, folder),
    )


# Scalars and texts


def code_namespace(spark, folder):
    orders = star.table(spark, folder, "orders")
    some = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return orders.select(
        "o_orderkey",
        codes.namespaced_code(codes.DIAGNOSIS, some).alias("diag_code"),
        codes.namespaced_code(codes.DIAGNOSIS, some, drop_null=True).alias("diag_or_null"),
        codes.namespaced_code(codes.MEDICATION, "o_orderstatus").alias("med_code"),
        codes.namespaced_code(codes.LAB, "o_custkey").alias("lab_code"),
    )


def date_truncation(spark, folder):
    events = star.table(spark, folder, "events")
    text = events.select(
        "event_id",
        F.date_format("ts", codes.TIMESTAMP_FORMAT).alias("at"),
        F.date_format("ts", codes.DATE_FORMAT).alias("on"),
    )
    return text.select(
        "event_id", codes.parse_day("at").alias("day"), codes.parse_date("on").alias("day_again")
    )


def number_casts(spark, folder):
    events = star.table(spark, folder, "events")
    return events.select(
        "event_id",
        codes.strict_double(F.col("value").cast("string")).alias("as_double"),
        codes.strict_int(F.col("user_id").cast("string")).alias("as_int"),
        codes.lenient_double(F.concat("event_type", F.col("value").cast("string"))).alias("bad_double"),
        codes.lenient_int("event_type").alias("bad_int"),
    )


def normalize_text(spark, folder):
    return words.normalized_notes(star.notes(spark, folder)).select("note_id", "text")


def tokenize(spark, folder):
    return words.note_tokens(star.notes(spark, folder), "note_id")


def tokenize_endings(spark, folder):
    return words.exploded_tokens(star.notes(spark, folder), tokens("text", separator=WORD_SEPARATOR), "note_id")


def tokenize_treebank(spark, folder):
    """Words by the treebank's conventions."""
    return words.exploded_tokens(star.notes(spark, folder), treebank_tokens("text"), "note_id")


def lemmatize(spark, folder):
    return words.lemmatize(tokenize(spark, folder), words.lemma_table(spark, LEMMAS))


def corpus_nouns(tokens: DataFrame) -> DataFrame:
    """Words of the documents that are taken for nouns: about half of them, by a digest."""
    return tokens.select("word").distinct().filter(F.substring(F.md5("word"), 1, 1) < "8")


def lemmatize_nouns(spark, folder):
    """Lemmas by endings that the nouns of the documents confirm, irregular ones first, hot words cut."""
    tokens = tokenize(spark, folder)
    # The texts are cut into words once for their distinct words, with the number of each.
    sizes = pipelines.stored(words.word_sizes(tokens))
    lemmas = words.noun_lemmas(sizes, corpus_nouns(sizes), words.lemma_table(spark, LEMMAS))
    return words.lemmatize(tokens, pipelines.stored(lemmas), HOT_ROWS, sizes)


def remove_stopwords_hot(spark, folder):
    """Stop words from a table, hot words cut."""
    listed = spark.createDataFrame([(w,) for w in ENGLISH_STOP_WORDS], "word string")
    return words.remove_stop_words(lemmatize(spark, folder), listed, HOT_ROWS)


def remove_stopwords(spark, folder):
    return words.remove_stop_words(lemmatize(spark, folder))


def note_word_count(spark, folder):
    return words.note_word_counts(star.notes(spark, folder), words.lemma_table(spark, LEMMAS))


def note_word_count_plain(spark, folder):
    """Without lemmas and stop words: no shuffle at all."""
    return words.note_word_counts(star.notes(spark, folder), stop=None)


# Filters


def split_outcome(spark, folder):
    admissions = star.admissions(spark, folder)
    return (
        ev.fatal(admissions)
        .withColumn("outcome", F.lit("deceased"))
        .unionByName(ev.survived(admissions).withColumn("outcome", F.lit("survived")))
        .unionByName(ev.undetermined(admissions).withColumn("outcome", F.lit("undetermined")))
    )


def drop_incomplete(spark, folder):
    """Labs in which a quantity of one stands for a reading that is missing."""
    labs = star.labs(spark, folder)
    return ev.drop_incomplete(labs.withColumn("value", F.nullif("value", F.lit(1.0))))


def drop_nan_time(spark, folder):
    notes = star.notes(spark, folder).select(
        "note_id", F.coalesce(F.col("event_date").cast("string"), F.lit("nan")).alias("charttime")
    )
    return tables.drop_nan_time(notes, "charttime")


def feature_count_filtered(spark, folder):
    return features.count_features(star.diagnoses(spark, folder), WANTED_DIAGNOSES)


def feature_avg_filtered(spark, folder):
    return features.mean_features(star.labs(spark, folder), WANTED_LABS)


def feature_count_listed(spark, folder):
    """The codes come as a table: the brands of the largest parts."""
    parts = star.table(spark, folder, "part").filter(F.col("p_size") >= BIG_PARTS)
    wanted = parts.select(codes.namespaced_code(codes.MEDICATION, "p_brand").alias("code"))
    return features.count_features(star.medication(spark, folder), wanted)


def cohort_select(spark, folder):
    return cohort.select_cohort(star.diagnoses(spark, folder), COHORT_LOW, COHORT_HIGH, digits=None)


def cohort_ranges(spark, folder):
    """Entities by a table of ranges of codes that overlap, and one that is empty."""
    events = star.events(spark, folder).filter("subject_id % 5 < 3")
    return cohort.select_by_ranges(events, spark.createDataFrame(CODE_RANGES, "low string, high string"))


def codes_in_ranges(spark, folder):
    """Codes in some of these ranges."""
    return cohort.codes_in_ranges(star.events(spark, folder), spark.createDataFrame(CODE_RANGES, "low string, high string"))


def cohort_events(spark, folder):
    return cohort.restrict(star.events(spark, folder), cohort_select(spark, folder))


def cohort_events_hot(spark, folder):
    """The cohort taken for a long list, and its busy entities cut."""
    return cohort.restrict(star.events(spark, folder), cohort_select(spark, folder), HOT_ROWS, listed_rows=0)


# Windows


def _windows(policy, **options) -> Query:
    def query(spark, folder):
        chosen = replace(settings(spark, policy), **options)
        return pipelines.pipeline_windows(event_tables(spark, folder), chosen)

    return query


def _in_window(load, policy="disjoint", closed="neither", min_rows=HOT_MIN_ROWS) -> Query:
    def query(spark, folder):
        source = event_tables(spark, folder)
        spans = pipelines.pipeline_windows(source, settings(spark, policy))
        hot = windows.busy_entities(source.activity, min_rows)
        return windows.in_window(load(spark, folder), spans, closed, hot=hot)

    return query


def events_in_window_note(spark, folder):
    source = event_tables(spark, folder)
    return pipelines.windowed_notes(source, settings(spark)).select("note_id", "subject_id", "event_date")


def _many_windows(spark, folder) -> DataFrame:
    """Fifty windows of an entity that end ever earlier, of five lengths, so that many overlap."""
    last = windows.last_days(star.activity(spark, folder))
    numbered = last.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(MANY_WINDOWS - 1))))
    end = F.expr(f"date_sub(last_date, window * {WINDOW_STEP})")
    start = F.expr(f"date_sub(last_date, window * {WINDOW_STEP} + 10 + window % 5 * {WINDOW_GROWTH})")
    return numbered.select("subject_id", "window", start.alias("start_date"), end.alias("end_date"))


def _in_many_windows(min_rows=HOT_MIN_ROWS) -> Query:
    def query(spark, folder):
        # Read twice: for the busy entities, and to be placed.
        events = pipelines.stored(star.events(spark, folder))
        held = windows.in_many_windows(events, _many_windows(spark, folder), "right", min_rows)
        return held.groupBy("subject_id", "window", "start_date", "end_date", "source").agg(
            F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")
        )

    return query


def event_dates(spark, folder):
    return ev.event_dates(star.events(spark, folder))


def last_event_date(spark, folder):
    return windows.last_event_dates(star.events(spark, folder))


def last_event_date_activity(spark, folder):
    """The same from line items combined per order."""
    return windows.last_days(star.activity(spark, folder))


# Features


def feature_count_diag(spark, folder):
    return features.count_features(star.diagnoses(spark, folder))


def feature_count_med(spark, folder):
    return features.count_features(star.medication(spark, folder))


def feature_avg_lab(spark, folder):
    labs = features.mean_features(star.labs(spark, folder))
    return labs.withColumn("value", F.round("value", 6))


def feature_sum_word(spark, folder):
    return features.sum_word_features(words.note_word_counts(star.notes(spark, folder)))


def feature_avg_tfidf(spark, folder):
    return note_score_means(spark, folder).withColumn("value", F.round("value", 6))


def note_score_means(spark, folder):
    """Mean over the notes of an entity of the scores that a word has with every note as a document."""
    counts = pipelines.stored(note_word_count(spark, folder))
    owners = star.notes(spark, folder).select(F.col("note_id").alias("subject_id"), F.col("subject_id").alias("owner"))
    scores = words.entity_tfidf(counts.select(F.col("note_id").alias("subject_id"), "word", "cnt"), owners=owners)
    return features.mean_word_features(scores.select(F.col("owner").alias("subject_id"), "word", "tfidf"))


def _tuples(variant, policy="disjoint", **options) -> Query:
    def query(spark, folder):
        chosen = replace(settings(spark, policy), **options)
        tuples = pipelines.feature_tuples(variant, event_tables(spark, folder), chosen)
        return tuples.withColumn("value", F.round("value", 6))

    return query


def _unwindowed_tuples(variant) -> Query:
    """Tuples of the whole tables, before any window."""

    def query(spark, folder):
        coded = features.event_features(star.events(spark, folder))
        if variant == "wordcount":
            text = features.sum_word_features(words.note_word_counts(star.notes(spark, folder)))
        elif variant == "tfidf":
            text = note_score_means(spark, folder)
        else:
            return coded.withColumn("value", F.round("value", 6))
        tuples = features.union_tuples(coded, features.word_features(text))
        return tuples.withColumn("value", F.round("value", 6))

    return query


def wordcount_tuples(spark, folder):
    return pipelines.feature_tuples("wordcount", event_tables(spark, folder), settings(spark))


def feature_vocabulary_size(spark, folder):
    # The names alone, which need neither counts nor means.
    return features.vocabulary_size(pipelines.word_count_names(event_tables(spark, folder), settings(spark)))


def feature_index(spark, folder):
    return features.feature_index(features.feature_names(wordcount_tuples(spark, folder)))


def feature_index_common(spark, folder):
    """Features that several entities have."""
    tuples = wordcount_tuples(spark, folder)
    return features.feature_index(features.feature_names(tuples, MIN_ENTITIES))


def sparse_rows(spark, folder):
    """Entries of the assembled rows, with their position in the row."""
    tuples = pipelines.stored(wordcount_tuples(spark, folder))
    index = features.feature_index(features.feature_names(tuples))
    rows = features.sparse_rows(features.indexed_tuples(tuples, index))
    entries = F.posexplode(F.arrays_zip("indices", "values")).alias("position", "entry")
    return rows.select("subject_id", entries).select(
        "subject_id", "position", F.col("entry.indices").alias("idx"), F.round("entry.values", 6).alias("value")
    )


def _vectors(variant, **options) -> Query:
    """Labelled examples as they are written, entry by entry."""

    def query(spark, folder):
        chosen = replace(settings(spark), **options)
        path = pipelines.written_examples(variant, event_tables(spark, folder), chosen)
        return learning.example_entries(spark, path).withColumn("value", F.round("value", 6))

    return query


# Words of entities


def entity_bags(spark, folder):
    return words.entity_bags(star.notes(spark, folder), words.lemma_table(spark, LEMMAS))


def entity_word_count(spark, folder):
    return words.entity_word_counts(note_word_count(spark, folder))


def entity_term_count(spark, folder):
    return words.entity_term_counts(entity_bags(spark, folder))


def document_frequency(spark, folder):
    return words.document_frequencies(entity_bags(spark, folder))


def corpus_size(spark, folder):
    return words.corpus_size(entity_bags(spark, folder))


def entity_scores(spark, folder, norm="distinct_terms"):
    return words.entity_tfidf(pipelines.stored(entity_bags(spark, folder)), norm)


def entity_tfidf(spark, folder):
    return entity_scores(spark, folder).withColumn("tfidf", F.round("tfidf", 6))


def entity_tfidf_hot(spark, folder):
    """Words and entities cut from a few rows on."""
    scores = words.entity_tfidf(pipelines.stored(entity_bags(spark, folder)), min_rows=HOT_ROWS)
    return scores.withColumn("tfidf", F.round("tfidf", 6))


def sparse_rows_hot(spark, folder):
    """Names cut from a few rows on, in the long form."""
    tuples = pipelines.stored(wordcount_tuples(spark, folder))
    index = features.feature_index(features.feature_names(tuples))
    long = features.indexed_tuples(tuples, index, HOT_ROWS)
    return long.withColumn("value", F.round("value", 6))


def entity_tfidf_total_tokens(spark, folder):
    return entity_scores(spark, folder, "total_tokens").withColumn("tfidf", F.round("tfidf", 6))


# Labels, splits, cohorts


def entity_label(spark, folder):
    return labels.entity_labels(star.admissions(spark, folder))


def labeled_tuples(spark, folder):
    source = event_tables(spark, folder)
    tuples = pipelines.event_tuples(source, settings(spark))
    return labels.labeled(tuples, labels.entity_labels(source.admissions)).withColumn(
        "value", F.round("value", 6)
    )


def hash_split(spark, folder):
    return splits.hash_split(star.entities(spark, folder))


def split_by_ids(spark, folder):
    nations = star.table(spark, folder, "customer").select(F.col("c_custkey").alias("subject_id"), "c_nationkey")
    train, test = splits.split_by_ids(
        entity_label(spark, folder),
        nations.filter(F.col("c_nationkey").between(*TRAIN_NATIONS)),
        nations.filter(F.col("c_nationkey").between(*TEST_NATIONS)),
    )
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def cohort_stats(spark, folder):
    stats = cohort.cohort_stats(
        cohort_select(spark, folder),
        star.entities(spark, folder),
        star.notes(spark, folder),
        entity_label(spark, folder),
        features.event_features(star.events(spark, folder)),
    )
    return stats.withColumn("notes_mean", F.round("notes_mean", 6)).withColumn(
        "share_deceased", F.round("share_deceased", 6)
    )


# Evaluation


def predictions(spark, folder):
    """Predictions made up from a hash: right for about four entities out of five."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(v).alias("variant"), F.lit(m).alias("model"))
                for v in pipelines.VARIANTS
                for m in learning.MODELS
            ]
        )
    ).alias("pair")
    made = entity_label(spark, folder).select("subject_id", "label", pairs).select(
        "pair.variant", "pair.model", "subject_id", "label"
    )
    digest = F.md5(F.concat_ws(":", "variant", "model", F.col("subject_id").cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    right = number % 10 < 8
    return made.withColumn("prediction", F.when(right, F.col("label")).otherwise(1 - F.col("label")))


def _evaluated(measure, *rounded) -> Query:
    def query(spark, folder):
        result = measure(predictions(spark, folder))
        return result.withColumns({c: F.round(c, 6) for c in rounded})

    return query


def eval_auroc_scores(spark, folder):
    """Made-up scores with many ties, higher for the positive class on the whole."""
    digest = F.md5(F.concat_ws(":", F.lit("s"), "variant", "model", F.col("subject_id").cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 20
    scored = predictions(spark, folder).withColumn("score", (number + 4 * F.col("label")) / 20.0)
    return evaluation.auroc(scored).withColumn("auroc", F.round("auroc", 6))


def cluster_purity(spark, folder):
    parts = star.table(spark, folder, "part").select(
        F.col("p_brand").alias("cluster"), F.col("p_type").alias("class")
    )
    return evaluation.purity(parts).withColumn("purity", F.round("purity", 6))


# Models


def _fit_predict(model) -> Query:
    def query(spark, folder):
        data = pipelines.examples("baseline", event_tables(spark, folder), settings(spark))
        return pipelines.fit_predict(model, data)

    return query


def _component_inputs(spark, folder):
    """Stored feature matrix, entities with split and label, and number of features."""
    source = event_tables(spark, folder)
    tuples = pipelines.stored(pipelines.feature_tuples("wordcount", source, settings(spark)))
    index = pipelines.stored(features.feature_index(features.feature_names(tuples)))
    matrix = pipelines.stored(features.indexed_tuples(tuples, index))
    entities = splits.hash_split(tuples.select("subject_id").distinct())
    entities = pipelines.stored(entities.join(labels.entity_labels(source.admissions), "subject_id"))
    width = index.count()
    release(tuples, index)
    return matrix, entities, width


def _fitted_components(matrix, entities, width) -> pca.Components:
    train = entities.filter(F.col("split") == "train")
    rows = pipelines.stored(matrix.join(train.select("subject_id"), "subject_id", "left_semi"))
    fitted = pca.fit(rows, train.count(), width, PCA_COMPONENTS)
    release(rows)
    return fitted


def pca_features(spark, folder):
    """Principal components of all features, fitted on the training set."""
    matrix, entities, width = _component_inputs(spark, folder)
    fitted = _fitted_components(matrix, entities, width)
    found = pca.project(matrix, entities, fitted)
    release(matrix, fitted.axes)
    return entities.join(found, "subject_id")


def pca_invariants(spark, folder):
    """What principal components must satisfy whatever their signs, and the moments of the matrix they come from."""
    matrix, entities, width = _component_inputs(spark, folder)
    fitted = _fitted_components(matrix, entities, width)
    train = entities.filter(F.col("split") == "train")
    at = F.posexplode("components").alias("at", "x")
    projected = pca.project(matrix, train, fitted)
    release(matrix, fitted.axes)
    spread = projected.select(at).groupBy("at").agg(
        F.avg("x").alias("mean"), F.var_samp("x").alias("variance")
    )
    variance = F.get(F.array(*map(F.lit, map(float, fitted.variance))), F.col("at"))
    scale = float(fitted.variance[0])
    checks = spread.agg(
        F.count(F.lit(1)).alias("n_components"),
        (F.max(F.abs("mean")) < 1e-6 * scale**0.5).alias("centred"),
        (F.max(F.abs(F.col("variance") - variance)) < 1e-6 * scale).alias("variances_agree"),
    )
    return checks.select(
        F.lit(train.count()).cast("long").alias("n_entities"),
        F.lit(width).cast("long").alias("n_features"),
        F.round(F.lit(fitted.total_variance), 3).alias("total_variance"),
        F.round(F.lit(fitted.mean_square), 3).alias("mean_square"),
        "n_components",
        "centred",
        "variances_agree",
        F.lit(bool((fitted.variance[1:] <= fitted.variance[:-1]).all())).alias("falling"),
        F.lit(bool(fitted.variance.sum() <= fitted.total_variance * (1 + 1e-9))).alias("within_total"),
    )


def test_examples(spark, folder):
    """Entities and labels that predictions are made for: what does not depend on the model's numbers."""
    return _fit_predict("logistic")(spark, folder).select("subject_id", "label")


def _metrics(variant) -> Query:
    def query(spark, folder):
        return pipelines.run(variant, event_tables(spark, folder), settings(spark))

    return query


def queries() -> dict[str, Query]:
    found = {
        "code_namespace": code_namespace,
        "date_truncation": date_truncation,
        "number_casts": number_casts,
        "normalize_text": normalize_text,
        "tokenize": tokenize,
        "tokenize_endings": tokenize_endings,
        "tokenize_treebank": tokenize_treebank,
        "lemmatize": lemmatize,
        "lemmatize_nouns": lemmatize_nouns,
        "remove_stopwords": remove_stopwords,
        "remove_stopwords_hot": remove_stopwords_hot,
        "note_word_count": note_word_count,
        "note_word_count_plain": note_word_count_plain,
        "split_outcome": split_outcome,
        "drop_incomplete": drop_incomplete,
        "drop_nan_time": drop_nan_time,
        "events_in_window_diag": _in_window(star.diagnoses),
        "events_in_window_med": _in_window(star.medication),
        "events_in_window_lab": _in_window(star.labs),
        "events_in_window_note": events_in_window_note,
        "events_in_closed_window": _in_window(star.events, closed="both"),
        "events_in_window_hot": _in_window(star.events, min_rows=HOT_ROWS),
        "events_in_many_windows": _in_many_windows(),
        "events_in_many_windows_hot": _in_many_windows(HOT_ROWS),
        "feature_count_filtered": feature_count_filtered,
        "feature_avg_filtered": feature_avg_filtered,
        "feature_count_listed": feature_count_listed,
        "cohort_select": cohort_select,
        "cohort_ranges": cohort_ranges,
        "codes_in_ranges": codes_in_ranges,
        "cohort_events": cohort_events,
        "cohort_events_hot": cohort_events_hot,
        "windows_with_notes": _windows("disjoint", notes_extend_windows=True),
        "windows_lead_survivors": _windows("disjoint", survivor_lead_days=windows.LEAD_DAYS),
        "event_dates": event_dates,
        "last_event_date": last_event_date,
        "last_event_date_activity": last_event_date_activity,
        "feature_count_diag": feature_count_diag,
        "feature_count_med": feature_count_med,
        "feature_avg_lab": feature_avg_lab,
        "feature_sum_word": feature_sum_word,
        "feature_avg_tfidf": feature_avg_tfidf,
        "feature_vocabulary_size": feature_vocabulary_size,
        "feature_index": feature_index,
        "feature_index_common": feature_index_common,
        "sparse_rows": sparse_rows,
        "feature_vectors": _vectors("baseline"),
        "feature_vectors_wordcount": _vectors("wordcount"),
        "feature_vectors_common": _vectors("wordcount", min_entities=MIN_ENTITIES),
        "sparse_rows_hot": sparse_rows_hot,
        "entity_word_count": entity_word_count,
        "entity_term_count": entity_term_count,
        "document_frequency": document_frequency,
        "corpus_size": corpus_size,
        "entity_tfidf": entity_tfidf,
        "entity_tfidf_hot": entity_tfidf_hot,
        "entity_tfidf_total_tokens": entity_tfidf_total_tokens,
        "entity_label": entity_label,
        "labeled_tuples": labeled_tuples,
        "hash_split": hash_split,
        "split_by_ids": split_by_ids,
        "cohort_stats": cohort_stats,
        "cluster_purity": cluster_purity,
        "eval_accuracy": _evaluated(evaluation.accuracy, "accuracy"),
        "eval_confusion": _evaluated(evaluation.confusion),
        "eval_auroc_hard": _evaluated(evaluation.auroc_hard, "auroc_hard"),
        "eval_auroc_scores": eval_auroc_scores,
        "eval_class_recall": _evaluated(evaluation.class_recall, "recall_0", "recall_1"),
        "eval_report": _evaluated(evaluation.report, "accuracy", "auroc_hard"),
        "pipeline_wordcount_all_notes_tuples": _tuples("wordcount", filter_notes=False),
        "pca_features": pca_features,
        "pca_invariants": pca_invariants,
        "test_examples": test_examples,
    }
    for policy in windows.POLICIES:
        found[f"windows_{policy}"] = _windows(policy)
        if policy != "disjoint":
            found[f"events_in_window_{policy}"] = _in_window(star.events, policy)
            found[f"pipeline_baseline_{policy}_tuples"] = _tuples("baseline", policy)
    for variant in pipelines.VARIANTS:
        found[f"feature_tuples_{variant}"] = _unwindowed_tuples(variant)
        found[f"pipeline_{variant}_tuples"] = _tuples(variant)
        found[f"pipeline_{variant}_metrics"] = _metrics(variant)
    for model in learning.MODELS:
        found[f"fit_predict_{model}"] = _fit_predict(model)
    return found
