"""From event tables to feature tuples, labelled examples, models and a report."""

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import codes
from riskweave.functions.text import ENGLISH_STOP_WORDS
from riskweave.operators import evaluation, features, labels, learning, model_tables, splits, trees, windows, words
from riskweave.operators.runtime import HOT_MIN_ROWS, stored
from riskweave.sources import sinks

VARIANTS = ("baseline", "wordcount", "tfidf")

@dataclass(frozen=True)
class Tables:
    """What a pipeline reads: admissions, the stacked coded events, and notes for the text variants.

    ``activity`` has the last day and the number of events per entity if there
    is a cheaper way to them than counting ``events``.
    """

    admissions: DataFrame
    events: DataFrame
    notes: DataFrame | None = None
    activity: DataFrame | None = None


@dataclass(frozen=True)
class Settings:
    """Choices of a pipeline; the defaults keep every event inside its window and every feature.

    ``filter_notes=False`` uses notes of any date.  ``notes_extend_windows``
    lets a note be the last event of its entity.  ``min_entities`` drops rare
    features before the vectors are built, for models whose memory grows with
    their width; ``fit_entities`` bounds the entities that models are fitted on,
    chosen by a hash (predictions are made for all).  With more features than
    ``dense_width``, trees are grown by aggregation (:mod:`riskweave.operators.trees`),
    whose memory does not grow with the width.  ``hot_min_rows`` is the
    number of rows from which a key may be cut into parts.
    """

    policy: str = "disjoint"
    lead_days: int = windows.LEAD_DAYS
    length_days: int = windows.LENGTH_DAYS
    survivor_lead_days: int = 0
    closed: str = "neither"
    filter_notes: bool = True
    notes_extend_windows: bool = False
    lemmas: DataFrame | None = None
    stop_words: DataFrame | Iterable[str] | None = tuple(ENGLISH_STOP_WORDS)
    word_separator: str | None = None
    tfidf_norm: str = "distinct_terms"
    min_entities: int = 1
    model_parameters: Mapping[str, Mapping] | None = None
    hot_min_rows: int = HOT_MIN_ROWS
    fit_entities: int | None = None
    dense_width: int = learning.DENSE_WIDTH


def pipeline_windows(tables: Tables, settings: Settings) -> DataFrame:
    activity = entity_activity(tables)
    if settings.notes_extend_windows:
        both = activity.unionByName(windows.entity_activity(tables.notes))
        activity = both.groupBy("subject_id").agg(
            F.max("last_date").alias("last_date"), F.sum("n_events").alias("n_events")
        )
    return windows.observation_windows(
        tables.admissions,
        None,
        settings.policy,
        settings.lead_days,
        settings.length_days,
        settings.survivor_lead_days,
        activity=activity,
    )


def entity_activity(tables: Tables) -> DataFrame:
    return windows.entity_activity(tables.events) if tables.activity is None else tables.activity


def event_tuples(
    tables: Tables, settings: Settings = Settings(), spans: DataFrame | None = None
) -> DataFrame:
    """Tuples of diagnoses, medication and labs inside the windows ``spans``, if they are known already."""
    spans = pipeline_windows(tables, settings) if spans is None else spans
    hot = windows.busy_entities(entity_activity(tables), settings.hot_min_rows)
    return features.event_features(windows.in_window(tables.events, spans, settings.closed, hot=hot))


def windowed_notes(
    tables: Tables, settings: Settings = Settings(), spans: DataFrame | None = None
) -> DataFrame:
    """Bags of the notes inside the windows: words are counted in the row, and no text is shuffled."""
    notes = words.bagged(tables.notes, settings.word_separator)
    if not settings.filter_notes:
        return notes
    return windows.in_window(
        notes,
        pipeline_windows(tables, settings) if spans is None else spans,
        settings.closed,
        hot=windows.hot_entities(tables.notes, settings.hot_min_rows),
        salt_on=("note_id",),
    )


def entity_words(
    tables: Tables, settings: Settings = Settings(), spans: DataFrame | None = None
) -> DataFrame:
    """(subject_id, word, cnt) of the notes inside the windows."""
    return words.entity_bags(windowed_notes(tables, settings, spans), settings.lemmas, settings.stop_words)


def word_count_tuples(
    tables: Tables, settings: Settings = Settings(), spans: DataFrame | None = None
) -> DataFrame:
    """Total count per entity and word, which :func:`entity_words` has summed already."""
    counts = entity_words(tables, settings, spans)
    return features.word_features(
        counts.select("subject_id", F.col("word").alias("feature"), F.col("cnt").cast("double").alias("value"))
    )


def tfidf_tuples(
    tables: Tables, settings: Settings = Settings(), spans: DataFrame | None = None
) -> DataFrame:
    """Scores from the counts inside the windows.

    The counts are needed for the scores, per entity and per word.  They are
    written once, so the texts are tokenised once and each use reads only its
    columns.  There is one score per entity and word, so the mean per entity
    and word (:func:`features.mean_word_features`) is the score itself.
    """
    counts = stored(entity_words(tables, settings, spans))
    scores = words.entity_tfidf(counts, settings.tfidf_norm, settings.hot_min_rows)
    return features.word_features(
        scores.select("subject_id", F.col("word").alias("feature"), F.col("tfidf").alias("value"))
    )


def feature_tuples(variant: str, tables: Tables, settings: Settings = Settings()) -> DataFrame:
    """(subject_id, source, feature, value) of a variant in ``VARIANTS``."""
    if variant == "baseline":
        return event_tuples(tables, settings)
    # Both sides meet the same windows, which are worked out once.
    spans = stored(pipeline_windows(tables, settings))
    coded = event_tuples(tables, settings, spans)
    text = {"wordcount": word_count_tuples, "tfidf": tfidf_tuples}[variant](tables, settings, spans)
    return features.union_tuples(coded, text)


def word_count_names(tables: Tables, settings: Settings = Settings()) -> DataFrame:
    """Distinct (source, feature) of the tuples of "wordcount"; nothing is counted per entity for them."""
    spans = stored(pipeline_windows(tables, settings))
    hot = windows.busy_entities(entity_activity(tables), settings.hot_min_rows)
    coded = windows.in_window(tables.events, spans, settings.closed, hot=hot)
    found = words.clean_words(windowed_notes(tables, settings, spans), settings.lemmas, settings.stop_words)
    return (
        coded.select("source", F.col("code").alias("feature")).distinct()
        .unionByName(found.select(F.lit(codes.WORD).alias("source"), F.col("word").alias("feature")).distinct())
    )


def examples(variant: str, tables: Tables, settings: Settings = Settings()) -> DataFrame:
    """Stored (subject_id, features, label, split)."""
    path = written_examples(variant, tables, settings)
    return learning.read_examples(tables.events.sparkSession, path)


def written_examples(variant: str, tables: Tables, settings: Settings = Settings()) -> str:
    """Folder of the examples of a variant."""
    tuples = stored(feature_tuples(variant, tables, settings))
    index = features.feature_index(features.feature_names(tuples, settings.min_entities))
    rows = features.sparse_rows(features.indexed_tuples(tuples, index, settings.hot_min_rows))
    return learning.write_examples(
        splits.hash_split(rows), index, labels.entity_labels(tables.admissions), "split"
    )


def fit_predict(
    model: str, data: DataFrame, folder: str | None = None, fit_entities: int | None = None, **parameters
) -> DataFrame:
    """Predictions on the test set of a model fitted on the training set.

    ``fit_entities`` bounds the entities of the training set that are used, to
    about as many, the first by a hash of the entity.  Tree models hold dense rows, so a wide
    vocabulary may need it; by default all are used.
    """
    fitted = learning.estimator(model, **parameters).fit(_training_set(data, fit_entities))
    if folder is not None:
        sinks.write_model(fitted, folder)
    return learning.predict(fitted, data.filter(F.col("split") == "test"))


def _training_set(data: DataFrame, fit_entities: int | None) -> DataFrame:
    train = data.filter(F.col("split") == "train")
    if fit_entities is not None:
        # A share of the range of hashes; sorting would bring all rows to one task.
        total = max(1, train.count())
        bound = (min(fit_entities, total) << 64) // total - (1 << 63) - 1
        train = train.filter(F.xxhash64("subject_id") <= max(bound, -(1 << 63)))
    return train


def fit_predict_wide(
    model: str, entries: DataFrame, data: DataFrame, folder: str | None = None, fit_entities: int | None = None, **parameters
) -> DataFrame:
    """:func:`fit_predict` of "tree" or "gbt" by own trees, over the ``entries`` of the examples ``data``.

    Rows stay sparse, where Spark's trees hold a dense one of every entity and
    statistics of every feature per node.  The model in ``folder`` is its table of nodes.
    """
    # Bounds of memory and seeds are those of Spark's trees.
    options = {k: v for k, v in parameters.items() if k not in ("max_memory_mb", "seed")}
    train = _training_set(data, fit_entities).select("subject_id", F.col("label").alias("target"))
    test = data.filter(F.col("split") == "test").select("subject_id", "label")
    long = entries.select("subject_id", "idx", "value")
    fit = {"tree": trees.fit_tree, "gbt": trees.fit_boosted}[model]
    nodes = fit(stored(long.join(train.select("subject_id"), "subject_id", "left_semi")), train, **options)
    if folder is not None:
        sinks.write_nodes(nodes, folder)
    seen = long.join(test.select("subject_id"), "subject_id", "left_semi")
    found = model_tables.tree_predictions(model_tables.tree_values(seen, test, nodes), boosted=model == "gbt")
    return test.join(found, "subject_id").select("subject_id", "prediction", "label")


def run(
    variant: str,
    tables: Tables,
    settings: Settings = Settings(),
    models: Iterable[str] = learning.MODELS,
    folder: str | None = None,
) -> DataFrame:
    """Report with one row per model; with ``folder``, models and report are written there."""
    spark = tables.events.sparkSession
    path = written_examples(variant, tables, settings)
    data = learning.read_examples(spark, path)
    wide = learning.width(spark, path) > settings.dense_width
    parameters = settings.model_parameters or {}
    found = []
    for model in models:
        place = f"{folder}/{variant}_{model}" if folder else None
        chosen = place, settings.fit_entities
        if wide and model in learning.TREES:
            plain = data.drop("features")
            made = fit_predict_wide(model, learning.example_entries(spark, path), plain, *chosen, **parameters.get(model, {}))
        else:
            made = fit_predict(model, data, *chosen, **parameters.get(model, {}))
        found.append(made.select(F.lit(variant).alias("variant"), F.lit(model).alias("model"), "*"))
    predictions = reduce(DataFrame.unionByName, found)
    report = evaluation.report(predictions)
    if folder is not None:
        sinks.write_metrics(report, f"{folder}/{variant}_result")
    return report
