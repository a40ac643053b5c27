from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import evaluation, features, learning, pca, tiles
from riskweave.plans import catalog, pipelines
from riskweave.sources import sinks


def predicted(spark, c00, c01, c10, c11):
    cells = [(0.0, 0.0, c00), (0.0, 1.0, c01), (1.0, 0.0, c10), (1.0, 1.0, c11)]
    frame = spark.createDataFrame(cells, "label double, prediction double, n int")
    return frame.select(
        F.lit("wordcount").alias("variant"), F.lit("gbt").alias("model"), "label", "prediction",
        F.explode(F.array_repeat(F.lit(1), F.col("n"))),
    )


# The published confusion matrix, and the measures published with it.
def test_published_cells(spark):
    row = evaluation.report(predicted(spark, 3768, 51, 185, 555)).first()
    assert row["accuracy"] == pytest.approx(0.9482342618995394, abs=1e-12)
    assert row["auroc_hard"] == pytest.approx(0.8683228593872742, abs=1e-12)
    assert (row["c00"], row["c01"], row["c10"], row["c11"]) == (3768, 51, 185, 555)
    recall = evaluation.class_recall(predicted(spark, 3768, 51, 185, 555)).first()
    assert (recall["recall_0"], recall["recall_1"]) == (pytest.approx(0.9866, abs=1e-4), pytest.approx(0.75))


def test_measures_agree(spark):
    rows = predicted(spark, 30, 12, 7, 21)
    report = evaluation.report(rows).first()
    assert report["accuracy"] == evaluation.accuracy(rows).first()["accuracy"] == pytest.approx(51 / 70)
    assert report["auroc_hard"] == evaluation.auroc_hard(rows).first()["auroc_hard"]
    spark_says = BinaryClassificationEvaluator(rawPredictionCol="prediction").evaluate(rows)
    assert report["auroc_hard"] == pytest.approx(spark_says)


def test_missing_class(spark):
    row = evaluation.report(predicted(spark, 5, 1, 0, 0)).first()
    assert row["c10"] == row["c11"] == 0
    assert row["auroc_hard"] is None and row["accuracy"] == pytest.approx(5 / 6)


# Cluster sizes and purities that must match.
@pytest.mark.parametrize(
    "counts, expected",
    [
        ([[0, 1, 5], [1, 4, 1], [3, 0, 2]], 12 / 17),
        ([[0, 53, 10], [0, 1, 60], [0, 16, 0]], 129 / 140),
    ],
)
def test_purity(spark, counts, expected):
    rows = [(c, k) for c, line in enumerate(counts) for k, n in enumerate(line) for _ in range(n)]
    frame = spark.createDataFrame(rows, "cluster int, class int")
    assert evaluation.purity(frame).first()["purity"] == pytest.approx(expected)


@pytest.fixture(scope="module")
def examples(spark, small):
    return pipelines.examples("baseline", catalog.event_tables(spark, small), catalog.settings(spark))


def test_examples(spark, small, examples):
    rows = examples.collect()
    assert len(rows) == len({r["subject_id"] for r in rows}) == 150
    assert {r["features"].size for r in rows} == {36}
    assert {r["split"] for r in rows} == {"train", "test"}
    tuples = pipelines.event_tuples(catalog.event_tables(spark, small), catalog.settings(spark))
    total, entries = tuples.agg(F.sum("value"), F.count("*")).first()
    assert sum(r["features"].values.sum() for r in rows) == pytest.approx(total)
    assert sum(len(r["features"].indices) for r in rows) == entries


@pytest.mark.parametrize("model, parameters", [("logistic", {}), ("tree", {}), ("gbt", {"iterations": 5})])
def test_fit_save_load(spark, examples, tmp_path, model, parameters):
    train = examples.filter("split = 'train'")
    fitted = learning.estimator(model, **parameters).fit(train)
    path = str(tmp_path / model)
    sinks.write_model(fitted, path)
    again = type(fitted).load(path)
    frame = lambda m: sorted(tuple(r) for r in learning.predict(m, examples).collect())
    assert frame(fitted) == frame(again)
    chances = fitted.transform(examples).select(vector_to_array("probability").alias("p")).collect()
    assert all(np.isfinite(r["p"]).all() for r in chances)
    hits = learning.predict(fitted, train).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    alive = train.agg(F.avg(1 - F.col("label"))).first()[0]
    assert hits >= max(alive, 1 - alive) - 0.02


def test_defaults():
    assert learning.gbt().getMaxIter() == 50 and learning.gbt().getMaxDepth() == 5
    assert learning.gbt().getStepSize() == 0.1 and learning.gbt().getLossType() == "logistic"
    assert learning.tree().getMaxDepth() == 10 and learning.tree().getMaxBins() == 32
    assert learning.tree().getImpurity() == "gini"
    assert learning.logistic().getRegParam() == 0.0 and not learning.logistic().getFitIntercept()
    assert issubclass(GBTClassificationModel, object) and issubclass(LogisticRegressionModel, object)


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(60, 8)) * [9, 6, 4, 2, 0.5, 0.2, 0.1, 0.1]
    matrix[rng.random(matrix.shape) < 0.3] = 0
    entries = [(f"p{i:02d}", j, float(v)) for i, line in enumerate(matrix) for j, v in enumerate(line) if v]
    long = spark.createDataFrame(entries, "subject_id string, idx int, value double")
    fitted = pca.fit(long, 60, 8, 3)
    ids = spark.createDataFrame([(f"p{i:02d}",) for i in range(60)], "subject_id string")
    got = pca.project(long, ids, fitted).orderBy("subject_id").collect()
    centred = matrix - matrix.mean(axis=0)
    _, sizes, axes = np.linalg.svd(centred)
    assert np.allclose(fitted.variance, sizes[:3] ** 2 / 59)
    assert np.allclose(np.abs([r["components"] for r in got]), np.abs(centred @ axes[:3].T), atol=1e-6)


def test_pca_leaves_only_its_axes_and_scores(spark, monkeypatch):
    """Tables of a step go with it, and no more than a few dense ones are there at a time."""
    placed, gone, most = [], [], []

    def keep(frame, before=pca.stored):
        found = before(frame)
        placed.append(found.stored_at)
        most.append(len(set(placed) - set(gone)))
        return found

    def drop(*frames, before=pca.release):
        gone.extend(f.stored_at for f in frames)
        before(*frames)

    for module in (pca, tiles):
        monkeypatch.setattr(module, "stored", keep)
    monkeypatch.setattr(pca, "release", drop)
    rows = [(f"p{i:02d}", (i * j) % 9, float(1 + i + j)) for i in range(20) for j in range(3)]
    long = spark.createDataFrame(rows, "subject_id string, idx int, value double").dropDuplicates(["subject_id", "idx"])
    fitted = pca.fit(long, 20, 9, 3)
    assert set(placed) - set(gone) == {fitted.axes.stored_at}
    ids = long.select("subject_id").distinct()
    assert pca.project(long, ids, fitted).count() == 20
    assert len(set(placed) - set(gone)) == 2 and max(most) <= 6


def test_a_products_dense_sides_go_with_the_cores(spark, monkeypatch):
    """A dense side is copied for the parts of a band, not for every partition of a shuffle."""
    copies = []
    monkeypatch.setattr(tiles, "_meeting", lambda *rest, before=tiles._meeting: copies.append(rest[-1]) or before(*rest))
    rows = [(f"p{i:02d}", 0, 1.0) for i in range(20)]
    cut = tiles.tiled(spark.createDataFrame(rows, "subject_id string, idx int, value double"), 1, 1, 1)
    dense = spark.createDataFrame([(0, np.ones(1).tobytes())], "key int, values binary")
    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set(name, "1000")
        tiles.times(cut, dense, 1)
    finally:
        spark.conf.set(name, before)
    assert copies == [2 * spark.sparkContext.defaultParallelism]


@pytest.mark.parametrize("block_entries, band_width", [(1 << 18, 1 << 14), (40, 3), (1, 1), (7, 100)])
def test_products_of_tiles(spark, block_entries, band_width, monkeypatch):
    """Any cut gives the products of the whole matrix, also when sums leave their task early."""
    monkeypatch.setattr(tiles, "HELD_BYTES", 100 * block_entries)
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(50, 11)) * (rng.random((50, 11)) < 0.3)
    matrix[:, 2] = 1.0
    entries = [(f"p{i:02d}", j, float(v)) for i, line in enumerate(matrix) for j, v in enumerate(line) if v]
    long = spark.createDataFrame(entries, "subject_id string, idx int, value double")
    cut = tiles.tiled(long, 11, block_entries, band_width)
    side = rng.normal(size=(11, 4))
    with tiles.large_rows(spark):
        parts = [(b, side[b * band_width : (b + 1) * band_width].tobytes()) for b in range(cut.bands)]
        dense = spark.createDataFrame(parts, "key int, values binary")
        shares = tiles.times(cut, dense, 4)
        rows = {r.subject_id: r.row for r in tiles.rows_by_id(cut, shares, 4).collect()}
        back = {r.key: np.frombuffer(r.values) for r in tiles.transposed_times(cut, shares, 4).collect()}
        sums = {r.key: np.frombuffer(r.values) for r in tiles.transposed_times(cut, tiles.ones(cut), 1).collect()}
    assert np.allclose([rows[f"p{i:02d}"] for i in range(50)], matrix @ side)
    assert np.allclose(np.concatenate([back[b] for b in sorted(back)]).reshape(-1, 4), matrix.T @ (matrix @ side))
    assert np.allclose(np.concatenate([sums[b] for b in sorted(sums)]), matrix.sum(axis=0))
    assert tiles.square_sum(cut) == pytest.approx((matrix**2).sum())


def test_pca_of_all_numeric_features(spark, small):
    """As Spark's own, which holds the whole covariance."""
    source = catalog.event_tables(spark, small)
    tuples = pipelines.stored(pipelines.event_tuples(source, catalog.settings(spark)))
    index = features.feature_index(features.feature_names(tuples))
    long = pipelines.stored(features.indexed_tuples(tuples, index))
    every = pca.fit(long, 150, 36, 36)
    data = pipelines.examples("baseline", source, catalog.settings(spark))
    theirs = PCA(k=5, inputCol="features", outputCol="c").fit(data)
    assert np.allclose(every.variance[:5] / every.variance.sum(), theirs.explainedVariance, atol=1e-6)
    few = pca.fit(long, 150, 36, 5)
    assert np.allclose(few.variance, every.variance[:5], rtol=1e-3)


def test_word_separator_in_a_pipeline(spark, small):
    tables = catalog.event_tables(spark, small)
    chosen = pipelines.Settings(word_separator=catalog.WORD_SEPARATOR, stop_words=None, filter_notes=False)
    cut = pipelines.word_count_tuples(tables, chosen).filter("feature = 'tion'").agg(F.sum("value")).first()[0]
    plain = pipelines.word_count_tuples(tables, pipelines.Settings(stop_words=None, filter_notes=False))
    ends = plain.filter("feature LIKE '%tion'").agg(F.sum("value")).first()[0]
    twice = plain.filter("feature = 'tiontion'").agg(F.sum("value")).first()[0] or 0.0
    assert cut == ends + twice and ends > 0


def test_bounded_fit(spark, examples):
    few = pipelines.fit_predict("tree", examples, fit_entities=20)
    every = pipelines.fit_predict("tree", examples)
    assert {r["subject_id"] for r in few.collect()} == {r["subject_id"] for r in every.collect()}


def test_run_writes_models_and_report(spark, small, tmp_path):
    folder = str(tmp_path / "out")
    tables = catalog.event_tables(spark, small)
    report = pipelines.run("baseline", tables, models=["logistic", "tree"], folder=folder)
    rows = {r["model"]: r for r in report.collect()}
    assert set(rows) == {"logistic", "tree"}
    tested = 150 - 91
    assert all(r["c00"] + r["c01"] + r["c10"] + r["c11"] == tested for r in rows.values())
    assert LogisticRegressionModel.load(f"{folder}/baseline_logistic").numFeatures == 36
    stored = spark.read.json(f"{folder}/baseline_result")
    assert {r["model"]: r["accuracy"] for r in stored.collect()} == {m: r["accuracy"] for m, r in rows.items()}
    sinks.write_metrics_lines(report, f"{folder}/lines")
    lines = [r["value"] for r in spark.read.text(f"{folder}/lines/variant=baseline/model=tree").collect()]
    assert [float(x) for x in lines] == [float(rows["tree"][c]) for c in ("accuracy", "auroc_hard", "c00", "c01", "c10", "c11")]


def test_dense_parts_are_not_broadcast(spark):
    """Random columns come from the bands' own rows, and dense parts never go to the driver to be joined."""
    rows = [(band, np.full(6, band + 1.0).tobytes()) for band in range(3)]
    means = spark.createDataFrame(rows, "key int, values binary")
    start = pca._start(means, 4)
    both = pca._beside(start, start)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    got = {r.key: (np.frombuffer(r["values"]), np.frombuffer(r.others)) for r in both.collect()}
    for band in range(3):
        expected = np.random.default_rng(band).standard_normal((6, 4)).ravel()
        assert (got[band][0] == expected).all() and (got[band][1] == expected).all()


def test_wide_vocabularies_have_own_trees(spark, small, tmp_path, monkeypatch):
    """Above the width, no dense tree is fitted; every test entity gets its prediction, close to Spark's own."""
    tables, chosen = catalog.event_tables(spark, small), catalog.settings(spark)
    few = {"gbt": {"iterations": 3, "max_depth": 3, "seed": 7}, "tree": {"max_depth": 3, "max_memory_mb": 64}}
    narrow = replace(chosen, model_parameters=few)
    dense = {r.model: r for r in pipelines.run("baseline", tables, narrow, learning.TREES).collect()}
    monkeypatch.setattr(learning, "estimator", None)
    folder = str(tmp_path / "wide")
    wide = replace(narrow, dense_width=5)
    own = {r.model: r for r in pipelines.run("baseline", tables, wide, learning.TREES, folder).collect()}
    for model in learning.TREES:
        cells = [own[model][c] for c in ("c00", "c01", "c10", "c11")]
        assert sum(cells) == sum(dense[model][c] for c in ("c00", "c01", "c10", "c11")) > 0
        assert abs(own[model].accuracy - dense[model].accuracy) < 0.1
        assert "node" in spark.read.parquet(f"{folder}/baseline_{model}").columns
