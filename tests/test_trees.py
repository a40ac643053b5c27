import numpy as np
import pytest

from riskweave.operators import model_tables, trees

LONG = "subject_id long, idx int, value double"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(120, 6)), 1) * (rng.random((120, 6)) < 0.6)
    y = ((x[:, 1] > 0.3) ^ (x[:, 4] < -0.2)).astype(float)
    return x, y


def frames(spark, x, y):
    long = [(i, j, float(v)) for i, line in enumerate(x) for j, v in enumerate(line) if v]
    return spark.createDataFrame(long, LONG).cache(), spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "subject_id long, target double")


def best_split(x, y, cuts):
    """Over dense rows: the first feature and cut of the largest drop of the squared error."""
    found = (1e-12, None, None)
    for j in range(x.shape[1]):
        for b, cut in enumerate(cuts.get(j, [])):
            left = x[:, j] <= cut
            if left.any() and not left.all():
                score = sum(y[s].sum() ** 2 / s.sum() for s in (left, ~left))
                gain = (score - y.sum() ** 2 / len(y)) / len(y)
                if gain > found[0] + 1e-12:
                    found = gain, j, b
    return found


def grown(x, y, cuts, depth, node=1):
    gain, j, b = best_split(x, y, cuts) if depth else (0, None, None)
    rows = [(node, j, b, len(y), round(float(y.mean()), 9))]
    if j is not None:
        left = x[:, j] <= cuts[j][b]
        rows += grown(x[left], y[left], cuts, depth - 1, 2 * node) + grown(x[~left], y[~left], cuts, depth - 1, 2 * node + 1)
    return rows


@pytest.mark.parametrize("method", ["quantile", "width"])
def test_tree_against_dense_search(spark, data, method):
    x, y = data
    matrix, targets = frames(spark, x, y)
    cuts = {r.idx: r.cuts for r in trees.cut_points(matrix, 8, method).collect()}
    nodes = trees.fit_tree(matrix, targets, max_depth=3, max_bins=8, method=method)
    got = sorted((r.node, r.idx, r.bin, r.n, round(r.prediction, 9)) for r in nodes.collect())
    assert got == sorted(grown(x, y, cuts, 3))


def test_boosted_margins(spark, data):
    """Margins from the table of nodes are those of boosting step by step over dense rows."""
    x, y = data
    matrix, targets = frames(spark, x, y)
    cuts = {r.idx: r.cuts for r in trees.cut_points(matrix, 8).collect()}
    nodes = trees.fit_boosted(matrix, targets, iterations=3, max_depth=2, max_bins=8)
    values = model_tables.tree_values(matrix, targets, nodes)
    got = {r.subject_id: r.score for r in model_tables.tree_predictions(values, boosted=True).collect()}
    sign, margin = 2 * y - 1, np.zeros(len(y))
    for k in range(3):
        target = sign if k == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
        rows = {r[0]: r for r in grown(x, target, cuts, 2)}
        for i in range(len(y)):
            node = 1
            while rows[node][1] is not None:
                node = 2 * node + int(x[i, rows[node][1]] > cuts[rows[node][1]][rows[node][2]])
            margin[i] += (1.0 if k == 0 else 0.1) * rows[node][4]
    assert np.allclose([got[i] for i in range(len(y))], margin, atol=1e-7)


def test_entities_without_entries_and_one_class(spark, data):
    x, y = data
    matrix, targets = frames(spark, x, np.ones(len(y)))
    more = targets.unionByName(spark.createDataFrame([(999, 1.0)], targets.schema))
    nodes = trees.fit_tree(matrix, more, max_depth=3)
    assert [(r.node, r.idx, r.n, r.prediction) for r in nodes.collect()] == [(1, None, 121, 1.0)]
    values = model_tables.tree_values(matrix, more, nodes)
    assert values.count() == 121 and {r.value for r in values.collect()} == {1.0}
    with pytest.raises(ValueError, match="quantile or width"):
        trees.cut_points(matrix, 8, "other")


def test_linear_margins(spark, data):
    x, _ = data
    matrix, entities = frames(spark, x, np.zeros(len(x)))
    weights = np.linspace(-1, 1, 6)
    table = spark.createDataFrame([(j, float(w)) for j, w in enumerate(weights)], "idx int, weight double")
    more = entities.unionByName(spark.createDataFrame([(999, 0.0)], entities.schema))
    for min_rows in (1, 10**6):
        got = {r.subject_id: r.margin for r in model_tables.linear_margins(matrix, more, table, 0.5, min_rows).collect()}
        assert got[999] == 0.5
        assert np.allclose([got[i] for i in range(len(x))], x @ weights + 0.5)


def test_levels_over_many_blocks(spark, data, monkeypatch):
    """Small blocks, sums that leave early and few groups at once give the same tree."""
    x, y = data
    matrix, targets = frames(spark, x, y)
    cuts = {r.idx: r.cuts for r in trees.cut_points(matrix, 8).collect()}
    for name in ("BLOCK_ROWS", "HELD_SUMS", "GROUPS_AT_ONCE"):
        monkeypatch.setattr(trees, name, 3)
    nodes = trees.fit_tree(matrix, targets, max_depth=3, max_bins=8)
    assert sorted((r.node, r.idx, r.bin, r.n, round(r.prediction, 9)) for r in nodes.collect()) == sorted(grown(x, y, cuts, 3))


def test_a_level_is_one_small_job(spark, data):
    """A level costs one job with one shuffle, whatever came before it: boosting has hundreds of levels."""
    x, y = data
    matrix, targets = frames(spark, x, y)
    context = spark.sparkContext

    def jobs(iterations):
        context.setJobGroup(f"boosted-{iterations}", "")
        try:
            trees.fit_boosted(matrix, targets, iterations=iterations, max_depth=3, max_bins=8)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(f"boosted-{iterations}"))

    # Two stages for each of three levels, for the root's total and for the rows, and not much else.
    assert jobs(3) - jobs(2) <= 12
