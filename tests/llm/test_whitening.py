import math

import numpy as np
import pytest

from riskweave.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, rows string, key string"


def frame_of(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, "r", "k") for row in rows], SCHEMA).repartition(4)


def whole(vector):
    if vector is None or any(v is None or not math.isfinite(v) for v in vector):
        return None
    return tuple(math.floor(64 * float(np.float32(v))) + 1_000_000 for v in vector)


def brute(rows, weight="one", components=16):
    """n, deviations by vector, variances and the covariance, in numpy over all at once."""
    found = [x for x in (whole(v) for _, v in rows) if x is not None]
    fit = found if weight == "count" else sorted(set(found))
    n = len(fit)
    sums = [sum(column) for column in zip(*fit)]
    away = {x: sum((n * v - s) ** 2 for v, s in zip(x, sums)) for x in set(found)}
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values = np.sort(np.linalg.eigvalsh(covariance))[::-1]
    return n, sums, away, values[:components], covariance


def check(rows, got, weight="one", components=16):
    n, sums, away, values, covariance = brute(rows, weight, components)
    kept = [(i, whole(v)) for i, v in rows if whole(v) is not None]
    k = min(components, int((values > values.max() * 1e-10).sum()))
    assert len(got) == k * len(kept)
    assert sorted(((r.vec_id, r.component) for r in got), key=repr) == sorted(((i, c) for i, _ in kept for c in range(1, k + 1)), key=repr)
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    vectors = {}
    for i, x in kept:
        vectors.setdefault(i, []).append(x)
    matrix, seen = [], []
    for i, xs in vectors.items():
        assert sorted(int(r.deviation) for r in by_id[i, 1]) == sorted(away[x] for x in xs)
        if len(xs) == 1:
            seen.append(xs[0])
            matrix.append([by_id[i, c][0].whitened for c in range(1, k + 1)])
    for r in got:
        assert r.n == n and r.identity_error < 1e-8
        assert abs(r.explained - values[r.component - 1] / np.trace(covariance)) < 1e-9
    # Equal vectors have equal rows; the axes behind the numbers are unit eigenvectors.
    first = {x: row for x, row in zip(seen, matrix)}
    assert all(first[x] == row for x, row in zip(seen, matrix))
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in first])
    axes = np.linalg.lstsq(centred, np.array(list(first.values())) * np.sqrt(values[:k]), rcond=None)[0]
    if len(first) > centred.shape[1]:
        assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-8)
        assert np.allclose(covariance @ axes, axes * values[:k], rtol=1e-8, atol=1e-8 * values[0])


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    base = r.normal(size=(150, 20)) * np.linspace(3, 0.3, 20)
    found = [(i, base[k].tolist()) for i, k in enumerate(r.integers(0, 150, 300))]
    found += [(1000 + i, base[0].tolist()) for i in range(150)]
    found += [(-1, None), (-2, [None] + [0.5] * 19), (-3, [float("nan")] * 20), (-4, [float("inf")] + [0.0] * 19), (-5, [])]
    return found + [(None, base[1].tolist()), (7, base[2].tolist()), (7, base[2].tolist())]


@pytest.mark.parametrize("weight", ["one", "count"])
def test_against_numpy(spark, rows, weight):
    usable = [row for row in rows if row[1] != []]
    check(usable, whitening.whiten(frame_of(spark, rows), weight=weight, min_rows=10).collect(), weight)


def test_fewer_dimensions_than_components(spark):
    r = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(80, 3)).tolist())]
    # A direction that never changes is no component; vectors of another length are left out.
    rows = [(i, [*v, 5.0]) for i, v in rows]
    check(rows, whitening.whiten(frame_of(spark, [*rows, (900, [1.0, 2.0])])).collect())


def test_no_variance_and_no_rows(spark):
    for rows in ([], [(1, None)], [(1, []), (2, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        frame = whitening.whiten(frame_of(spark, rows))
        assert frame.count() == 0 and len(frame.columns) == 7


def test_large_numbers():
    """Whole numbers beyond 64 bits stay exact."""
    r = np.random.default_rng(7)
    x = r.integers(-(2**50), 2**50, (50, 4))
    sums = np.array([sum(map(int, c)) for c in x.T], dtype=object)
    for n in (50, 10**9, 10**12):
        assert whitening.deviations(x, n, sums) == [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
        exact = np.array([[float(int(v) - int(s) // n) - (int(s) % n) / n for v, s in zip(row, sums)] for row in x])
        assert np.allclose(whitening._centred(x, n, sums), exact, rtol=1e-12)


def test_weight_is_known(spark):
    with pytest.raises(ValueError, match="one or count"):
        whitening.whiten(frame_of(spark, [(1, [1.0])]), weight="two")


def test_query(spark, small):
    rows = [tuple(x) for x in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    frame = queries.op11_whitening(spark, small)
    assert dict(frame.dtypes)["deviation"] == "bigint" and dict(frame.dtypes)["component"] == "int"
    check(rows, frame.collect())
