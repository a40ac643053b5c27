import math

import numpy as np
import pytest

from riskweave.llm import forest, queries

SCHEMA = "vec_id long, embedding array<double>, label int, unit string, node int"


def brute(rows, cosine=0.93):
    usable = {}
    for i, (vec_id, e, label) in enumerate(rows):
        if vec_id is not None and label is not None and e and None not in e and all(map(math.isfinite, e)) and any(e):
            usable.setdefault((label, len(e)), []).append(i)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for group in usable.values():
        x = np.array([rows[i][1] for i in group], dtype=float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1))):
            parent[find(group[a])] = find(group[b])
            links[group[a]] += 1
            links[group[b]] += 1
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {r[0]: (links[i], least[find(i)], least[find(i)] == r[0]) for i, r in enumerate(rows) if r[0] is not None}


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "u", 1) for r in rows], SCHEMA).repartition(3)
    result = forest.near_duplicates(frame, **options).collect()
    assert len(result) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in result if r.vec_id is not None}


def groups(seed, n, width=16, labels=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 6, width))
    rows = []
    for k in range(n):
        x = centres[r.integers(len(centres))] + r.normal(scale=0.25, size=width)
        rows.append((k, x.tolist(), int(r.integers(labels))))
    return rows


def test_odd_vectors(spark):
    near = [1.0, 0.02, 0.0]
    rows = [
        (0, None, 1), (1, [], 1), (2, [0.0, 0.0, 0.0], 1), (3, [1.0, None, 0.0], 1), (4, [math.nan, 1.0, 0.0], 1),
        (5, [math.inf, 1.0, 0.0], 1), (6, near, None), (7, near, 1), (8, near, 1), (9, [3.0, 0.06, 0.0], 1), (10, near, 2),
        (11, [1.0, 0.0], 1), (12, [1e300, 0.0, 0.0], 1), (13, [1e-300, 0.0, 0.0], 1), (14, [-1.0, 0.0, 0.0], 1), (None, near, 1),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == {}


def test_leaves_of_one_node(spark):
    rows = groups(1, 400)
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(50)]
    assert found(spark, rows) == brute(rows)


def test_deep_trees(spark):
    rows = groups(2, 1500)
    got, want = found(spark, rows, leaf=60, trees=8), brute(rows)
    pairs = sum(w[0] for w in want.values())
    assert pairs > 500 and all(got[k][0] <= want[k][0] for k in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * pairs
    assert np.mean([got[k][1] == want[k][1] for k in want]) >= 0.97


def test_what_cannot_be_split(spark):
    """Vectors of one direction have equal projections: blocks find all pairs."""
    r = np.random.default_rng(3)
    x = r.normal(size=8)
    rows = [(k, (x * (k + 1)).tolist(), 1) for k in range(150)] + [(500 + k, r.normal(size=8).tolist(), 1) for k in range(60)]
    assert found(spark, rows, leaf=20, trees=2)[3][0] == brute(rows)[3][0]
    got, want = found(spark, rows, leaf=20, trees=2), brute(rows)
    assert {k: got[k] for k in range(150)} == {k: want[k] for k in range(150)}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    rows = [tuple(x) for x in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op4_embedding_forest(spark, folder).collect()}
    assert got == brute(rows)
