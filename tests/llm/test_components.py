import random

from riskweave.llm.components import connected


def roots(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_against_union_find(spark):
    r = random.Random(6)
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 560)]
    loose = [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(40)]
    odd = [(1, 1), (None, 2), (3, None), (-5, 7), (7, -5), (7, 8)]
    links = path + star + loose + odd + path[:5]
    frame = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = [tuple(x) for x in connected(frame).collect()]
    assert len(got) == len(dict(got)) and dict(got) == roots(links)
    assert connected(frame.limit(0)).count() == 0
