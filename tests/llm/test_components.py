import random

import pytest

from strataport.llm import components as C


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return sorted((x, find(x)) for x in root)


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    n = 300
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)], "none": []}[kind]
    rng.shuffle(edges)
    edges += [(5, 5), (None, 3)] + edges[:3]
    df = spark.createDataFrame(edges, "a long, b long").repartition(40)  # few edges a task, so that the steps have work
    assert sorted(tuple(r) for r in C.components(df).collect()) == brute(edges)
