import random

import pytest

from fringework.operators import graph


@pytest.mark.parametrize("local", [0, 10**6])
def test_components_by_rounds_and_by_one_task(spark, local):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(1_000, 1_200)] + [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(7, 7), (-(1 << 62), 5)]
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), local).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((n, find(n)) for n in parent)
    assert graph.components(spark.createDataFrame([], "a long, b long"), local).count() == 0
