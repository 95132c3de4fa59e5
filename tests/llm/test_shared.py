import random

import pytest

from retort.llm.shared import connected


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)], [(60 - i, 59 - i) for i in range(60)], [(0, i) for i in range(1, 50)], [(99, i) for i in range(50)],
    [(random.Random(i).randrange(200), random.Random(i + 999).randrange(200)) for i in range(150)], [(1, 1), (2, 3), (3, 2), (2, 3)], [],
], ids=["path", "back", "star", "high", "random", "loops", "none"])
def test_components(spark, edges):
    got = connected(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))
