"""Connected components against a plain union."""

from __future__ import annotations

import random

from storyflow.llm.common import Scratch, components


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(1000, 1060)]  # a chain
    edges += [(7, i) for i in range(2000, 2200)] + [(5000, 5000)]  # a hub, a loop
    edges += [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] * 2
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).df.collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long")).df.count() == 0
