import random

import pytest

from patchlight.llm import links


def _reach(edges):
    low = {x: x for e in edges for x in e}
    while True:
        before = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


@pytest.mark.parametrize("kind, steps", [("stars", 0), ("paths", 6), ("random", 6), ("none", 0)])
def test_components_take_no_step_once_links_are_stars(spark, monkeypatch, kind, steps):
    rnd = random.Random(3)
    edges = {
        "stars": [(k * 100 + i, k * 100) for k in range(5) for i in range(1, 20)] + [(9, 9), (1, 0)],
        "paths": [(i, i + 1) for i in range(30)] + [(90, 40), (40, 60)],
        "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)], "none": [],
    }[kind]
    written, settled = [], links.settled
    monkeypatch.setattr(links, "settled", lambda df: written.append(1) or settled(df))
    got = links.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = _reach([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert len(written) - 1 <= steps
