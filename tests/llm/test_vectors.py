import numpy as np
import pytest

from patchlight.llm import vectors
from tests.llm.helpers import components


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components_against_all_pairs(spark, seed):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(220):
        x = r.normal(size=8) if i % 3 == 0 or not rows else np.array(rows[r.integers(len(rows))][1]) * r.uniform(0.5, 2) + r.normal(size=8) * 0.12
        rows.append((i, [float(np.float32(v)) for v in x], int(i % 2) if i % 17 else None))
    rows += [(300, rows[4][1], rows[4][2]), (301, rows[4][1], rows[4][2]), rows[5], (302, [0.0] * 8, 0), (303, None, 0), (304, [1.0, None] * 4, 0)]
    rows += [(305, [float("nan")] * 8, 0), (306, [float("inf")] * 8, 1), (None, rows[4][1], 0), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (309, [], 0)]
    usable = [k for k, (i, x, label) in enumerate(rows) if i is not None and label is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    links = []
    for a in usable:
        for b in usable:
            (i, x, p), (j, y, q) = rows[a], rows[b]
            if a < b and p == q and len(x) == len(y):
                x, y = np.array(x, np.float64), np.array(y, np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links.append((a, b))
    comp = components({rows[k][0] for k in usable}, [(rows[a][0], rows[b][0]) for a, b in links])
    count = np.bincount([k for pair in links for k in pair], minlength=len(rows))
    want = sorted((i, int(count[k]), comp.get(i, i), i is None or comp.get(i, i) == i) for k, (i, _, _) in enumerate(rows) if i is not None)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS block", "3 AS n")
    got = [tuple(x) for x in vectors.near_duplicates(df, block=16).collect()]
    assert sorted(x for x in got if x[0] is not None) == want
    assert [x for x in got if x[0] is None] == [(None, 0, None, True)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0
