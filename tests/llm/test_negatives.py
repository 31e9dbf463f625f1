import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlight.llm import negatives


def _rows(seed: int) -> list[tuple]:
    """Clusters, 120 copies of one vector, repeated rows, a shared id, and rows that take no part."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        x = r.normal(size=6) if i % 4 == 0 else np.array(rows[r.integers(len(rows))][1]) + r.normal(size=6) * 0.1
        if i % 5 == 0 and i:
            x = np.array(rows[3][1])
        rows.append((i, [float(np.float32(v)) for v in x], int(r.integers(10)) if i % 17 else None))
    rows += [rows[100], rows[100], rows[100], (100, rows[101][1], rows[100][2]), (None, rows[4][1], 1), (700, None, 1), (800, [0.0] * 6, 1)]
    rows += [(900, [1.0, None] * 3, 0), (1000, [float("nan")] * 6, 0), (1100, [float("inf")] * 6, 0), (1200, [1.0, 2.0], 0), (1201, [1.0, 2.0], 0)]
    rows += [(1202, [1.0, 1.9], 1), (1300, [], 0), (1301, [], 0), (1302, [], 3), (1400, [3e6] * 6, 2), (1403, [3e6] * 6, 2), (1404, [2.9e6] * 6, 3)]
    return rows


def _plain(rows: list[tuple]) -> list[tuple]:
    use = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all():
            use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for at, (a, label, mine) in enumerate(use):
        if a % 100:
            continue
        score = [sum(p * q for p, q in zip(mine, v, strict=True)) if len(v) == len(mine) else None for _, _, v in use]
        others = [k for k in range(len(use)) if k != at and score[k] is not None]
        positives = sorted((-score[k], use[k][0]) for k in others if use[k][1] == label)[:5]
        for s, p in positives:
            fits = sorted((-score[k], use[k][0]) for k in others if use[k][1] != label and -80 * s <= 100 * score[k] <= -100 * s)[:5]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fits)]
    return sorted(out)


def _moved(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("vec_id", "embedding", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "1 AS gid", "2 AS rank", "3 AS id")


@pytest.mark.parametrize(("seed", "leaf", "block", "chunk"), [(1, 1024, 2048, 512), (2, 16, 8, 3)])
def test_negatives_against_all_pairs(spark, seed, leaf, block, chunk):
    rows = _rows(seed)
    got = negatives.mine(_moved(spark, rows), F.col("vec_id") % 100 == 0, leaf=leaf, fan=4, block=block, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == _plain(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_empty_table(spark):
    assert negatives.report(_moved(spark, _rows(1)).limit(0)).count() == 0


def test_siblings_out_of_the_window_are_dropped():
    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 16)) * 100
    x = np.floor(np.repeat(centres, 200, 0) + r.normal(size=(1600, 16)))
    longest = float((x * x).sum(1).max())
    tree = negatives.grow(x[::3], longest, 16)
    for node in tree.nodes:
        k = len(node.points)
        node.low, node.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)

    def seen(node, j, d):
        node.low[:, j], node.high[:, j] = np.minimum(node.low[:, j], d.min(0)), np.maximum(node.high[:, j], d.max(0))

    leaf = negatives.deal(tree, negatives._lift(x, longest), seen)
    anchors = negatives._anchor(x[::100])
    d = negatives._distances(anchors, negatives._lift(x, longest))
    least, greatest = np.quantile(d, 0.02, 1), np.quantile(d, 0.1, 1)
    hit = negatives.reached(tree, anchors, least, greatest)
    inside = (d >= least[:, None]) & (d <= greatest[:, None])
    assert all(hit[a, leaf[p]] for a, p in zip(*np.nonzero(inside), strict=True))
    assert hit.mean() < 0.7


def test_products_beyond_a_double_are_whole_numbers():
    a = np.array([[3 << 26, 1]], np.int64)
    assert negatives._products(a, a)[0, 0] == (3 << 26) ** 2 + 1
