"""The classifiers' array code against walks over one row, one tree and one word at a time."""

import math
import re
from collections import Counter

import numpy as np

from patchlight.llm import quality, toxicity
from patchlight.llm.kernels import U64, hashes
from tests.llm.helpers import odd_documents, table


def _walk(forest, x):
    value = forest.start
    for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        value += leaf[node - len(feature)]
    return 1 / (1 + math.exp(-value))


def test_scores_are_walks_down_every_tree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality AS y").where("y IS NOT NULL")
    forest = quality.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, t) for k, (_, t, _) in enumerate(odd_documents(n=20))]
    got = {r.doc_id: r.score for r in quality.score(table(spark, [(i, t, "s") for i, t in rows]), forest).collect()}
    for i, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        x = quality.statistics(raw, np.array([0, len(raw)]))[0]
        assert abs(got[i] - _walk(forest, x)) < 1e-9
    assert len(forest.feature) == quality.TREES


def test_statistics_of_a_text(spark):
    text = "One two two\n\nTWO three; Four 77!\nOne two two"
    raw = np.frombuffer(text.encode(), np.uint8)
    x = quality.statistics(raw, np.array([0, len(raw)]))[0]
    words = text.split()
    assert np.allclose(x[:4], [math.log1p(len(text)), math.log1p(len(words)), np.mean([len(w) for w in words]), np.std([len(w) for w in words])])
    low = Counter(w.lower() for w in words)
    assert np.allclose(x[4:6], [len(low) / len(words), max(low.values()) / len(words)])
    # Lines with their ends: the last has none, so no two are equal.
    assert np.allclose(x[8:11], [1.0, 1 / 4, math.log1p(4)])


def test_first_split_is_the_best_of_all_cuts():
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(300, 3)), 2)
    y = ((x[:, 1] > 0.3) ^ (r.random(300) < 0.1)).astype(float)
    forest = quality.grow(x, y, trees=1, depth=1, least=20)
    p = y.mean()
    cuts = np.quantile(x, np.arange(1, quality.BINS) / quality.BINS, axis=0).T

    def gain(j, cut):
        left = x[:, j] <= cut
        if min(left.sum(), (~left).sum()) < 20:
            return -1
        part = lambda m: (y[m] - p).sum() ** 2 / (m.sum() * p * (1 - p) + quality.SHRINK)
        return part(left) + part(~left)

    j, cut = max(((j, c) for j in range(3) for c in cuts[j]), key=lambda a: gain(*a))
    assert (forest.feature[0][0], forest.cut[0][0]) == (j, cut)
    right = x[:, j] > cut
    step = quality.RATE * (y[right] - p).sum() / (right.sum() * p * (1 - p) + quality.SHRINK)
    assert abs(forest.leaf[0][1] - step) < 1e-9


def _one(word: bytes, part: int | None = None) -> int:
    raw = np.frombuffer(word if part is None else word[:part], np.uint8)
    h = hashes(raw, np.array([0]), np.array([len(raw)]))[0]
    h = h if part is None else h ^ U64(0x9E3779B97F4A7C15 * part % (1 << 64))
    return int(h >> U64(64 - toxicity.BITS))


def test_toxicity_scores_are_sums_over_words(spark):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(odd_documents(11, 40))]
    features = Counter()
    for _, t, _ in rows:
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())):
            features.update([_one(w), *[_one(w, n) for n in toxicity.BEGINNINGS if len(w) > n]])
    r = np.random.default_rng(1)
    chosen = np.sort(r.choice(sorted(features), 60, replace=False))
    model = toxicity.Model(chosen, r.normal(size=60), -0.7)
    weight = dict(zip(chosen.tolist(), model.weight, strict=True))
    got = {x.doc_id: x.score for x in toxicity.scored(table(spark, rows), model).collect()}
    for i, t, _ in rows:
        count = Counter()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())):
            count.update(h for h in [_one(w), *[_one(w, n) for n in toxicity.BEGINNINGS if len(w) > n]] if h in weight)
        z = model.bias + sum(weight[h] * math.log1p(n) for h, n in count.items())
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
