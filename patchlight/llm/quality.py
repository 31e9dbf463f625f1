"""Quality: histogram gradient-boosted trees over statistics of the whole text.

Statistics come from array code over Arrow batches (any length of text, null counts as empty). Trees are grown on the driver from a
bounded sample of labelled rows (`SAMPLE`, a parameter); the grown forest is a few arrays (feature, cut, leaf value per node of
complete trees), a fixed size whatever the corpus, and rows are scored by walking all trees level by level on whole batches.

Empty or null texts have all statistics 0 and get the forest's value for that. Every input row gives one output row, repeated rows
too. Without labels the score is 0.5 for all. A null id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.kernels import LOWER, grams, hashes, slices, texts, words
from patchlight.llm.labelled import first_by_hash, one_label, remainder, with_texts

#: Labelled rows that trees are grown on, at most.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE, LEAST, SHRINK = 120, 4, 64, 0.1, 20, 1.0

_KIND = np.zeros(256, np.int64)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[10] = 5
_KIND[[33, 63]] = 6
_KIND[[44, 46, 58, 59]] = 7
_KIND[[35, 36, 37, 38, 42, 64, 94, 126]] = 8
_KIND[[124, 60, 62, 123, 125, 91, 93, 95, 61, 43, 92, 47]] = 9
_KIND[128:] = 10
_KINDS = 11


def _distinct_share(of: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct keys / keys, and the most frequent key's share."""
    order = np.lexsort((keys, of))
    d, k = of[order], keys[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(d)))
    total = np.maximum(np.bincount(of, minlength=n), 1)
    top = np.zeros(n)
    np.maximum.at(top, d[at], runs)
    return np.bincount(d[at], minlength=n) / total, top / total


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    of_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(of_byte * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    starts, ends, of = words(data, offsets)
    count = np.bincount(of, minlength=n)
    some, length = np.maximum(count, 1), ends - starts
    mean = np.bincount(of, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(of, length.astype(float) ** 2, n) / some - mean**2, 0))
    h = hashes(LOWER[data], starts, ends)
    last, first = data[ends - 1] if len(ends) else data[:0], data[starts] if len(starts) else data[:0]
    distinct, top = _distinct_share(of, h, n)
    five = grams(h, 5)
    same = of[4:] == of[:-4] if len(of) > 4 else np.zeros(0, bool)
    distinct5, top5 = _distinct_share(of[:-4][same], five[same], n) if len(of) > 4 else (np.zeros(n), np.zeros(n))
    breaks = np.flatnonzero((data == 10) & (np.append(of_byte[1:] == of_byte[:-1], False) if len(data) else np.zeros(0, bool)))
    line_starts = np.sort(np.concatenate((offsets[:-1][size > 0], breaks + 1)))
    line_of = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.append(line_starts[1:], len(data)) if len(line_starts) else line_starts
    lines, top_line = _distinct_share(line_of, hashes(data, line_starts, line_ends), n)
    n_lines = np.bincount(line_of, minlength=n)
    upper = _KIND[first] == 1
    return np.column_stack((
        np.log1p(size), np.log1p(count), mean, spread, distinct, top, distinct5, top5, lines, top_line, np.log1p(n_lines), size / np.maximum(n_lines, 1),
        kinds / np.maximum(size, 1)[:, None], np.bincount(of, upper, n) / some, np.bincount(of, ~np.isin(_KIND[last], (1, 2, 10)), n) / some,
        np.bincount(of, _KIND[last] >= 8, n) / some, np.bincount(of, length == 1, n) / some, np.bincount(of, length > 20, n) / some,
    ))


@dataclass
class Forest:
    """Complete trees of one depth: inner nodes of each tree in level order, then its leaves."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        value = np.full(len(x), self.start)
        rows, depth = np.arange(len(x)), int(self.feature.shape[1] + 1).bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            value += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST) -> Forest:
    """Boost trees on the logistic loss; splits are searched in histograms of quantile bins."""
    inner, m = (1 << depth) - 1, x.shape[1] if len(x) else 0
    if not len(x) or y.min() == y.max():
        base = 0.0 if not len(x) else float(np.log((y.mean() * len(y) + 1) / ((1 - y.mean()) * len(y) + 1)))
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = np.quantile(x, np.arange(1, bins) / bins, axis=0).T
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    value, out = np.full(len(x), start), ([], [], [])
    flat = binned + np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-value))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for level in range(depth):
            first, k = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (m * bins) + flat).ravel()
            hist = [np.bincount(at, np.repeat(v, m), k * m * bins).reshape(k, m, bins).cumsum(2) for v in (g, h, np.ones(len(x)))]
            gl, hl, nl = (v[:, :, :-1] for v in hist)
            gt, ht, nt = (v[:, :, -1:] for v in hist)
            gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(k, -1).argmax(1)
            for i in range(k):
                if gain[i].flat[best[i]] > 1e-9:
                    feature[first + i], b = divmod(int(best[i]), bins - 1)
                    cut[first + i] = cuts[feature[first + i], b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + SHRINK)
        value = value + leaf[at]
        for many, one in zip(out, (feature, cut, leaf), strict=True):
            many.append(one)
    return Forest(start, *map(np.array, out))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        for a, b in slices(offsets):
            yield batch.slice(a, b - a), statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """labels: doc_id, y. Only the sample's statistics (a few dozen numbers a row) come to the driver."""
    ids = first_by_hash(labels.select("doc_id", "y"), sample)

    def features(batches):
        for batch, x in _batches(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y").cast("int32"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    got = with_texts(ids, documents).mapInArrow(features, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist(), dtype=float) if len(got) else np.zeros((0, 1))
    return grow(x, got["y"].to_numpy().astype(float))


def score(documents: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches):
        for batch, x in _batches(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": forest.probability(x)})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.5) -> DataFrame:
    known = one_label(labels, "quality").where(remainder(F.col("doc_id"), folds) != held)
    scored = score(documents, train(documents, known))
    return scored.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
