"""Toxicity by non-negative positive-unlabelled learning.

A text is a bag of lower-cased words and word beginnings (4, 5 and 6 bytes), hashed. Features that stand out in confirmed toxic
texts against unlabelled text are kept (a fixed number); a logistic model over their log counts is trained from the toxic
examples and unlabelled texts with the class-prior-corrected risk

    prior * loss(toxic, 1) + max(0, loss(unlabelled, 0) - prior * loss(toxic, 0)),

where a negative second part is pushed back instead of down. The class prior is the share of toxic rows among the labelled ones.
Both samples are bounded (`POSITIVES`, `UNLABELLED`, parameters); the model is one table of fixed size.

Whole texts are scored. Null or empty texts get the model's base score. Every row gives one row. Without toxic examples all score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import settled
from patchlight.llm.kernels import LOWER, U64, hashes, slices, texts, words
from patchlight.llm.labelled import first_by_hash, one_label, remainder, with_texts

POSITIVES, UNLABELLED = 4_000, 12_000
BITS, FEATURES, LEAST, LIFT, EXCESS = 22, 512, 4, 0.5, 3.0
BEGINNINGS = (4, 5, 6)
ROUNDS, STEP, SHRINK = 400, 0.1, 1e-4
#: Rows whose log counts exist at one time in the training.
ROWS = 1_024
#: Bytes that count as parts of words here; others separate.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(48, 58), *range(128, 256)]] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, and the text each belongs to."""
    data = LOWER[np.where(_LETTER[data], data, np.uint8(32))]
    starts, ends, of = words(data, offsets)
    kept, owner = [hashes(data, starts, ends) >> U64(64 - BITS)], [of]
    for n in BEGINNINGS:
        long = ends - starts > n
        s = starts[long]
        kept.append((hashes(data, s, s + n) ^ U64(0x9E3779B97F4A7C15 * n % (1 << 64))) >> U64(64 - BITS))
        owner.append(of[long])
    return np.concatenate(kept).astype(np.int64), np.concatenate(owner)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        for a, b in slices(offsets, 2 << 20):
            yield batch.slice(a, b - a), *_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


@dataclass
class Model:
    """Chosen features (sorted), their weights and the bias; base is the score without any model."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def counts(self, h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        if not len(self.feature):
            return np.zeros((n, 0))
        at = np.minimum(np.searchsorted(self.feature, h), len(self.feature) - 1)
        hit = self.feature[at] == h
        return np.bincount(of[hit] * len(self.feature) + at[hit], minlength=n * len(self.feature)).reshape(n, -1)

    def probability(self, h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.log1p(self.counts(h, of, n)) @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _blocks(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Log counts of ROWS rows each; counts are looked up, other rows are log counts already."""
    logs = np.log1p(np.arange(int(rows.max(initial=0)) + 1, dtype=np.float32)) if rows.dtype.kind == "u" else None
    held = np.empty((min(ROWS, len(rows)), rows.shape[1]), np.float32) if logs is not None else None
    for a in range(0, len(rows), ROWS):
        part = rows[a : a + ROWS]
        yield part if logs is None else np.take(logs, part, out=held[: len(part)], mode="clip")


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk; rows are counts (unsigned) or log counts. The gradient is summed over blocks of rows."""
    width = positive.shape[1]
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def pulls(rows: np.ndarray) -> tuple[np.ndarray, float]:
        """Mean over rows of (row, 1) times the probability, and of the log of the other class's probability."""
        by, rest = np.zeros(width + 1), 0.0
        for x in _blocks(rows):
            p = sigmoid(x @ w[:-1].astype(x.dtype) + w[-1])
            by += np.append(p.astype(x.dtype) @ x, p.sum())
            rest += np.log(1 - p + 1e-7).sum()
        return by / len(rows), rest / len(rows)

    all_p = np.append(sum(x.sum(0, dtype=np.float64) for x in _blocks(positive)) / len(positive), 1.0)
    for t in range(1, ROUNDS + 1):
        (by_p, rest_p), (by_u, rest_u) = pulls(positive), pulls(unlabelled)
        rest = -rest_u + prior * rest_p
        down = by_u - prior * by_p
        grad = -prior * (all_p - by_p) + (down if rest >= 0 else -down) + SHRINK * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """labels: doc_id, y of the rows that may be learnt from.

    Unlabelled text is drawn from the same rows with their labels unseen, so that the class prior is that of the unlabelled text too.
    """
    n, n_pos = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    none = Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    if not n_pos:
        return none
    prior = min(max(n_pos / n, 1e-4), 0.5)
    toxic = first_by_hash(labels.where("y = 1").select("doc_id", F.lit(1).alias("known")), positives)
    plain = first_by_hash(labels.select("doc_id", F.lit(0).alias("known")), unlabelled)
    # A bounded sample with its texts, read twice below.
    sample = settled(with_texts(toxic.union(plain), documents))

    def tally(batches):
        seen: dict[int, list[np.ndarray]] = {0: [], 1: []}
        for batch, h, of in _parts(batches):
            known = batch.column("known").to_numpy()
            pair = np.unique(of.astype(np.int64) << 32 | h)
            for k in (0, 1):
                seen[k].append(pair[known[pair >> 32] == k] & 0xFFFFFFFF)
        for k, arrays in seen.items():
            values, count = np.unique(np.concatenate([np.zeros(0, np.int64), *arrays]), return_counts=True)
            for a in range(0, len(values), 100_000):
                yield pa.RecordBatch.from_pydict({"feature": values[a : a + 100_000], "n": count[a : a + 100_000].astype(np.int64), "known": np.full(len(values[a : a + 100_000]), k)})

    sizes = dict(sample.groupBy("known").count().collect())
    if not sizes.get(1) or not sizes.get(0):
        return none
    counts = sample.mapInArrow(tally, "feature long, n long, known long").groupBy("feature").agg(
        F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("known") == 0, F.col("n")).otherwise(0)).alias("u")
    )
    # A feature of toxic texts only is 1 / prior times as frequent among them as in unlabelled text; half of that is asked for,
    # and that the count lies well above what unlabelled text would give.
    share_p, share_u = F.col("p") / sizes[1], F.col("u") / sizes[0]
    expected = share_u * sizes[1]
    excess = (F.col("p") - expected) / F.sqrt(expected + 1)
    stands_out = (F.col("p") >= min(LEAST, sizes[1])) & (share_p > LIFT / prior * share_u) & (excess >= EXCESS)
    chosen = counts.where(stands_out).orderBy(excess.desc(), "feature").limit(FEATURES).select("feature").toArrow()
    model = Model(np.sort(chosen["feature"].to_numpy()), np.zeros(len(chosen)), 0.0)

    def vectors(batches):
        for batch, h, of in _parts(batches):
            x = np.minimum(model.counts(h, of, batch.num_rows), 65535).astype(np.uint16)
            yield pa.RecordBatch.from_pydict({"known": batch.column("known").cast("int32"), "doc_id": batch.column("doc_id"), "x": pa.array([row.tobytes() for row in x], pa.binary())})

    width = len(model.feature)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("known", "descending"), ("doc_id", "ascending")])
        known = table["known"].to_numpy()
        x = np.frombuffer(b"".join(table["x"].to_pylist()), np.uint16).reshape(len(known), width)
        ones = int(np.searchsorted(-known, 0))
        weight, bias = fit(x[:ones], x[ones:], prior)
        return pa.table({"place": np.arange(width + 1), "weight": np.append(weight, bias).astype(np.float64)})

    # The bounded sample meets in one task, so that neither it nor the training weighs on the driver.
    got = sample.mapInArrow(vectors, "known int, doc_id long, x binary").groupBy(F.col("known") * 0).applyInArrow(learn, "place long, weight double").toArrow().sort_by("place")
    weight = got["weight"].to_numpy()
    model.weight, model.bias = weight[:-1], float(weight[-1])
    return model


def scored(documents: DataFrame, model: Model, keep_below: float | None = None) -> DataFrame:
    """doc_id, score of every row; or, with keep_below, the whole rows whose score lies below it."""
    if keep_below is None:

        def run(batches):
            for batch, h, of in _parts(batches):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": model.probability(h, of, batch.num_rows)})

        return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")

    def clean(batches):
        for batch, h, of in _parts(batches):
            yield batch.filter(pa.array(model.probability(h, of, batch.num_rows) < keep_below))

    return documents.mapInArrow(clean, documents.schema)


def known_labels(labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    return one_label(labels, "toxic").where(remainder(F.col("doc_id"), folds) != held)


def classify(documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    model = train(documents, known_labels(labels, folds, held))
    return scored(documents, model).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of documents that score below the threshold."""
    return scored(documents, train(documents, known_labels(labels)), keep_below=threshold)
