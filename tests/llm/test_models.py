"""Classifiers by held-out accuracy, the token counter by the library's own counts."""

import random

import numpy as np
import pytest

from patchlight.llm import quality, tokencount, toxicity
from tests.llm.helpers import odd_documents, table


def _held(df, labels, column):
    y = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    rows = [(r.score, r.predicted, y[r.doc_id]) for r in df.where("held_out").collect() if r.doc_id in y]
    return rows, np.mean([p == t for _, p, t in rows])


def test_quality_on_held_out_rows(spark, sf):
    path = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = quality.classify(docs, labels)
    assert got.count() == docs.count()
    assert _held(got, labels, "quality")[1] >= 0.97


def _toxic_corpus(spark, n=900):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = ["w%d" % r.randrange(400) for _ in range(r.randint(3, 120))]
        toxic = i % 8 == 0
        for _ in range(r.randint(1, 4) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["vileness", "vilely", "Hateful"]))
        rows.append((i, " ".join(w), "s"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = _toxic_corpus(spark)
    docs = table(spark, rows + odd_documents()[60:])
    got = toxicity.classify(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert _held(got, labels, "toxic")[1] >= 0.97
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert not any((r.doc_id or 1) % 8 == 0 for r in kept.where("doc_id < 900 AND text LIKE '%vil%'").collect())
    assert kept.where("doc_id < 900 AND doc_id % 8 <> 0").count() >= 0.98 * 787


def test_classifiers_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, odd_documents(n=5))
    assert {r.score for r in quality.classify(docs, labels).collect()} == {0.5}
    assert toxicity.classify(docs, labels).where("predicted = 1").count() == 0
    odd = spark.createDataFrame([(0, 1, 1), (1, None, None), (None, 0, 1), (2, 0, 7), (0, 0, 0)], "doc_id long, quality int, toxic int")
    for f in (quality.classify, toxicity.classify):
        assert f(docs, odd).count() == docs.count()
        assert f(docs.limit(0), odd).count() == 0


def test_risk_is_kept_from_going_negative():
    r = np.random.default_rng(0)
    p, u = r.normal(2, 1, (200, 3)), np.vstack((r.normal(2, 1, (40, 3)), r.normal(-2, 1, (360, 3))))
    w, b = toxicity.fit(p, u, 0.1)
    score = 1 / (1 + np.exp(-(u @ w + b)))
    assert score[:40].mean() > 0.8 and score[40:].mean() < 0.1


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_are_the_library_s(spark, sf, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = tokencount.read_vocabulary()
    v = tokencount.Vocabulary(v.pieces, v.scores, v.unknown, fallback)
    lib = Tokenizer(models.Unigram(list(zip(v.pieces, v.scores, strict=True)), unk_id=v.unknown, byte_fallback=fallback))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    odd = ["", "a", " a", "a  b", "  ", "日本語 語", "<unk>", "é<unk>x 😀😀", "<unk><unk>", "\n\n a\tb", "▁▁x", "<s>hi</s>", "<0x41>", "𝔘𝔫", " ", "aaaa" * 300, "x" * 20_000, "\x00\x01"]
    texts = odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = table(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, None, None)])
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, v).collect()}
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want and got[None] == 0


def test_ties_go_to_the_earlier_start():
    v = tokencount.Vocabulary(("<unk>", "▁", "a", "b", "ab", "▁a"), (0.0, -1.0, -1.0, -1.0, -2.0, -2.0), 0, False)
    from tokenizers import Tokenizer, models, pre_tokenizers

    lib = Tokenizer(models.Unigram(list(zip(v.pieces, v.scores, strict=True)), unk_id=0, byte_fallback=False))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counts = tokencount.Counts(tokencount.counter(v))
    for text in ("ab", "abab", "aab bab", "ba abc cc"):
        assert tokencount.tokens(text, counts) == len(lib.encode(text, add_special_tokens=False).ids)


def test_training_on_counts_holds_no_full_matrix_of_logs():
    import tracemalloc

    r = np.random.default_rng(3)
    p, u = r.poisson(0.3, (700, 40)).astype(np.uint16), r.poisson(0.1, (2500, 40)).astype(np.uint16)
    w, b = toxicity.fit(p, u, 0.1)
    w2, b2 = toxicity.fit(np.log1p(p.astype(np.float64)), np.log1p(u.astype(np.float64)), 0.1)
    assert np.allclose(w, w2, atol=1e-2) and abs(b - b2) < 1e-2
    big = r.poisson(0.05, (toxicity.POSITIVES + toxicity.UNLABELLED, toxicity.FEATURES)).astype(np.uint16)
    rounds, toxicity.ROUNDS = toxicity.ROUNDS, 3
    tracemalloc.start()
    try:
        toxicity.fit(big[: toxicity.POSITIVES], big[toxicity.POSITIVES :], 0.1)
        assert tracemalloc.get_traced_memory()[1] < big.nbytes // 2
    finally:
        tracemalloc.stop()
        toxicity.ROUNDS = rounds


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_of_long_segments(fallback):
    """Segments without a space, longer than a block, unknown runs over its border: the library's counts and a bounded search."""
    import tracemalloc

    from tokenizers import Tokenizer, models, pre_tokenizers

    v = tokencount.read_vocabulary()
    v = tokencount.Vocabulary(v.pieces, v.scores, v.unknown, fallback)
    lib = Tokenizer(models.Unigram(list(zip(v.pieces, v.scores, strict=True)), unk_id=v.unknown, byte_fallback=fallback))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rnd = random.Random(3)
    alphabet = "abcdeiorstnlu" * 3 + "的是不\U0001f600\u0e99\u1abe=;{}"
    texts = ["".join(rnd.choice(alphabet) for _ in range(n)) for n in (4_094, 4_095, 4_096, 4_097, 4_200, 8_190, 20_000)]
    texts += ["a" * 9_000, "\u1abe" * 9_000, "x" * 4_000 + "\u1abe" * 300 + "y" * 4_000, " ".join(["ab" * 3_000] * 2)]
    counts = tokencount.Counts(tokencount.counter(v))
    assert [tokencount.tokens(t, counts) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert all(len(k) <= tokencount.LONG for k in counts)
    long = "thequickbrownfox" * 20_000
    tracemalloc.start()
    tokencount.tokens(long, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000


def test_token_cache_is_bounded_by_its_characters(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE", 50)
    counts = tokencount.Counts(len)
    assert [counts["w" * (i % 20)] for i in range(300)] == [1 + i % 20 for i in range(300)]
    assert sum(len(k) + 1 for k in counts) == counts.held <= 50


def test_token_counts_of_repeated_rows_and_no_rows(spark):
    v = tokencount.read_vocabulary()
    rows = [(1, "same words"), (1, "same words"), (None, "same words"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.n_tokens for r in tokencount.count_tokens(df, v).collect()]
    assert len(got) == 5 and got[0] == got[1] == got[2] > 0 and got[3:] == [0, 0]
    assert tokencount.count_tokens(df.limit(0), v).count() == 0
