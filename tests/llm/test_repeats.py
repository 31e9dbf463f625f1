import pytest

from patchlight.llm import phrases, substrings
from tests.llm.helpers import odd_documents, rows_of, table


def _phrases(rows, n):
    first = {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            if i is not None:
                g = tuple(w[k : k + n])
                first[g] = min(first.get(g, (i, k)), (i, k))
    out = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < (i, k):
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), bytearray(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [7, 8])
def test_repeated_passages_against_all_windows(spark, seed):
    rows = odd_documents(seed)
    assert rows_of(phrases.remove_repeats(table(spark, rows))) == _phrases(rows, 20)


def _substrings(rows, n):
    seen = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1) if i is not None else ():
            s = b[k : k + n]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1) if i is not None else ():
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytearray(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b))), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "length", "gram", "frequent"), [(7, 60, 12, 8192), (8, 90, 20, 2), (9, 400, 64, 8192)])
def test_repeated_strings_against_all_strings(spark, seed, length, gram, frequent):
    rows = [r for r in odd_documents(seed) if length < 400 or len(r[1] or "") < 20_000]
    rows.append((900, "ab" * 700 + (rows[7][1] or ""), "a"))
    assert rows_of(substrings.remove_repeats(table(spark, rows), length, gram, frequent)) == _substrings(rows, length)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from patchlight.llm.kernels import texts

    r = np.random.default_rng(3)
    text = "".join(map(chr, r.integers(97, 123, 5000)))
    data, offsets = texts(pa.array([text]))
    whole = substrings.stretches(data, offsets, 60, 12)
    monkeypatch.setattr(substrings, "PIECE", 700)
    parts = substrings.stretches(data, offsets, 60, 12)
    starts = lambda s: sorted((int(a), int(x) + k) for a, x, c in zip(s[0], s[3], s[4], strict=True) for k in range(c))
    assert starts(whole) == starts(parts) and len(starts(whole)) == 5000 - 59


def test_empty_table(spark):
    assert phrases.remove_repeats(table(spark, [])).count() == 0
    assert substrings.remove_repeats(table(spark, [])).count() == 0
