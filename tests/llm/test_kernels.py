import numpy as np
import pyarrow as pa

from patchlight.llm import kernels, suffixes
from tests.llm.helpers import WORD


def _words(texts):
    data, offsets = kernels.texts(pa.array(texts))
    starts, ends, of = kernels.words(data, offsets)
    return data, [(int(o), data[s:e].tobytes().decode()) for s, e, o in zip(starts, ends, of, strict=True)], (starts, ends)


def test_words_are_those_of_the_pattern():
    texts = ["a b", None, "", "  c\td\n", "é f\x0bg", "x", "y", " "]
    _, got, _ = _words(texts)
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]


def test_equal_words_have_equal_hashes_across_blocks(monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 7)
    data, got, (s, e) = _words(["abcdefghijklmnop xy abcdefghijklmnop " * 5, "xy abcdefghijklmnop"])
    h = kernels.hashes(data, s, e)
    by = {}
    for (_, w), x in zip(got, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_grams_depend_on_order_and_content():
    h = np.arange(1, 50, dtype=np.uint64)
    for n in (1, 2, 5, 13, 20):
        g = kernels.grams(np.concatenate((h, h)), n)
        assert len(g) == 98 - n + 1 and (g[: 49 - n + 1] == g[49:]).all() and len(np.unique(g)) == 49


def test_suffix_arrays_and_prefixes_against_sorting(monkeypatch):
    r = np.random.default_rng(5)
    for trial in range(120):
        monkeypatch.setattr(suffixes, "NAMES", 0 if trial % 2 else 512)
        x = r.integers(1, r.integers(2, 6), r.integers(1, 50))
        t = np.append(np.tile(x, 3) if trial % 3 == 0 else x, 0).astype(np.uint16)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        got = suffixes.suffix_array(t)
        assert got.tolist() == want
        phi, shared = suffixes.common_prefixes(t, got)
        for i, j in zip(want[1:], want[:-1], strict=True):
            k = 0
            while max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            assert (phi[i], shared[i]) == (j, k)
