import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from patchlight.llm import recipes
from tests.llm.helpers import odd_documents, rows_of, table

SPACE = re.compile("[\x20\x09-\x0d]+")


def _plain(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out, done = [], set()
    for i, t, _ in rows:
        t = SPACE.sub(" ", t or "")
        keep = min((x for x in groups[t] if x is not None), default=None)
        kept = i == keep and t not in done
        done |= {t} if kept else set()
        out.append((i, keep, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows(seed):
    """Copies with other white space, long texts that differ in the first or last byte, and a group that is half of all rows."""
    r = random.Random(seed)
    rows = odd_documents(seed, 80)
    long = "".join(r.choice("abcdefgh \n") for _ in range(60_000))
    rows += [(500, long, "a"), (501, long, "b"), (502, long[:-1] + "z", "a"), (503, "z" + long[1:], "a"), (504, " " + long.strip(), "a")]
    rows += [(600 + k, "the same\t text" if k % 2 else "the  same text", "a") for k in range(100)]
    rows += [(700 + k, None if k % 2 else "", None) for k in range(10)]
    return rows


@pytest.mark.parametrize(("seed", "bits", "width"), [(7, 25, 16), (8, 6, 1), (9, 25, 1)])
def test_groups_against_whole_texts(spark, seed, bits, width):
    """One-byte digests stand for many contents, which only their bytes tell apart; six bits send every document to verification."""
    rows = _rows(seed)
    found = recipes.exact_duplicates(table(spark, rows), bits, width)
    assert rows_of(found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")))) == _plain(rows)


def test_one_of_each_group_stays(spark):
    rows = _rows(7)
    kept = recipes.keep_one(table(spark, rows)).agg(F.count("*"), F.sum("group_size")).first()
    assert tuple(kept) == (len({SPACE.sub(" ", t or "") for _, t, _ in rows}), len(rows))
    assert recipes.report(table(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 40_000, (1 << 20) + 17])
def test_chunks_are_bounded_and_depend_on_nearby_bytes(n):
    r = random.Random(n)
    text = bytes(r.choices(b"abcdefghij ", k=n))
    ends = recipes.cuts(text)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == n and max(sizes) <= recipes.MOST and all(s >= recipes.LEAST for s in sizes[:-1])
    moved = [e - 700 for e in recipes.cuts(b"y" * 700 + text)]
    assert n < 30_000 or len(set(moved) & set(ends)) > 0.8 * len(ends)
    assert max(recipes.cuts(b"a" * n)) == n


@pytest.mark.parametrize("text", ["", " ", "\n\t", " a", "a ", "a\x0b\x0c\rb", "a b", " a\x1f b"])
def test_white_space_is_six_bytes(text):
    assert recipes.normalised(text.encode()) == SPACE.sub(" ", text).encode()
