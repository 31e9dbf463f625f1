import hashlib
import zlib

import pytest

from patchlight.llm import manifest
from tests.llm.helpers import odd_documents, rows_of, table

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def _h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(row, text) -> str:
    i, _, source, lang, n = row
    return _h("".join(map(_field, (i, source, lang, n, text))))


def _levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def _path(levels, i):
    for level in levels[:-1]:
        a = i - i % 16
        yield "".join(level[a:i]), "".join(level[i + 1 : a + 16])
        i //= 16


def _plain(rows):
    low = str.maketrans(manifest.UPPER, manifest.LOWER)
    copies = {}
    for r in rows:
        changed = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        copies.setdefault(r[2], []).append((r[0], _leaf(r, r[1]), _leaf(r, r[1].translate(low) if changed else r[1])))
    sources = sorted(copies, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        copies[s].sort(key=lambda c: (c[0] is not None, c[0] or 0, c[1], c[2]))
    trees = [_levels([c[1] for c in copies[s]]) for s in sources]
    top = _levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, (doc, own, copy) in enumerate(copies[s]):
            path = [*_path(trees[k], i), *_path(top, k)]
            for left, right in path:
                copy = _h(left + copy + right)
            out.append((doc, own, trees[k][-1][0], top[-1][0], _h("".join(a + b for a, b in path)), copy, copy == top[-1][0]))
    return sorted(out, key=repr)


def _rows(seed, n, sources):
    """One source holds half of all rows, some hold one row, 17 or 257."""
    rows = []
    for k, (i, t, s) in enumerate(odd_documents(seed, n)):
        rows.append((i, t, s if k % 2 else "hot", None if k % 7 == 0 else "en", None if k % 11 == 0 else k))
    for k, size in enumerate(sources):
        rows += [(10_000 * (k + 1) + j, f"Text {j} of é", f"source {k}", "de", j) for j in range(size)]
    return rows


@pytest.mark.parametrize(("seed", "n", "sources"), [(7, 60, [1, 16, 17, 257]), (8, 20, [1] * 20)])
def test_manifest_against_a_plain_tree(spark, seed, n, sources):
    rows = _rows(seed, n, sources)
    got = rows_of(manifest.report(table(spark, rows, SCHEMA).withColumnRenamed("key", "tree")))
    assert got == _plain(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_one_row_is_its_own_root_and_no_rows_have_none(spark):
    row = (3, "x", None, None, None)
    assert rows_of(manifest.report(table(spark, [row], SCHEMA))) == _plain([row])
    assert _plain([row])[0][1] == _plain([row])[0][3]
    assert manifest.report(table(spark, [], SCHEMA)).count() == 0


def test_paths_fold_to_the_root(spark):
    rows = _rows(9, 30, [40])
    for r in manifest.manifest(table(spark, rows, SCHEMA)).collect():
        at = bytes(r.leaf)
        for s in r.path:
            at = hashlib.sha256((bytes(s.left) + at + bytes(s.right)).hex().encode()).digest()
        assert at == bytes(r.root) == bytes(r.folded_root)
