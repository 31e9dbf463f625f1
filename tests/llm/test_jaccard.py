import pytest

from patchlight.llm import jaccard
from tests.llm.helpers import components, odd_documents, rows_of, shingle_set, table


def _expected(rows):
    sets = [(i, shingle_set(t)) for i, t, _ in rows]
    named = [(i, s) for i, s in sets if i is not None and s]
    links = {(a, b) for a, x in named for b, y in named if a < b and 100 * len(x & y) >= 80 * len(x | y)}
    comp = components({i for i, _ in named}, links)
    return sorted(((i, len(s), comp.get(i, i)) for i, s in sets), key=repr)


@pytest.mark.parametrize("seed", [7, 8])
def test_components_against_all_pairs(spark, seed):
    rows = odd_documents(seed)
    assert rows_of(jaccard.join(table(spark, rows))) == _expected(rows)


def test_light_sets_and_chains(spark):
    base = "a b c d e f g h i j k l m n".split()
    rows = [(i, " ".join(base[: 14 - i] + ([f"x{i}"] if i % 2 else [])), "s") for i in range(9)]
    rows += [(20 + i, " ".join(base[i : i + 9]), "s") for i in range(4)]
    assert rows_of(jaccard.join(table(spark, rows))) == _expected(rows)


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in range(i % 6):
            w[(i * 7 + k * 23) % 120] = f"u{i}_{k}"
        rows.append((i, " ".join(w), "s"))
    assert rows_of(jaccard.join(table(spark, rows))) == _expected(rows)


def test_boundary_follows_cost():
    assert jaccard.boundary([(5, 1000, 10**9)]) == 7
    assert jaccard.boundary([(20, 1000, 10)]) == 1
    assert jaccard.needed(10, 10) == 9 and jaccard.subset_sizes(5) == [4, 5]


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = odd_documents(9)
    docs = table(spark, rows)
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns
    want = {i for i, _, c in _expected(rows) if i is not None and i == c}
    kept = [r.doc_id for r in got.select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None) == sorted(want) and kept.count(None) == 2


def test_empty_table(spark):
    assert jaccard.join(table(spark, [])).count() == 0
