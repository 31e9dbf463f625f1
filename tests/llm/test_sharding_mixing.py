import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from patchlight.llm import mixing, sharding
from tests.llm.helpers import WORD, odd_documents, rows_of, table


@pytest.mark.parametrize("total", [1, 2, 3, 24, 25, 1000, 4097])
def test_permutation_is_one_to_one_and_can_be_undone(total):
    x = np.arange(total)
    p = sharding.permute(x, total)
    assert sorted(p.tolist()) == x.tolist()
    assert (sharding.permute(p, total, back=True) == x).all()


def test_shards_differ_by_one_row_and_slots_have_no_gap(spark):
    rows = odd_documents()
    got = sharding.shard(table(spark, rows), 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert sharding.row_at(r.shard, r.slot, len(rows), 7) == r.row_no and r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(table(spark, rows[::-1]).repartition(5), 7)
    assert rows_of(again) == rows_of(sharding.shard(table(spark, rows), 7))


def test_empty_tables(spark):
    empty = table(spark, [])
    assert sharding.shard(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] >= 3 * sizes[s] * whole}
        if not over:
            target.update({s: left * weight[s] / whole for s in free})
            break
        target.update({s: 3 * sizes[s] for s in over})
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rows = odd_documents(seed)
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    target, taken, largest = _targets(size), Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)
    assert rows_of(mixing.mix(docs.repartition(7))) == sorted((tuple(r) for r in got), key=repr)
