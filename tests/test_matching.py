import random

import pytest
from pyspark.sql import functions as F

from patchlight.operators.matching import first_free


def plain(lists):
    taken = {}
    for key, turn, chooser, items in sorted(lists, key=lambda r: (r[0], r[1])):
        free = next((x for x in items if (key, x) not in taken), None)
        if free is not None:
            taken[key, free] = chooser
    return sorted((key, chooser, item) for (key, item), chooser in taken.items())


def chosen(spark, lists, folded):
    df = spark.createDataFrame(lists, "k long, turn long, chooser long, items array<bigint>")
    return sorted(map(tuple, first_free(df, ["k"], folded).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_equal_one_after_another(spark, seed):
    """Own orders of liking, equal lists, common orders, nested and empty lists; rounds alone (0), a few rounds, or the fold alone."""
    r = random.Random(seed)
    lists = []
    for k in range(6):
        shapes = [r.sample(range(12), r.randint(0, 12)) for _ in range(5)]
        shapes = [sorted(s) for s in shapes] if k % 2 else shapes
        n = r.randint(1, 25)
        lists += [(k, t, c, r.choice(shapes)) for t, c in zip(r.sample(range(100), n), r.sample(range(n), n), strict=True)]
    want = plain(lists)
    for folded in (0, 30, 4096):
        assert chosen(spark, lists, folded) == want


def test_very_many_choosers_of_one_key(spark):
    """100,000 choosers of one key with a few hundred different lists over 300 items."""
    lists = spark.range(100_000).select(
        F.lit(1).alias("k"), F.xxhash64("id").alias("turn"), F.col("id").alias("chooser"),
        F.transform(F.sequence(F.lit(0), F.lit(29)), lambda x: F.pmod(F.xxhash64(F.col("id") % 400) + x * x, F.lit(300))).alias("items"),
    )
    lists = lists.withColumn("items", F.array_distinct("items"))
    rows = [tuple(x) for x in lists.select("k", "turn", "chooser", "items").collect()]
    assert sorted(map(tuple, first_free(lists, ["k"]).collect())) == plain(rows)


def test_no_lists(spark):
    assert chosen(spark, [], 0) == []
    assert chosen(spark, [(1, 1, 1, [])], 0) == []
