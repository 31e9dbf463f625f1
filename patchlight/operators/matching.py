"""Choices made one after another, each of the best item still free, found in parallel rounds.

Choosers of a key act in one order; each takes the first item of its own list that nobody before it took. A key with few list entries is folded
in its row. A larger one is reduced in rounds, each a few aggregations over all keys at once:

- Of choosers with one and the same list, the r-th can only get the r-th item of the list or a later one, and none if the list is shorter: what an
  earlier one of them found taken, or took, is taken for it too. So the r-th aims at its r-th item.
- An item aimed at by a chooser is lost to everyone after that chooser.
- A chooser that aims at an item, with nobody before it in want of that item, has it for good; both leave.

The first chooser left always leaves with its item, and a chooser whose list has run out leaves without, so rounds end. A key joins the fold as soon as
it has few entries left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchlight.operators.similar import salted_first
from patchlight.session import cut_lineage

#: List entries of one key that are folded in one row.
FOLDED = 4_096


def _able(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Of choosers with equal lists the first as many as the list is long, with their place among them."""
    few = salted_first(lists, [*keys, "items"], [F.col("turn")], F.col("chooser"), F.size("items"))
    return few.withColumn("at", F.row_number().over(W.partitionBy(*keys, "items").orderBy("turn")))


def _fold(lists: DataFrame, keys: list[str], item: str) -> DataFrame:
    """One pass over a key's choosers in their order."""
    empty = F.array().cast(f"array<struct<chooser:bigint,item:{item}>>")

    def take(taken, one):
        free = F.filter(one["items"], lambda x: ~F.exists(taken, lambda t: t["item"] == x))
        return F.concat(taken, F.transform(F.slice(free, F.lit(1), F.lit(1)), lambda x: F.struct(one["chooser"].alias("chooser"), x.alias("item"))))

    queue = lists.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "chooser", "items"))).alias("q"))
    return queue.select(*keys, F.explode(F.aggregate("q", empty, take)).alias("t")).select(*keys, "t.chooser", "t.item")


def _round(lists: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chooser, item) pairs that are settled, and the lists that are left."""
    aimed = cut_lineage(_able(lists, keys).withColumn("items", F.expr("slice(items, at, size(items))")).drop("at").withColumn("aim", F.element_at("items", 1)))
    bar = aimed.groupBy(*keys, F.col("aim").alias("item")).agg(F.min("turn").alias("bar"))
    entries = aimed.select(*keys, "turn", "chooser", "aim", F.posexplode("items").alias("place", "item"))
    # Entries that hold on: nobody before them aims at the item.
    open_ = entries.join(bar, [*keys, "item"], "left").where("bar IS NULL OR turn <= bar").drop("bar")
    first = open_.groupBy(*keys, "item").agg(F.min(F.struct("turn", "chooser", "aim")).alias("f"))
    settled = cut_lineage(first.where("f.aim = item").select(*keys, F.col("f.chooser").alias("chooser"), "item"))
    left = open_.join(settled.select(*keys, "chooser"), [*keys, "chooser"], "left_anti").join(settled.select(*keys, "item"), [*keys, "item"], "left_anti")
    listed = left.groupBy(*keys, "turn", "chooser").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "item"))), lambda e: e["item"]).alias("items"))
    return settled, cut_lineage(listed)


def first_free(lists: DataFrame, keys: list[str], folded: int = FOLDED) -> DataFrame:
    """keys, chooser, item for lists (keys, turn, chooser, items): items in the chooser's order of liking, turn the order of choosers.

    turn is unique in its key. Choosers that get nothing have no row.
    """
    item = lists.schema["items"].dataType.elementType.simpleString()
    lists = lists.select(*keys, "turn", "chooser", "items").where(F.size("items") > 0)
    out, todo = None, cut_lineage(_able(lists, keys).drop("at"))
    while True:
        wide = todo.groupBy(*keys).agg(F.sum(F.size("items")).alias("_n")).where(F.col("_n") > folded).select(*keys)
        wide = cut_lineage(wide)
        narrow = _fold(todo.join(wide, keys, "left_anti"), keys, item)
        out = narrow if out is None else out.unionByName(narrow)
        if wide.isEmpty():
            return out
        settled, todo = _round(todo.join(wide, keys, "left_semi"), keys)
        out = out.unionByName(settled)
