"""Exact similarity joins and ranked limits that hold when one key has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchlight.functions import columns as X
from patchlight.session import cut_lineage

SALTS = 64


def salted_first(df: DataFrame, keys: list[str], order: list[Column], unique: Column, limit: Column) -> DataFrame:
    """The first rows per key in order, limit being a column: ranked inside salts, then over the rest.

    Each salt passes on at most limit rows, so no task ranks a whole hot key.
    """
    salted = df.withColumn("_s", F.pmod(F.xxhash64(unique), F.lit(SALTS)))
    inner = W.partitionBy(*keys, "_s").orderBy(*order)
    few = salted.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= limit).drop("_r", "_s")
    outer = W.partitionBy(*keys).orderBy(*order)
    return few.withColumn("_r", F.row_number().over(outer)).where(F.col("_r") <= limit).drop("_r")


def similar_sets(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """keys, lw, rw, sim for word sets with Jaccard >= threshold under equal keys.

    left and right: keys and words. Equal sets collapse first. Two sets reach the threshold only if
    their sorted prefixes of n - ceil(t n) + 1 words share one, so the join runs on (keys, prefix
    word) and misses nothing; sizes are checked before the exact test.
    """
    def prefixed(df: DataFrame, name: str, word: str) -> DataFrame:
        n = F.size(name)
        cut = (n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1)
        sets = df.select(*keys, F.array_sort("words").alias(name)).where(F.size("words") > 0).distinct()
        return sets.select(*keys, name, F.explode(F.slice(name, F.lit(1), cut)).alias(word))

    a, b = prefixed(left, "lw", "_word"), prefixed(right, "rw", "_word")
    small, big = F.least(F.size("lw"), F.size("rw")), F.greatest(F.size("lw"), F.size("rw"))
    sim = X.jaccard(F.col("lw"), F.col("rw"))
    # A pair sharing several prefix words is kept only at the first of them: no de-duplication pass.
    n_l = F.size("lw") - F.ceil(F.lit(threshold) * F.size("lw") - F.lit(1e-9)).cast("int") + 1
    n_r = F.size("rw") - F.ceil(F.lit(threshold) * F.size("rw") - F.lit(1e-9)).cast("int") + 1
    shared = F.array_intersect(F.slice("lw", F.lit(1), n_l), F.slice("rw", F.lit(1), n_r))
    return (
        a.join(b, [*keys, "_word"])
        .where((small >= F.lit(threshold) * big - 1e-9) & (F.element_at(shared, 1) == F.col("_word")))
        .withColumn("sim", sim).where(F.col("sim") >= threshold)
        .select(*keys, "lw", "rw", "sim")
    )


def occupied_buckets(ranges: DataFrame, points: DataFrame, keys: list[str], low: str, high: str, lines: int) -> DataFrame:
    """Ranges with _b, once for each bucket of so many lines that they touch and that holds a point (points: keys, _b).

    Rows follow the points that exist, so a range of any length costs no more than its file's points.
    """
    held = points.groupBy(*keys).agg(F.collect_set("_b").alias("_held"))
    first, last = F.floor(F.col(low) / lines), F.floor(F.col(high) / lines)
    return ranges.join(held, keys).withColumn("_b", F.explode(F.filter("_held", lambda b: b.between(first, last)))).drop("_held")


def _grams(text: Column, size: int) -> Column:
    """Distinct strings of so many characters in a text; one pass over its characters."""
    chars = F.split(text, "")
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.concat(*[F.get(chars, i + (k - 1)) for k in range(size)]))))


def contained(texts: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tid, word for words (keys, word) that stand anywhere in a text (keys, tid, text) under equal keys.

    An index of three-character strings (shorter ones for shorter words): a word is looked up by the one of its strings that the fewest texts
    of its key hold, and only the texts found are searched. Texts and words may be many under one key; texts x words are never built.
    Empty words stand in every text and are left to the caller.
    """
    words = words.where(F.length("word") > 0).select(*keys, "word").distinct().withColumn("_size", F.least(F.length("word"), F.lit(3)))
    held = parts = None
    for size in (1, 2, 3):
        asked = words.where(F.col("_size") == size).select(*keys, "word", F.explode(_grams(F.col("word"), size)).alias("gram"))
        searched = texts.join(asked.select(*keys).distinct(), keys, "left_semi").select(*keys, "tid", F.explode(_grams(F.col("text"), size)).alias("gram"))
        found = searched.join(asked.select(*keys, "gram").distinct(), [*keys, "gram"])
        held, parts = (found, asked) if held is None else (held.unionByName(found), parts.unionByName(asked))
    held = cut_lineage(held)
    spread = held.groupBy(*keys, "gram").agg(F.count("*").alias("_n"))
    # A word with a string that no text holds is in no text: the count is 0 and the join below finds nothing.
    rare = parts.join(spread, [*keys, "gram"], "left").groupBy(*keys, "word").agg(F.min_by("gram", F.coalesce("_n", F.lit(0))).alias("gram"))
    near = held.join(rare, [*keys, "gram"]).select(*keys, "tid", "word").join(texts.select(*keys, "tid", "text"), [*keys, "tid"])
    return near.where(F.col("text").contains(F.col("word"))).select(*keys, "tid", "word")
