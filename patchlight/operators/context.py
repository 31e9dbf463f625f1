"""Definitions of symbols a change uses, found in repository files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import columns as X
from patchlight.operators.budget import budget_skip


#: Bits of Spark's aggregated bitmaps.
BITMAP_BITS = 32_768


def symbol_definitions(symbols: DataFrame, files: DataFrame, budgets: DataFrame, keep: int = C.SYMBOLS_PER_PR) -> DataFrame:
    """symbols: repo, pr_id, symbol, ord. files: repo, file, content. budgets: pr_id, budget.

    Only the first symbols of a change are looked up. A bitmap of 4 KB per repository says which words may be asked for, and a file's words are filtered by it
    before they become rows; those left meet the symbols on (repo, word). The snippet is cut from the one file chosen. Definitions that do
    not fit the budget are skipped.
    """
    from patchlight.operators.similar import salted_first

    def place(word):
        return F.pmod(F.xxhash64(word), F.lit(BITMAP_BITS)).cast("int")

    asked = salted_first(symbols, ["pr_id"], [F.col("ord"), F.col("symbol")], F.struct("ord", "symbol"), F.lit(keep))
    wanted = asked.select("repo", "symbol").distinct()
    maps = wanted.groupBy("repo").agg(F.bitmap_construct_agg(place(F.col("symbol"))).alias("_map"))
    words = files.select("repo", "file", F.array_distinct(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0))).alias("_words")).join(maps, "repo")
    byte = lambda w: F.conv(F.hex(F.substring(F.col("_map"), F.floor(place(w) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    asked_for = F.filter("_words", lambda w: F.getbit(byte(w).cast("bigint"), place(w) % 8) == 1)
    words = words.select("repo", "file", F.explode(asked_for).alias("symbol"))
    first = words.join(wanted, ["repo", "symbol"]).groupBy("repo", "symbol").agg(F.min("file").alias("file"))
    rows = first.join(files, ["repo", "file"]).withColumn("rows", F.split("content", "\n")).withColumn(
        "line",
        F.array_position(F.expr(r"transform(rows, x -> x rlike concat('\\b', symbol, '\\b'))"), True).cast("int"),
    )
    start, end = F.greatest(F.col("line") - 3, F.lit(0)), F.least(F.size("rows"), F.col("line") + 5)
    body = F.array_join(F.transform(
        F.slice("rows", start + 1, end - start),
        lambda x, i: F.concat((i + start + 1).cast("string"), F.lit(":"), x)), "\n")
    defs = rows.select("repo", "symbol", "file", "line", F.concat(
        F.lit("// "), "symbol", F.lit(" defined in "), "file", F.lit(":"), F.col("line").cast("string"), F.lit("\n"), body).alias("snippet"))
    items = asked.join(defs, ["repo", "symbol"]).join(budgets, "pr_id").select(
        "pr_id", F.struct("ord", "symbol").alias("o"), "symbol", "file", "line", "snippet", "budget", X.tokens(F.col("snippet")).alias("tokens"))
    return budget_skip(items, "budget", "o", keep)
