"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Each source has a target number of words. Every document of a source is expected in the same number of copies,
target / size of the source. Documents of a source stand in the order of size and id; the prefix sum of expected copies plus one
random offset of the source grows along that order, and a document is emitted once per whole number that its step crosses.
With the order by size, what the mix takes from a source differs from its target by about one large document.

Targets: weights 5, 2, 1 repeat over the sources in the order of their names (null last). They share the words of all documents; a
target stops at three times its source's size and the excess is shared again by weight until none is above. This is the level at
which min(3 * size, level * weight) add up to the whole; each pass over the table of sources fixes those that the level reaches.

Null or empty texts have size 0 and take 0 words but still count as rows; a null source is a source. Repeated rows are rows of
their own. No rows, no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import WORD, numbered, settled

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: Offsets are multiples of 2^-20: exact in a double next to a prefix sum of up to 2^32.
_STEPS = 1 << 20
#: Above so many sources their table is joined by shuffling, not by broadcast (about 100 bytes a source).
BROADCAST_SOURCES = 50_000


def offset(source: Column, seed: str = SEED) -> Column:
    """A fixed random number in [0, 1) for each source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(source, F.lit("")))), 1, 5), 16, 10).cast("double") / _STEPS


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n_docs, source_size (one row per source) -> also target."""
    ranked = numbered(sizes, [F.asc_nulls_last("source")], "__rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = settled(ranked.withColumn("__weight", weight.cast("long")).drop("__rank"))
    cap = F.col("source_size") * most
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    fixed, rest, n_free = 0, ranked.agg(F.coalesce(F.sum("__weight"), F.lit(0))).first()[0], -1
    level = F.lit(0.0)
    while rest:
        level = F.lit(total - fixed).cast("double") / F.lit(rest).cast("double")
        over = cap.cast("double") <= level * F.col("__weight")
        got = ranked.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("__weight"))), F.lit(0)), F.count(F.when(~over, 1))
        ).first()
        if got[2] == n_free or not got[1]:
            break
        fixed, rest, n_free = got
    return ranked.withColumn("target", F.least(cap.cast("double"), level * F.col("__weight"))).drop("__weight")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """Every row with size, source_size, target, copies and taken; keep: columns to carry along, besides doc_id and source."""
    carried = [F.struct(*keep).alias("__row")] if keep else []
    rows = documents.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *carried
    )
    order = [F.asc_nulls_last("source"), F.asc("size"), F.asc_nulls_last("doc_id")]
    placed = numbered(rows, order, "__number")
    per_source = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"), F.min("__number").alias("__first"))
    sources = settled(source_targets(per_source, weights, most))
    small = sources.count() <= BROADCAST_SOURCES
    sources = sources.withColumnRenamed("source", "__source")
    joined = placed.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("__source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    k = (F.col("__number") - F.col("__first")).cast("double")
    u = offset(F.col("source"), seed)
    copies = (F.floor((k + 1) * rate + u) - F.floor(k * rate + u)).cast("int")
    out = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *(["__row"] if keep else []))


def emit(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of documents, each row in as many copies as it is taken."""
    names = documents.columns
    taken = mix(documents, keep=names, **how).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("__row")[n].alias(n) for n in names])
