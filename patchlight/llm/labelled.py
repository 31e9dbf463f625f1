"""Bounded, reproducible samples of labelled rows with their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def first_by_hash(ids: DataFrame, most: int) -> DataFrame:
    """At most so many rows, the ones whose hashed ids come first: the same rows on every run, spread over all ids."""
    return ids.orderBy(F.xxhash64("doc_id"), *[F.col(c) for c in ids.columns]).limit(most)


def with_texts(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """The texts of a bounded table of ids (broadcast: its rows are bounded by the caller's sample sizes)."""
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, y: one row per id; null ids and labels other than 0 and 1 are left out, contradicting rows count as 1."""
    return labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("y"))
