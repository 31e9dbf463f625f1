"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of (doc_id, size, checksum). A balanced Feistel network on the smallest even number of bits that
holds all numbers permutes them; a result outside the range walks the cycle until it falls inside, so the permutation is exactly
one of 0..n-1. Place p goes to shard p mod k, slot p div k: counts differ by one at most and slots have no gap. Shard and slot of
any row number, and the row number of any shard and slot, can be computed without the data.

Null texts have size 8 and checksum 0; null ids are numbered last; repeated rows are rows of their own; no rows, no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import numbered
from patchlight.llm.kernels import U64, mix

SHARDS = 24
SEED = 20260
ROUNDS = 6


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=U64) + (U64(seed) << U64(8)))


def _network(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask, shift = U64((1 << half) - 1), U64(half)
    left, right = x >> shift, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ key) & mask)
    return (left << shift) | right


def permute(numbers: np.ndarray, total: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Where each number of 0..total-1 goes; back=True: where it comes from."""
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    keys, out = _keys(seed), _network(numbers.astype(U64), half, _keys(seed), back)
    while (outside := out >= U64(total)).any():
        out[outside] = _network(out[outside], half, keys, back)
    return out.astype(np.int64)


def row_at(shard: int, slot: int, total: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that sits at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), total, seed, back=True)[0])


def shard(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = numbered(narrow, [F.asc_nulls_last("doc_id"), F.asc("size"), F.asc("text_crc32")], "row_no")
    total = rows.count()

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(np.int64), total, seed))

    return rows.withColumn("__place", place("row_no")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("__place") % shards).cast("int").alias("shard"),
        F.floor(F.col("__place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )
