"""Exact de-duplication by content-defined chunk recipes.

A text, its white space normalised, is cut where a hash of the last bytes says so; its recipe is the ordered list of its chunks' digests.
A first pass counts recipes by a 64-bit signature. Signatures that occur once are texts without an equal and are finished in the
second pass, where they are read; a bitmap of fixed size says which signatures may occur more often, and only the chunks of
those documents travel, each content once per batch. A digest that stands for one content is a verified identifier; where contents share a
digest they are told apart by their rank. Documents are equal when their ordered lists of identifiers are: a long text is compared
by its short list, and its bytes are moved at most once.

Counts are combined before every shuffle, and a list's result goes back to its documents under (list, part), so a group with a third of
all rows is one row per part and never meets in one task.

Null texts count as empty and equal empty ones. Of rows with equal texts the one with the smallest doc_id stays, exactly one where ids
repeat; null ids come last, so keep_id is null only where a group has no other. No rows, no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchlight.llm.common import settled
from patchlight.llm.kernels import U64, grams, mix

#: Bytes that decide whether a chunk ends, and its least, usual and largest size.
WINDOW, LEAST, USUAL, MOST = 32, 512, 2_048, 16_384
#: Bytes of a chunk's digest.
DIGEST = 16
#: Bits of the map of repeated signatures: 4 MB, whatever the number of documents. False alarms cost movement, not results.
BITS = 25
_GEAR = mix(np.arange(1, 257, dtype=U64))


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text; they depend on the bytes near them, so equal passages are cut alike wherever they stand."""
    ends, at = [], 0
    if len(text) > LEAST:
        end = 0
        for base in range(0, len(text), 1 << 20):
            near = np.frombuffer(text, np.uint8)[max(0, base - WINDOW + 1) : base + (1 << 20)]
            first = max(0, base - WINDOW + 1) + WINDOW
            found = np.flatnonzero(grams(_GEAR[near], WINDOW) % U64(USUAL) == 0) + first
            for end in found.tolist():
                while end - at > MOST:
                    ends.append(at := at + MOST)
                if end - at >= LEAST:
                    ends.append(at := end)
    while len(text) - at > MOST:
        ends.append(at := at + MOST)
    if len(text) > at or not ends:
        ends.append(len(text))
    return ends


def normalised(text: bytes | None) -> bytes:
    """Every run of white space (tab to carriage return, space) as one space; bytes.split knows the same six."""
    if not text:
        return b""
    space = b" \t\n\v\f\r"
    words = b" ".join(text.split())
    if not words:
        return b" "
    return (b" " if text[0] in space else b"") + words + (b" " if text[-1] in space else b"")


def recipe(text: bytes, width: int = DIGEST) -> tuple[list[bytes], list[bytes]]:
    """Digests and contents of a text's chunks, in order."""
    ends = cuts(text)
    parts = [text[a:b] for a, b in zip([0, *ends], ends)]
    return [hashlib.blake2b(p, digest_size=width).digest() for p in parts], parts


def _signature(digests: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(digests), digest_size=8).digest(), "little", signed=True)


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signature(recipe(normalised(t), width)[0]) for t in _raw(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"sig": pa.array(found, pa.int64())})

    return run


def _bitmap(signatures: DataFrame, bits: int) -> np.ndarray:
    """One bit per place that a repeated signature falls on. At most 2 ** (bits - 6) numbers reach the driver."""
    repeated = signatures.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = F.col("sig").bitwiseAND(F.lit((1 << bits) - 1))
    words = repeated.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(sig & 63 AS int))")).alias("mask")).toArrow()
    out = np.zeros(1 << max(bits - 6, 0), np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out


_SECOND = "doc_id long, sha binary, batch long, digests array<binary>, places array<int>, place int, digest binary, content binary"


def _second(spark: SparkSession, bitmap: np.ndarray, bits: int, width: int):
    """A row per document, with its digests where it may have an equal, and a row per content of such documents' chunks in the batch."""
    held = spark.sparkContext.broadcast(bitmap)
    kinds = pa.schema(
        [("doc_id", pa.int64()), ("sha", pa.binary()), ("batch", pa.int64()), ("digests", pa.list_(pa.binary())), ("places", pa.list_(pa.int32())),
         ("place", pa.int32()), ("digest", pa.binary()), ("content", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        for k, batch in enumerate(batches):
            number, rows, contents = (part << 32) + k, [], {}
            for i, raw in zip(batch.column("doc_id").to_pylist(), _raw(batch.column("text")), strict=True):
                text = normalised(raw)
                digests, parts = recipe(text, width)
                at = _signature(digests) & ((1 << bits) - 1)
                row = {"doc_id": i, "sha": hashlib.sha256(text).digest()}
                if (int(held.value[at >> 6]) >> (at & 63)) & 1:
                    row |= {"batch": number, "digests": digests, "places": [contents.setdefault(p, len(contents)) for p in parts]}
                rows.append(row)
            rows += [{"batch": number, "place": n, "digest": hashlib.blake2b(c, digest_size=width).digest(), "content": c} for c, n in contents.items()]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def _verified(chunks: DataFrame) -> DataFrame:
    """batch, ranks: for each batch that needs it, the ranks of chunks whose digest stands for several contents (by place in the batch)."""
    # Least and greatest content are combined before the shuffle: a digest has several contents only if they differ.
    shared = chunks.groupBy("digest").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").select("digest")
    unclear = settled(chunks.join(shared, "digest").select("batch", "place", "digest", "content"))
    # Contents of one digest: two or three at most, with a real digest.
    among = Window.partitionBy("digest").orderBy("content")
    ranks = unclear.select("digest", "content").distinct().withColumn("rank", F.row_number().over(among) - 1)
    placed = unclear.join(ranks, ["digest", "content"])
    return placed.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("place", "rank"))).alias("ranks"))


def _groups(docs: DataFrame) -> DataFrame:
    """Adds keep_id, group_size and kept to rows with an `identity` and a unique `__row`."""
    rows = docs.withColumn("__part", F.shiftright("__row", 33))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    # One row per identity and part, then one per identity, then back to the parts: no task sees a group's rows together.
    runs = settled(rows.groupBy("identity", "__part").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")))
    whole = runs.groupBy("identity").agg(F.min("first").alias("keep"), F.sum("n").alias("group_size"))
    back = runs.select("identity", "__part").join(whole, "identity")
    joined = rows.join(back, ["identity", "__part"])
    return joined.withColumn("keep_id", F.col("keep.doc_id")).withColumn("kept", F.col("keep.__row") == F.col("__row"))


def exact_duplicates(documents: DataFrame, bits: int = BITS, width: int = DIGEST) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha (32 bytes of the normalised text) of every row."""
    rows = documents.select("doc_id", "text")
    spark = documents.sparkSession
    bitmap = _bitmap(rows.select("text").mapInArrow(_signatures(width), "sig long"), bits)
    found = settled(rows.mapInArrow(_second(spark, bitmap, bits, width), _SECOND)).withColumn("__row", F.monotonically_increasing_id())
    alone = found.where("content IS NULL AND digests IS NULL")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    ranks = _verified(found.where("content IS NOT NULL").select("batch", "place", "digest", "content"))
    docs = found.where("digests IS NOT NULL").select("doc_id", "sha", "batch", "digests", "places", "__row").join(ranks, "batch", "left")
    rank = lambda place: F.coalesce(F.element_at("ranks", place), F.lit(0))
    docs = docs.withColumn("identity", F.zip_with("digests", "places", lambda d, p: F.struct(d.alias("digest"), rank(p).alias("rank"))))
    some = _groups(settled(docs.select("doc_id", "sha", "identity", "__row")))
    return alone.union(some.select("doc_id", "keep_id", "group_size", "kept", "sha"))


def keep_one(documents: DataFrame) -> DataFrame:
    """doc_id of the rows that stay, with the size of the group each stands for."""
    return exact_duplicates(documents).where("kept").select("doc_id", "group_size")


def report(documents: DataFrame) -> DataFrame:
    found = exact_duplicates(documents)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
