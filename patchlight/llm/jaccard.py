"""N-gram Jaccard self-join of documents by a size-aware heavy-light join.

A document's set holds its distinct word shingles; documents with equal sets are one set with a fingerprint as its key. The inverted lists
are made once, as compressed cells: every task packs its (shingle, set) entries by shingle range, the lists of a range meet in one
task, and only shingles that two different sets share go back to their sets. A set without 80% shared shingles has no link at all.

Light sets (fewer than `boundary` shingles): every subset of the size that a link needs is enumerated; sets that meet in a subset are linked
to the smallest of them, which links all that any pair of them would, so no pairs are made. Heavy sets: the inverted lists of their rarest
shingles (as many as make it certain that two linked sets share one) are scanned, rare before frequent. The boundary is the one with the
lowest total of enumerated subsets and scanned entries, worked out from counts of the sizes.

Scanning a list compares each set first with the most central set of the list, by exact overlap. What these links leave in
different components of one list is then compared pair by pair, members of the largest component only with others. A pair in one
component needs no comparison, so the components are exact, and a large group of near copies costs one comparison per copy, not all pairs.

Null or empty texts and texts without words have 0 shingles and are linked with nothing; null ids too (component null). Repeated rows are
rows of their own with the same set, so of the same component. Hashes of 64 bits stand for shingles, of 48 bits in the inverted lists'
shared part; fingerprints have 128 bits. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlight.llm.common import settled, width
from patchlight.llm.kernels import LOWER, U64, grams, hashes, mix, slices, texts, words
from patchlight.llm.links import components
from patchlight.llm.packed import bucket_of, bucket_parts, spread, spread_sorted, squeeze, squeeze_sorted

WORDS = 5
PERCENT = 80
#: Sizes among which the boundary of light and heavy is looked for.
LARGEST_LIGHT = 24
#: Entries that a task packs together.
BLOCK = 1_000_000


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and value; texts of fewer words have one, their whole sequence."""
    data = LOWER[data]
    starts, ends, of = words(data, offsets)
    h = hashes(data, starts, ends)
    size = np.bincount(of, minlength=len(offsets) - 1)
    value, owner = [], []
    if len(h) >= n:
        full = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1])
        value.append(grams(h, n)[full])
        owner.append(of[full])
    first = np.cumsum(size) - size
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            value.append(mix(grams(h, k)[first[short]] ^ U64(k)))
            owner.append(short)
    if not value:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def _prints(value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two fingerprints of each text's set."""
    size = np.bincount(owner, minlength=n)
    sums = [np.concatenate((np.zeros(1, U64), np.cumsum(mix(value ^ U64(salt)), dtype=U64))) for salt in (0x1234567, 0x89ABCDEF01)]
    end = np.cumsum(size)
    return size, *(mix((s[end] - s[end - size]) ^ size.astype(U64)) for s in sums)


def set_table(documents: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, key, check of every row; key and check are the two fingerprints of its set."""

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for a, b in slices(offsets):
                size, key, check = _prints(*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n), b - a)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a), "n_shingles": size, "key": key.view(np.int64), "check": check.view(np.int64),
                })

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key long, check long")


def _pack(buckets: int, n: int):
    """Blocks of entries by shingle range: sorted shingles, the local number of each one's set, and the table of sets."""

    def emit(value, key, size):
        keys, place = np.unique(key, return_inverse=True)
        sizes = np.zeros(len(keys), np.uint32)
        sizes[place] = size
        order = np.lexsort((place, value))
        value, place = value[order], place[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (place[1:] != place[:-1])
        value, place = value[new], place[new]
        for bucket, i, j in bucket_parts(value, buckets):
            used, local = np.unique(place[i:j], return_inverse=True)
            yield {
                "bucket": bucket, "shingle": squeeze_sorted(value[i:j] >> U64(16)), "place": squeeze(local.astype(np.uint32)),
                "keys": squeeze_sorted(keys[used]), "sizes": squeeze(sizes[used]),
            }

    schema = pa.schema([("bucket", pa.int32()), ("shingle", pa.binary()), ("place", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for a, b in slices(offsets):
                value, owner = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                size, key, _ = _prints(value, owner, b - a)
                held.append((value, key[owner], size[owner]))
                count += len(value)
                if count >= BLOCK:
                    yield pa.RecordBatch.from_pylist(list(emit(*map(np.concatenate, zip(*held, strict=True)))), schema)
                    held, count = [], 0
        if count:
            yield pa.RecordBatch.from_pylist(list(emit(*map(np.concatenate, zip(*held, strict=True)))), schema)

    return run


def _share(buckets: int):
    """The lists of one shingle range; entries of shingles that two sets share go back, packed by ranges of sets."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("runs", pa.binary()), ("shingle", pa.binary()), ("df", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        value, key, size = [], [], []
        for row in table.to_pylist():
            place = spread(row["place"], np.uint32)
            value.append(spread_sorted(row["shingle"]))
            key.append(spread_sorted(row["keys"])[place])
            size.append(spread(row["sizes"], np.uint32)[place])
        value, key, size = map(np.concatenate, (value, key, size))
        order = np.lexsort((key, value))
        value, key, size = value[order], key[order], size[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (key[1:] != key[:-1])
        value, key, size = value[new], key[new], size[new]
        at = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        runs = np.diff(np.append(at, len(value)))
        df = np.repeat(runs, runs)
        shared = df >= 2
        value, key, size, df = value[shared], key[shared], size[shared], df[shared]
        order = np.lexsort((value, key))
        value, key, size, df = value[order], key[order], size[order], df[order]
        out = []
        for bucket, i, j in bucket_parts(key, buckets) if len(key) else []:
            first = i + np.flatnonzero(np.append(True, key[i + 1 : j] != key[i : j - 1]))
            out.append({
                "bucket": bucket, "keys": squeeze_sorted(key[first]), "sizes": squeeze(size[first]),
                "runs": squeeze(np.diff(np.append(first, j)).astype(np.uint32)), "shingle": squeeze(value[i:j]), "df": squeeze(df[i:j].astype(np.uint32)),
            })
        return pa.Table.from_pylist(out, schema)

    return run, "bucket int, keys binary, sizes binary, runs binary, shingle binary, df binary"


def _gather(percent: int):
    """The sets of one range with their shared shingles: those that may have a link, with the rarest shingles that a link must touch."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("shared", pa.binary()), ("rare", pa.list_(pa.int64())), ("scan", pa.int64()), ("central", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        key, size, value, df = [], [], [], []
        for row in table.to_pylist():
            runs = spread(row["runs"], np.uint32)
            key.append(np.repeat(spread_sorted(row["keys"]), runs))
            size.append(np.repeat(spread(row["sizes"], np.uint32), runs))
            value.append(spread(row["shingle"], U64))
            df.append(spread(row["df"], np.uint32))
        key, size, value, df = map(np.concatenate, (key, size, value, df))
        order = np.lexsort((value, df, key))
        key, size, value, df = key[order], size[order].astype(np.int64), value[order], df[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.append(first[1:], len(key))
        out = []
        for i, j in zip(first, end, strict=True):
            n, shared = int(size[i]), int(j - i)
            if 100 * shared < percent * n:
                continue
            reach = n - -(-percent * n // 100) + 1 - (n - shared)
            out.append({
                "key": int(key[i].astype(np.int64)), "n": n, "k": shared, "shared": squeeze_sorted(np.sort(value[i:j])),
                "rare": value[i : i + reach].astype(np.int64), "scan": int(df[i : i + reach].sum()), "central": float(np.log(df[i:j]).sum() / n),
            })
        return pa.Table.from_pylist(out, schema)

    return run, "key long, n int, k int, shared binary, rare array<long>, scan long, central double"


def candidates(documents: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n, k (shared shingles), shared, rare, scan, central of the distinct sets that may have a link with another set."""
    buckets = 2 * width(documents.sparkSession)
    blocks = documents.select("text").mapInArrow(_pack(buckets, n), "bucket int, shingle binary, place binary, keys binary, sizes binary")
    share, share_schema = _share(buckets)
    gather, gather_schema = _gather(percent)
    back = blocks.groupBy("bucket").applyInArrow(share, share_schema)
    return settled(back.groupBy("bucket").applyInArrow(gather, gather_schema))


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Least overlap of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """Overlaps that a link of a set of n with another size may need, none larger than n."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({c for b in partners if 0 < (c := needed(n, b, percent)) <= min(n, b)})


def boundary(sizes: list[tuple[int, int, int]], percent: int = PERCENT) -> int:
    """The size from which sets are heavy: rows of (size, sets, scanned entries) -> the cheapest split."""
    light = {n: sum(math.comb(n, c) for c in subset_sizes(n, percent)) for n in range(1, LARGEST_LIGHT)}
    cost = {
        x: sum(k * light[n] for n, k, _ in sizes if n < x) + sum(s for n, _, s in sizes if 100 * n >= percent * x and n <= 2 * LARGEST_LIGHT)
        for x in range(1, LARGEST_LIGHT + 1)
    }
    return min(cost, key=lambda x: (cost[x], x))


def _light(sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links between sets smaller than the boundary, as stars around the smallest set of each subset."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, n, cell in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("shared").to_pylist(), strict=True):
                value = mix(spread_sorted(cell))
                for c in subset_sizes(n, percent):
                    if c <= len(value):
                        pick = np.array(list(combinations(range(len(value)), c)))
                        total = value[pick].sum(1, dtype=U64)
                        rows += [(key, n, c, int(x)) for x in mix(total).view(np.int64)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["key", "n", "c", "subset"])

    subsets = sets.where(F.col("n") < limit).select("key", "n", "shared").mapInArrow(run, "key long, n int, c int, subset long")
    least = subsets.groupBy("c", "subset").agg(F.min(F.struct("n", "key")).alias("least"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    met = subsets.join(least, ["c", "subset"]).where((F.col("key") != F.col("least.key")) & (percent * (F.col("n") + F.col("least.n")) <= (100 + percent) * F.col("c")))
    return met.select(F.col("key").alias("a"), F.col("least.key").alias("b")).distinct()


def _fit(n_a: str, k_a: str, n_b: str, k_b: str, percent: int):
    """Whether sets of sizes n may be linked that meet first in a shingle which k of their shared ones, in the order of the lists, do not
    come before: their overlap is at most the smaller k."""
    return (100 + percent) * F.least(k_a, k_b) >= percent * (F.col(n_a) + F.col(n_b))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact overlap makes a link."""

    def run(batches):
        last, other = None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "shared_a", "shared_b")]
            keep = np.zeros(batch.num_rows, bool)
            for i, (_, b, n_a, n_b, cell_a, cell_b) in enumerate(zip(*cols, strict=True)):
                if b != last:
                    last, other = b, spread_sorted(cell_b)
                overlap = len(np.intersect1d(spread_sorted(cell_a), other, assume_unique=True))
                keep[i] = 100 * overlap >= percent * (n_a + n_b - overlap)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("shared_a"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("shared_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def set_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, component of the sets that have a link; the component is named by one of its keys."""
    sizes = sets.where(F.col("n") <= 2 * LARGEST_LIGHT).groupBy("n").agg(F.count(F.lit(1)), F.sum("scan")).collect()
    limit = boundary([tuple(r) for r in sizes], percent)
    heavy = sets.where(100 * F.col("n") >= percent * limit).select("key", "n", "k", "central", F.posexplode("rare").alias("rank", "shingle"))
    heavy = heavy.withColumn("k", F.col("k") - F.col("rank")).drop("rank")
    pivots = heavy.groupBy("shingle").agg(F.max(F.struct("central", "key", "n", "k")).alias("p"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    stars = heavy.join(pivots, "shingle").where((F.col("key") != F.col("p.key")) & _fit("n", "k", "p.n", "p.k", percent))
    stars = stars.select(F.col("key").alias("a"), F.col("p.key").alias("b")).distinct()
    links = settled(_light(sets, limit, percent).union(_verified(stars, sets, percent)))
    found = components(links)
    named = heavy.join(found.withColumnRenamed("node", "key"), "key", "left").select("shingle", "key", "n", "k", F.coalesce("component", "key").alias("comp"))
    per_comp = named.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("sets"))
    mixed = per_comp.groupBy("shingle").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("sets", "comp")).alias("major")).where("comps > 1")
    open_lists = settled(named.join(mixed, "shingle").select("shingle", "key", "n", "k", "comp", F.col("major.comp").alias("major")))
    minor = open_lists.where("comp <> major").select("shingle", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("k").alias("k_a"), F.col("comp").alias("comp_a"))
    across = minor.join(open_lists, "shingle").where(
        (F.col("comp") != F.col("comp_a")) & _fit("n", "k", "n_a", "k_a", percent) & ((F.col("comp") == F.col("major")) | (F.col("a") < F.col("key")))
    )
    more = settled(_verified(across.select("a", F.col("key").alias("b")).distinct(), sets, percent))
    # What is known goes on as stars; only links between components are new.
    return found if more.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def join(documents: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = settled(set_table(documents, n))
    found = set_components(candidates(documents, n, percent), percent)
    named = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("key", "check").agg(F.min("doc_id").alias("least"))
    classes = classes.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named_comps = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = classes.join(named_comps, "component").select("key", "check", "component_id")
    out = rows.join(ids, ["key", "check"], "left")
    alone = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


def keep_one(documents: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of documents, one for each component: the one with the least id. Rows that share this id count as one (the least by
    hash stays); rows with a null id all stay."""
    named = documents.where("doc_id IS NOT NULL")
    gone = join(documents, n, percent).where("doc_id <> component_id").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(c) for c in documents.columns]))
    kept = named.join(gone, "doc_id", "left_anti").select(*documents.columns)
    place = "__place"
    while place in documents.columns:
        place += "_"
    kept = kept.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*documents.columns)
    return kept.union(documents.where("doc_id IS NULL"))
