"""Embedding near-duplicates by an epsilon grid order join.

Within one label, unit vectors of cosine c lie sqrt(2 - 2c) apart. Distinct vectors are projected on the leading principal
directions (fitted on a bounded sample; they decide only how much can be skipped), ordered by the cells of a grid of that
width, and cut into blocks along the order. Intervals of blocks are joined with intervals recursively: a pair of intervals whose bounding
boxes in the projected space lie further apart than the grid width is dropped with everything below it, the rest is split. What is left are
pairs of blocks, compared in double precision; each gives link counts and a spanning forest of its links, not the links.

Equal vectors are one vector with a multiplicity, so copies are never compared with each other. Null, zero, null-holding or non-finite
vectors, null labels, null ids and vectors of another length link with nothing: 0 links, a component of their own, kept.
Repeated rows are vectors of their own that link with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import numbered, settled
from patchlight.llm.links import components

COSINE = 0.93
BLOCK = 512
DIRECTIONS = 8
SAMPLE = 4_096
FAN = 8


def _usable() -> Column:
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def _unit(rows: pa.Array, dim: int) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(distinct: DataFrame, dim: int) -> np.ndarray:
    """Leading principal directions of a bounded sample."""
    sample = distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("rep")).limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    x = _unit(sample, dim)
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return v[:DIRECTIONS]


def _project(rows: DataFrame, directions: dict[int, np.ndarray], width: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            place, cell = [None] * len(dims), [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                p = _unit(batch.column("embedding").take(pa.array(at)), int(dim)) @ directions[int(dim)].T
                p = np.pad(p, ((0, 0), (0, DIRECTIONS - p.shape[1])))
                for i, row in zip(at, p, strict=True):
                    place[i], cell[i] = row, np.floor(row / width).astype(np.int32)
            more = [pa.array(place, pa.list_(pa.float64())), pa.array(cell, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "place", "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, place array<double>, cell array<int>")


def _boxes(rows: DataFrame) -> DataFrame:
    bounds = [f(F.col("place")[i]).alias(f"{n}{i}") for i in range(DIRECTIONS) for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("label", "dim", "block").agg(*bounds)


def _near(pairs: DataFrame, boxes: DataFrame, width: float) -> DataFrame:
    """Pairs of intervals whose boxes are at most the grid width apart (a hair more, for rounding)."""
    names = [c for c in boxes.columns if c[:2] in ("lo", "hi")]
    left = boxes.select("label", "dim", F.col("block").alias("i"), *[F.col(c).alias(f"a_{c}") for c in names])
    right = boxes.select("label", "dim", F.col("block").alias("j"), *[F.col(c).alias(f"b_{c}") for c in names])
    both = pairs.join(left, ["label", "dim", "i"]).join(right, ["label", "dim", "j"])
    gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo{d}") - F.col(f"b_hi{d}"), F.col(f"b_lo{d}") - F.col(f"a_hi{d}")) for d in range(DIRECTIONS)]
    square = gaps[0] * gaps[0]
    for g in gaps[1:]:
        square = square + g * g
    return both.where(square <= width * width + 1e-9).select("label", "dim", "i", "j")


def _interval_pairs(rows: DataFrame, width: float) -> DataFrame:
    """label, dim, i, j (i <= j): pairs of blocks that may hold links, found from whole labels downwards."""
    blocks = settled(_boxes(rows))
    last = blocks.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    levels = [blocks]
    while last >= 1:
        last //= FAN
        names = [c for c in blocks.columns if c[:2] in ("lo", "hi")]
        up = levels[-1].withColumn("block", F.floor(F.col("block") / FAN)).groupBy("label", "dim", "block")
        levels.append(up.agg(*[(F.min if c[:2] == "lo" else F.max)(c).alias(c) for c in names]))
    pairs = levels[-1].select("label", "dim", F.col("block").alias("i"), F.col("block").alias("j"))
    for level in levels[-2::-1]:
        steps = F.sequence(F.lit(0), F.lit(FAN - 1))
        split = pairs.withColumn("x", F.explode(steps)).withColumn("y", F.explode(steps))
        split = split.select("label", "dim", (F.col("i") * FAN + F.col("x")).alias("i"), (F.col("j") * FAN + F.col("y")).alias("j")).where("i <= j")
        pairs = settled(_near(split, level, width))
    return pairs


def _forest(hit: np.ndarray) -> np.ndarray:
    """Component number (its first member) of each row of a symmetric link matrix."""
    mark = np.arange(len(hit))
    while True:
        new = np.where(hit, mark[None, :], len(hit)).min(1, initial=len(hit))
        new = np.minimum(mark, new)
        new = new[new]
        if (new == mark).all():
            return mark
        mark = new


def _compare(cosine: float):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("left")[i].values, batch.column("right")[i].values
                same, dim = batch.column("same")[i].as_py(), batch.column("dim")[i].as_py()
                sides = []
                for s in (a,) if same else (a, b):
                    x = s.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    sides.append((s.field("rep").to_numpy(), s.field("n").to_numpy(), x / np.abs(x).max(1, keepdims=True)))
                (ra, na, xa), (rb, nb, xb) = sides[0], sides[-1]
                size = np.linalg.norm(xa, axis=1)[:, None] * np.linalg.norm(xb, axis=1)[None, :]
                hit = (xa @ xb.T) / size >= cosine
                if same:
                    np.fill_diagonal(hit, False)
                    ids, links, full = ra, hit @ nb, hit
                else:
                    ids, links = np.concatenate((ra, rb)), np.concatenate((hit @ nb, na @ hit))
                    full = np.zeros((len(ids), len(ids)), bool)
                    full[: len(ra), len(ra) :], full[len(ra) :, : len(ra)] = hit, hit.T
                some = np.flatnonzero(links)
                if len(some):
                    root = np.full(len(ids), -1)
                    mark = _forest(full[np.ix_(some, some)])
                    low = np.full(len(some), np.iinfo(np.int64).max)
                    np.minimum.at(low, mark, ids[some])
                    root = low[mark]
                    yield pa.RecordBatch.from_pydict({"rep": ids[some], "links": links[some].astype(np.int64), "root": root})

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    width = math.sqrt(2 - 2 * cosine)
    rows = embeddings.select("vec_id", "embedding", "label").withColumn("__use", _usable())
    use = rows.where("__use").select("vec_id", "embedding", "label")
    distinct = settled(use.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding")))
    # One small matrix per vector length; lengths are a handful.
    dims = [r[0] for r in distinct.select("dim").distinct().collect()]
    directions = {d: _directions(distinct, d) for d in dims}
    cells = _project(distinct, directions, width)
    ordered = numbered(cells, [F.col("label"), F.col("dim"), F.col("cell"), F.col("rep")], "__no")
    ordered = ordered.withColumn("block", F.floor(F.col("__no") / block))
    pairs = _interval_pairs(ordered, width)
    packed = ordered.groupBy("label", "dim", "block").agg(F.collect_list(F.struct("rep", "n", "embedding")).alias("members"))
    left = packed.select("label", "dim", F.col("block").alias("i"), F.col("members").alias("left"))
    right = packed.select("label", "dim", F.col("block").alias("j"), F.col("members").alias("right"))
    work = pairs.join(left, ["label", "dim", "i"]).join(right, ["label", "dim", "j"]).select("dim", (F.col("i") == F.col("j")).alias("same"), "left", "right")
    found = settled(work.mapInArrow(_compare(cosine), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = distinct.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("label"), F.col("embedding"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = use.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where("NOT __use").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)
