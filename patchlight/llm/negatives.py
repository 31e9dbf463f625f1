"""Hard-negative mining over a multiway hyperplane tree with sibling ranges (a GNAT).

Vectors are integers, a score is an inner product. With one more coordinate that lifts every vector to the length of the longest, and 0 there for an
anchor, a score is a distance: d^2 = |anchor|^2 + longest^2 - 2 score. A window of scores is then an annulus around the anchor.

The tree: a node has up to `fan` split points; a vector belongs to the nearest. The split points come from a bounded sample (SAMPLE vectors
of a length); every vector is dealt down the tree, and every split point stores the range of its distances to all vectors below each
of its siblings. A sibling is dropped, with all below it, when for some split point the range does not meet the annulus of distances that
the anchor's own distance to that point and its window allow. What is left are leaves, compared exactly, in blocks of BLOCK vectors against
chunks of CHUNK anchors; a pair of block and chunk is compared for the anchors that keep the leaf only.

An anchor first meets its own leaf, which bounds its last positive from below; a second search with that window finds all positives, a third, whose window
runs from the least to the greatest score that positives allow, the negatives.

Equal vectors of a label are one entry of the tree with their least ids: more than MOST of them can never be answers. Anchors with equal vector and
label are searched for once. Rows with a null id, label or vector, or a null or non-finite component, take no part; a row meets rows of its own vector
length only; empty vectors score 0. Repeated rows are rows of their own, each the other's positive. Ties go to the smaller id.
Scores are exact while they fit a long. No rows, no result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlight.llm.common import numbered, settled

POSITIVES = NEGATIVES = 5
#: Equal vectors that can be answers: as many as are asked for, and the anchor itself.
MOST = max(POSITIVES + 1, NEGATIVES)
SCALE = 256
#: Vectors of one length that the split points are chosen from, children of a node, vectors that a leaf is meant to hold, and most leaves.
SAMPLE, FAN, LEAF, LEAVES = 8_192, 8, 1_024, 4_096
BLOCK, CHUNK = 2_048, 512
#: Questions whose answers a task holds before it hands them on.
ANSWERS = 100_000
#: 2^53: sums of products below it are exact in a double.
EXACT = float(1 << 53)


@dataclass
class Node:
    points: np.ndarray  # lifted split points
    below: list  # a Node or the number of a leaf, for each split point
    number: int
    low: np.ndarray | None = None  # [i, j]: least distance of split point i to what is below j
    high: np.ndarray | None = None


@dataclass
class Tree:
    longest: float  # squared length of the longest vector
    root: Node | int
    nodes: list[Node] = field(default_factory=list)
    leaves: int = 0


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(longest - (x * x).sum(1, keepdims=True), 0.0))), 1)


def _anchor(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.zeros((len(x), 1))), 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0.0))


def _spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """k rows of x far from one another: each next is the row farthest from those chosen."""
    chosen, near = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < k and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def grow(sample: np.ndarray, longest: float, leaves: int, fan: int = FAN) -> Tree:
    """Split points for about so many leaves."""
    tree = Tree(longest, 0)

    def node(x: np.ndarray, want: float):
        k = int(min(fan, np.ceil(want), len(x)))
        points = _spread_out(x, k) if k > 1 else x[:1]
        if len(points) < 2:
            tree.leaves += 1
            return tree.leaves - 1
        made = Node(points, [], len(tree.nodes))
        tree.nodes.append(made)
        side = _distances(x, points).argmin(1)
        made.below = [node(x[side == j], want * (side == j).mean()) for j in range(len(points))]
        return made

    tree.root = node(_lift(sample, longest), min(leaves, LEAVES))
    return tree


def deal(tree: Tree, x: np.ndarray, seen=None) -> np.ndarray:
    """The leaf of each lifted vector; seen(node, child, distances) is told what passes."""
    out = np.zeros(len(x), np.int32)
    todo = [(tree.root, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if isinstance(at, int):
            out[rows] = at
            continue
        d = _distances(x[rows], at.points)
        side = d.argmin(1)
        for j, below in enumerate(at.below):
            mine = side == j
            if seen is not None and mine.any():
                seen(at, j, d[mine])
            todo.append((below, rows[mine]))
    return out


def reached(tree: Tree, anchors: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """[anchor, leaf]: may a vector of the leaf lie between these two distances of the anchor?"""
    out = np.zeros((len(anchors), tree.leaves), bool)
    todo = [(tree.root, np.arange(len(anchors)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if isinstance(at, int):
            out[rows, at] = True
            continue
        d = _distances(anchors[rows], at.points)[:, :, None]
        # By the triangle inequality, over every split point i: |d - y| <= distance <= d + y for some y in [low, high].
        slack = 1e-6 * (1 + np.sqrt(tree.longest) + np.linalg.norm(anchors[rows], axis=1))[:, None, None]
        nearest = np.maximum(at.low[None] - d, d - at.high[None]) - slack
        farthest = d + at.high[None] + slack
        keep = ((nearest <= greatest[rows, None, None]) & (farthest >= least[rows, None, None])).all(1)
        todo += [(below, rows[keep[:, j]]) for j, below in enumerate(at.below)]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


def _by_length(batch: pa.RecordBatch, name: str):
    """(length, rows, integer vectors) for each vector length of a batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, _matrix(batch.column(name).take(pa.array(at)), int(dim))


def usable(embedding: Column) -> Column:
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def entries(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, asks, v (whole numbers), dim, gid of the rows that take part; gid names a label and vector."""
    use = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    use = use.select("vec_id", F.col("label").cast("long").alias("label"), "asks", whole.alias("v"))
    return use.withColumn("dim", F.size("v")).withColumn("gid", F.sha2(F.concat_ws(",", "label", F.col("v").cast("array<string>")), 256))


def _distinct(use: DataFrame) -> DataFrame:
    """One row per label and vector, with its MOST least ids; ids are cut in every task before they meet."""
    first = use.withColumn("__rank", F.row_number().over(Window.partitionBy("gid").orderBy("vec_id"))).where(F.col("__rank") <= MOST)
    return first.groupBy("gid").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.first("dim").alias("dim"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _trees(vectors: DataFrame, leaf: int, fan: int) -> dict[int, Tree]:
    """A tree per vector length, its ranges not yet known. A bounded sample per length and one row of figures reach the driver."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    figures = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest"))
    trees = {}
    for dim, n, longest in figures.collect():
        sample = vectors.where(F.col("dim") == dim).orderBy("gid").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
        trees[dim] = grow(_matrix(sample, dim).astype(np.float64), longest, -(-n // leaf), fan)
    return trees


def _dealt(vectors: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    def run(batches):
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int32)
            for dim, at, v in _by_length(batch, "v"):
                leaf[at] = deal(trees[dim], _lift(v.astype(np.float64), trees[dim].longest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kinds}, leaf int")


def _with_ranges(vectors: DataFrame, trees: dict[int, Tree]) -> dict[int, Tree]:
    """The ranges over all vectors: one row per task, node and child, combined; at most fan numbers per child of a tree reach the driver."""

    def run(batches):
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for dim, _, v in _by_length(batch, "v"):

                def seen(node, j, d, dim=dim):
                    low, high = held.get((dim, node.number, j), (np.inf, -np.inf))
                    held[dim, node.number, j] = np.minimum(low, d.min(0)), np.maximum(high, d.max(0))

                deal(trees[dim], _lift(v.astype(np.float64), trees[dim].longest), seen)
        rows = [(dim, node, j, i, float(a), float(b)) for (dim, node, j), (low, high) in held.items() for i, (a, b) in enumerate(zip(low, high, strict=True))]
        names = ["dim", "node", "child", "point", "low", "high"]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int32()] * 4 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for tree in trees.values():
        for node in tree.nodes:
            k = len(node.points)
            node.low, node.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    parts = vectors.select("dim", "v").mapInArrow(run, "dim int, node int, child int, point int, low double, high double")
    for dim, node, child, point, low, high in parts.groupBy("dim", "node", "child", "point").agg(F.min("low"), F.max("high")).collect():
        at = trees[dim].nodes[node]
        at.low[point, child], at.high[point, child] = low, high
    return trees


def _cut(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Numbers for groups of so many rows that lie together in the tree."""
    return numbered(rows, [F.col("dim"), F.col("leaf"), F.col("gid")], "__no").withColumn(name, F.floor(F.col("__no") / size)).drop("__no")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < EXACT else a @ b.T


def _first(scores: np.ndarray, ids: list[np.ndarray], fits: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(place, score, id) of the first rows in the order of score and id; a place stands for several ids."""
    some = np.flatnonzero(fits)
    if len(some) > most:
        # Entries at or above the last that can be among the first: each holds one id at least.
        bar = np.partition(scores[some], len(some) - most)[len(some) - most]
        some = some[scores[some] >= bar]
    found = sorted((-int(scores[p]), int(i), int(p)) for p in some for i in ids[p][:most])
    return [(p, -s, i) for s, i, p in found[:most]]


def _lists(column: pa.ListScalar, field_name: str) -> list[np.ndarray]:
    values = column.values.field(field_name)
    flat, offsets = values.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))))
    return [flat[offsets[i] : offsets[i + 1]] for i in range(len(values))]


def _sides(batch: pa.RecordBatch, i: int):
    dim, left, right = batch.column("dim")[i].as_py(), batch.column("anchors")[i].values, batch.column("block")[i]
    who = np.array(batch.column("who")[i].as_py(), np.int64)
    mine = left.take(pa.array(who))
    rows = right.values
    scores = _products(_matrix(mine.field("v"), dim), _matrix(rows.field("v"), dim))
    return mine, rows, scores, _lists(right, "ids"), mine.field("label").to_numpy()[:, None] == rows.field("label").to_numpy()[None, :]


class _Best:
    """The first answers of each question met in a task: pairs of a chunk and a block give few rows, not one set each."""

    def __init__(self, most: int, columns: list[tuple[str, pa.DataType]]):
        self.most, self.schema, self.held = most, pa.schema(columns), {}

    def add(self, key: tuple, found: list[tuple]) -> None:
        self.held[key] = sorted(self.held.get(key, []) + found, key=lambda f: (-f[0], f[1]))[: self.most]

    def rows(self, above: int = 0):
        if len(self.held) > above:
            rows = [(*key, *f) for key, found in self.held.items() for f in found]
            self.held = {}
            columns = zip(*rows, strict=True) if rows else [[]] * len(self.schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, self.schema.types, strict=True)], schema=self.schema)


def _positives(batches):
    """The best entries of its own label for each anchor."""
    best = _Best(MOST, [("gid", pa.string()), ("score", pa.int64()), ("id", pa.int64()), ("own", pa.bool_())])
    for batch in batches:
        for i in range(batch.num_rows):
            mine, rows, scores, ids, same = _sides(batch, i)
            gid, other = mine.field("gid").to_pylist(), rows.field("gid").to_pylist()
            for k in range(len(mine)):
                best.add((gid[k],), [(s, x, gid[k] == other[p]) for p, s, x in _first(scores[k], ids, same[k], MOST)])
            yield from best.rows(ANSWERS)
    yield from best.rows()


def _below(least: int):
    """The first entries of other labels at or below each positive's score and not under `least` hundredths of it."""

    def run(batches):
        best = _Best(NEGATIVES, [("gid", pa.string()), ("positive_score", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                mine, rows, scores, ids, same = _sides(batch, i)
                gid, asked = mine.field("gid").to_pylist(), mine.field("asked").to_pylist()
                for k in range(len(mine)):
                    for p in asked[k]:
                        fits = ~same[k] & (scores[k] <= p) & (scores[k] >= -(-least * p // 100))
                        if fits.any():
                            best.add((gid[k], p), [(s, x) for _, s, x in _first(scores[k], ids, fits, NEGATIVES)])
                yield from best.rows(ANSWERS)
        yield from best.rows()

    return run


def _work(anchors: DataFrame, blocks: DataFrame, trees: dict[int, Tree], window, own: bool | None = None) -> DataFrame:
    """Pairs of a chunk of anchors and a block of vectors, with the anchors (`who`) whose window reaches the block's leaf.

    window(rows) gives each anchor's least and greatest score; own=True: the anchor's own leaf alone, own=False: all others.
    """
    held = anchors.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, chunk, rows = batch.column("dim")[i].as_py(), batch.column("chunk")[i].as_py(), batch.column("rows")[i].values
                tree, leaf = held.value[dim], rows.field("leaf").to_numpy()
                at_home = leaf[:, None] == np.arange(tree.leaves)[None, :]
                if own:
                    hit = at_home
                else:
                    x = _matrix(rows.field("v"), dim).astype(np.float64)
                    low, high = window(rows)
                    far = (x * x).sum(1) + tree.longest
                    slack = 1e-6 * (1 + far)
                    least, greatest = np.sqrt(np.maximum(far - 2 * high - slack, 0)), np.sqrt(np.maximum(far - 2 * low + slack, 0))
                    hit = reached(tree, _anchor(x), least, greatest) & ((high >= low)[:, None])
                    if own is False:
                        hit &= ~at_home
                some = np.flatnonzero(hit.any(0))
                who = [np.flatnonzero(hit[:, s]).astype(np.int32) for s in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(some), pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(some.astype(np.int32)), pa.array(who, pa.list_(pa.int32()))],
                    ["dim", "chunk", "leaf", "who"],
                )

    pairs = anchors.mapInArrow(run, "dim int, chunk long, leaf int, who array<int>")
    # The block's number is in the key of the wide join: a leaf with very many vectors is many keys.
    pairs = pairs.join(blocks.select("dim", "leaf", "at"), ["dim", "leaf"])
    left = anchors.select("dim", "chunk", F.col("rows").alias("anchors"))
    right = blocks.select("dim", "leaf", "at", F.col("rows").alias("block"))
    return pairs.join(left, ["dim", "chunk"]).join(right, ["dim", "leaf", "at"]).select("dim", "who", "anchors", "block")


def _best(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _bound(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    low = rows.field("least").to_numpy(zero_copy_only=False).astype(np.float64)
    return np.where(np.isnan(low), -np.inf, low), np.full(len(low), np.inf)


def _margin(least: int):
    def window(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        asked = [[p for p in a if p >= 0] for a in rows.field("asked").to_pylist()]
        low = np.array([-(-least * min(a) // 100) if a else 1 for a in asked], np.float64)
        return low, np.array([max(a) if a else 0 for a in asked], np.float64)

    return window


def mine(
    embeddings: DataFrame, anchor: Column, least: int = 80, leaf: int = LEAF, fan: int = FAN, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    embeddings: vec_id, embedding, label; anchor: which rows are anchors, a condition on these columns; least: the least score of a negative, in
    hundredths of its positive's.
    """
    use = settled(entries(embeddings.select("vec_id", "embedding", "label", F.coalesce(anchor, F.lit(False)).alias("asks"))))
    vectors = settled(_distinct(use))
    trees = _trees(vectors, leaf, fan)
    vectors = settled(_dealt(vectors, trees))
    trees = _with_ranges(vectors, trees)
    blocks = _cut(vectors, block, "at").groupBy("dim", "leaf", "at").agg(F.collect_list(F.struct("gid", "label", "v", "ids")).alias("rows"))
    blocks = settled(blocks)

    anchors = settled(use.where("asks").groupBy("gid", "vec_id").agg(F.count(F.lit(1)).alias("copies")))
    asking = settled(_cut(vectors.drop("ids").join(anchors.select("gid").distinct(), "gid"), chunk, "chunk"))
    pack = lambda rows, *more: settled(rows.groupBy("dim", "chunk").agg(F.collect_list(F.struct("gid", "label", "v", "leaf", *more)).alias("rows")))

    # Own leaves first: the last of the best there bounds what the other leaves must offer.
    kinds = "gid string, score long, id long, own boolean"
    home = settled(_best(_work(pack(asking), blocks, trees, None, own=True).mapInArrow(_positives, kinds), ["gid"], MOST))
    bound = home.where(F.col("rank") == MOST).select("gid", F.col("score").alias("least"))
    away = _work(pack(asking.join(bound, "gid", "left"), "least"), blocks, trees, _bound, own=False)
    positives = settled(_best(home.drop("rank").union(away.mapInArrow(_positives, kinds)), ["gid"], MOST))

    asked = positives.groupBy("gid").agg(F.sort_array(F.collect_set("score")).alias("asked"))
    near = _work(pack(asking.join(asked, "gid"), "asked"), blocks, trees, _margin(least))
    negatives = _best(near.mapInArrow(_below(least), "gid string, positive_score long, score long, id long"), ["gid", "positive_score"], NEGATIVES)
    listed = negatives.groupBy("gid", F.col("positive_score").alias("score")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("negatives"))

    # At most MOST positives of NEGATIVES each per label and vector; an anchor's own entry is left out of its list.
    answers = positives.join(listed, ["gid", "score"], "left")
    answers = answers.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id", "own", "negatives"))).alias("answers"))
    return _told(anchors, answers)


def _told(anchors: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of a label and vector to each of its anchors, joined part by part, for anchors may be copies of one vector."""
    rows = anchors.withColumn("__part", F.spark_partition_id())
    told = rows.select("gid", "__part").distinct().join(answers, "gid")
    rows = rows.join(told, ["gid", "__part"])
    itself = F.filter("answers", lambda a: a["own"] & (a["id"] == F.col("vec_id")))
    skipped = F.coalesce(F.get(itself, F.lit(0))["rank"], F.lit(0))
    kept = F.slice(F.filter("answers", lambda a: a["rank"] != skipped), 1, POSITIVES)
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("vec_id", F.explode(kept).alias("p"))
    rows = rows.select(F.col("vec_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode("p.negatives").alias("n"))
    return rows.select(
        "anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score")
    )


def report(embeddings: DataFrame) -> DataFrame:
    """Anchors: ids divisible by 100. Ids divisible by 7 move to the next of ten labels first."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(embeddings.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)
