"""A Merkle manifest of a table of documents, with every document's proof, by slot pivots.

A leaf is the digest of a row. Per source the leaves stand in the order of doc_id; runs of `fan` nodes become one node until one is left,
the source's subroot, and the subroots in the order of the source become the root the same way. A level is one aggregation: the
children of a parent are spread into `fan` columns by their slot; all columns together hash to the parent, and all but the column of a
child's own slot are its siblings. Going down again, a node hands its children the siblings met so far, so a document
carries the nodes beside its path and never those of its source.

A group of the aggregation is one run of at most `fan` nodes, whatever the size of a source. Numbers within a source come from its
places in the parts of one range sort, so no task holds a source either.

Null columns are `-` in the leaf; a null source is a source and comes first, as does a null doc_id within its source (no decimals, so never
tampered with). Rows that share an id stand in the order of their leaves; equal rows are leaves of their own. No rows, no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlight.llm.common import numbered, settled

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a digest.
WIDTH = 32


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _said(digests: Column) -> Column:
    """Digests one after another as the hex text that is hashed and shown."""
    return F.lower(F.hex(digests))


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row as 32 bytes."""
    return _hash(F.concat(*[_field(c) for c in columns.values()]))


def tampered(every: int = 5) -> Column:
    """Documents whose copy at hand has been changed, for checking that proofs notice."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))


def leaves(documents: DataFrame, altered: Column, text: Column) -> DataFrame:
    """doc_id, source, digest, copy: the digest of each row, and of the copy at hand, in which `altered` rows have `text` instead of theirs."""
    own = {c: F.col(c) for c in COLUMNS}
    copy = F.when(altered, leaf({**own, "text": text}))
    return documents.select("doc_id", "source", leaf(own).alias("digest"), copy.alias("copy")).withColumn("copy", F.coalesce("copy", "digest"))


def placed(rows: DataFrame) -> DataFrame:
    """tree (rank of the source), idx (place within it), n (its rows) for every leaf."""
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("copy")]
    at = settled(settled(rows).sort(*order)).withColumn("__at", F.monotonically_increasing_id())
    at = at.withColumn("__part", F.shiftright("__at", 33))
    # One row per source and part of the sorted rows: where the source starts in the part, and how many of its rows lie in earlier parts.
    runs = settled(at.groupBy("source", "__part").agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__rows")))
    sources = runs.groupBy("source").agg(F.sum("__rows").alias("n"))
    trees = settled(numbered(sources, [F.asc_nulls_first("source")], "tree")).select(F.col("source").alias("__source"), "tree", "n")
    earlier = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.join(trees, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    runs = runs.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    runs = runs.select(F.col("source").alias("__source"), F.col("__part").alias("__p"), "__from", "__before", "tree", "n")
    # The part is in the key, so a source with a third of all rows is joined in as many pieces as it has parts.
    joined = at.join(runs, (F.col("__part") == F.col("__p")) & F.col("source").eqNullSafe(F.col("__source")))
    return joined.select("tree", (F.col("__before") + F.col("__at") - F.col("__from")).alias("idx"), "n", "digest", "doc_id", "copy")


def _pivot(nodes: DataFrame, fan: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The next level of the trees that still have several nodes: one row per parent, its children in the columns c0, c1, ..."""
    child = F.struct("digest", *carry)
    spread = [F.max(F.when(F.col("idx") % fan == k, child)).alias(f"c{k}") for k in range(fan)]
    wide = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {fan}").alias("idx"), F.expr(f"(n + {fan} - 1) div {fan}").alias("n")).agg(*spread)
    beside = ", ".join(f"coalesce(c{k}.digest, X'')" for k in range(fan))
    return wide.withColumn("run", F.expr(f"concat({beside})")).withColumn("digest", _hash(_said(F.col("run"))))


def _children(wide: DataFrame, parents: DataFrame, fan: int) -> DataFrame:
    """Rows of the level below: its columns of the pivot, and the parent's path with the own siblings in front: the run without the own column."""
    cells = F.filter(F.array(*[f"c{k}" for k in range(fan)]), lambda c: c.isNotNull())
    rows = wide.select("tree", "idx", "run", cells.alias("cells")).join(parents, ["tree", "idx"])
    rows = rows.select("tree", "idx", "run", "path", "subroot", "root", F.posexplode("cells").alias("slot", "child"))
    siblings = f"struct(substring(run, 1, {WIDTH} * slot) AS left, substring(run, {WIDTH} * slot + {WIDTH + 1}) AS right)"
    return rows.select("tree", F.expr(f"idx * {fan} + slot").alias("idx"), F.expr(f"concat(array({siblings}), path)").alias("path"), "subroot", "root", "child.*")


def _climb(nodes: DataFrame, fan: int, carry: tuple[str, ...] = ()) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels from the one above the leaves to the last, and for each height the trees that end there (tree, idx, digest and what is carried)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, ends = [], [nodes.where("n = 1")]
    while most > 1:
        nodes = settled(_pivot(nodes, fan, carry))
        levels.append(nodes)
        ends.append(nodes.where("n = 1").select("tree", "idx", "digest"))
        carry, most = (), -(-most // fan)
    return levels, ends


def _descend(levels: list[DataFrame], ends: list[DataFrame], starts: DataFrame, fan: int) -> DataFrame:
    """All leaves of the lowest level with their paths; starts: tree, path, subroot, root of each tree."""
    nodes = None
    for height in range(len(levels), -1, -1):
        begun = ends[height].join(starts, "tree")
        if nodes is not None:
            lower = _children(levels[height], nodes.select("tree", "idx", "path", "subroot", "root"), fan)
            begun = lower.unionByName(begun.select(*lower.columns))
        nodes = begun
    return nodes


def manifest(documents: DataFrame, altered: Column | None = None, text: Column | None = None, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root of every row.

    path lists the siblings level by level, as bytes left and right of the own node. folded_root is what path makes of the copy at hand: the
    rows as they are, but those that `altered` names with the given text. It equals root only if the copy is the row.
    """
    rows = leaves(documents, F.lit(False) if altered is None else altered, F.col("text") if text is None else text)
    base = settled(placed(rows))
    levels, ends = _climb(base, fan, ("doc_id", "copy"))
    subroots = ends[0].select("tree", "digest")
    for e in ends[1:]:
        subroots = subroots.union(e.select("tree", "digest"))
    subroots = settled(subroots)
    # The sources' own tree: its leaves are the subroots, in the order of the sources.
    top = settled(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(subroots.count()).cast("long").alias("n"), "digest"))
    above, last = _climb(top, fan)
    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    start = last[-1].select("tree", nothing.alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    heads = _descend(above, last, start, fan)
    heads = settled(heads.select(F.col("idx").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))
    fold = F.aggregate("path", F.col("copy"), lambda h, s: _hash(_said(F.concat(s["left"], h, s["right"]))))
    found = _descend(levels, ends, heads, fan)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", fold.alias("folded_root"))


def report(documents: DataFrame) -> DataFrame:
    """The manifest in hex, with one digest per proof; every fifth document's copy (by checksum of its id) is in small letters."""
    told = manifest(documents, tampered(), F.translate("text", UPPER, LOWER))
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: _said(F.concat(s["left"], s["right"])))), 256)
    digests = [_said(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return told.select("doc_id", *digests, proof.alias("proof_sha256"), _said(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))
