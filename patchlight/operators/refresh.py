"""An indexed call graph kept up to date from the files that changed.

A state is five tables: hashes, nodes, calls, imports and edges. Only changed files are read again, and only those calls are resolved again whose answer can differ:
calls in files whose calls or imports changed, and calls of a name that a changed file gained, lost or moved. Everything else is carried over by anti-joins, so the work
follows the change; the result equals an index of all files.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.functions import columns as X
from patchlight.operators import code as CD
from patchlight.operators import names as N
from patchlight.operators.graph import changed_files, replace_rows, resolve_calls
from patchlight.session import cut_lineage

FILE = ["repo", "file"]
CALL = ["repo", "file", "caller_id", "callee_name", "callee_short_name"]


@dataclass
class State:
    hashes: DataFrame  # repo, file, hash
    nodes: DataFrame  # repo, file, id, name, start_line, end_line, code
    calls: DataFrame  # repo, file, caller_id, callee_name, callee_short_name
    imports: DataFrame  # repo, file, name, source_file
    edges: DataFrame  # repo, caller_id, callee_name, callee_short_name, callee_id, resolution

    def cut(self) -> State:
        return State(*[cut_lineage(getattr(self, f.name)) for f in fields(self)])


def _imports(files: DataFrame, present: DataFrame) -> DataFrame:
    """Imports of some files, of which those by path are looked up among all that are present."""
    lang = CD.language(F.col("file"))
    py = N.py_imports(files.where(lang == "python"), FILE)
    ts = N.ts_imports(files.where(lang.isin("javascript", "typescript")), FILE, all_files=present)
    return py.unionByName(ts).select(*FILE, "name", "source_file").distinct()


def _hashes(files: DataFrame) -> DataFrame:
    return files.select(*FILE, X.file_hash(F.col("content")).alias("hash"))


def index(files: DataFrame) -> State:
    """The state of files (repo, file, content), all read."""
    nodes = cut_lineage(CD.functions(files).select(*FILE, "id", "name", "start_line", "end_line", "code"))
    calls = cut_lineage(CD.calls(files, nodes).select(*CALL).distinct())
    imports = cut_lineage(_imports(files, files))
    return State(_hashes(files), nodes, calls, imports, resolve_calls(calls, nodes, imports)).cut()


def moved_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """repo, name of nodes that are in one of two tables only: a name whose nodes, files or ids changed in any way."""
    shape = ["repo", "file", "name", "id"]
    gone = old.select(*shape).exceptAll(new.select(*shape))
    return gone.union(new.select(*shape).exceptAll(old.select(*shape))).select("repo", "name").distinct()


def refresh_edges(edges: DataFrame, calls: DataFrame, nodes: DataFrame, imports: DataFrame, touched: DataFrame, moved: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges of the new calls, nodes and imports.

    touched (repo, file): files whose calls or imports may differ; moved (repo, name): see moved_names. edges are those before; calls are distinct.
    tasks: see resolve_calls.
    """
    touched, moved = touched.select(*FILE).distinct(), moved.select("repo", "name").distinct()
    # One look at each call, however many of the three say that it is asked.
    told = calls.select(*CALL).join(touched.withColumn("_t", F.lit(True)), FILE, "left")
    for name in ("callee_name", "callee_short_name"):
        told = told.join(moved.select("repo", F.col("name").alias(name), F.lit(True).alias(f"_{name}")), ["repo", name], "left")
    asked = cut_lineage(told.where(F.coalesce("_t", "_callee_name", "_callee_short_name")).select(*CALL))
    # Only nodes of names that are asked for; only imports of the files asked.
    names = asked.select("repo", F.explode(F.array("callee_name", "callee_short_name")).alias("name")).distinct()
    few = nodes.join(names, ["repo", "name"], "left_semi").select("repo", "file", "id", "name")
    bound = imports.join(asked.select(*FILE).distinct(), FILE, "left_semi")
    fresh = resolve_calls(asked, few, bound, tasks)
    # What stays: edges of callers in files that were not touched, to names that did not move; their calls are what they were.
    for name in ("callee_name", "callee_short_name"):
        edges = edges.join(moved.withColumnRenamed("name", name), ["repo", name], "left_anti")
    whole = nodes.join(touched, FILE, "left_anti").select(F.col("id").alias("caller_id"))
    return edges.join(whole, "caller_id", "left_semi").select(*fresh.columns).unionByName(fresh)


def refresh(state: State, files: DataFrame) -> State:
    """The state of files (repo, file, content), from the state before and the files that are new, changed or gone."""
    now = cut_lineage(_hashes(files))
    changed = cut_lineage(changed_files(now, state.hashes).select(*FILE))
    gone = state.hashes.join(now, FILE, "left_anti").select(*FILE)
    added = changed.join(state.hashes, FILE, "left_anti").select(*FILE)
    left = cut_lineage(changed.union(gone))
    read = files.join(changed, FILE, "left_semi")
    fresh_nodes = cut_lineage(CD.functions(read).select(*FILE, "id", "name", "start_line", "end_line", "code"))
    nodes = cut_lineage(replace_rows(state.nodes, fresh_nodes, left))
    calls = cut_lineage(replace_rows(state.calls, CD.calls(read, fresh_nodes).select(*CALL).distinct(), left))
    # An import by path finds another file when files come or go, so scripts of such a repository are looked at again.
    came = added.union(gone).select("repo").distinct()
    scripts = files.where(CD.language(F.col("file")).isin("javascript", "typescript")).join(came, "repo", "left_semi").select(*FILE)
    importing = cut_lineage(left.union(scripts).distinct())
    fresh_imports = _imports(files.join(importing, FILE, "left_semi"), files)
    imports = cut_lineage(replace_rows(state.imports, fresh_imports, importing))
    moved = moved_names(state.nodes.join(left, FILE, "left_semi"), fresh_nodes)
    return State(now, nodes, calls, imports, cut_lineage(refresh_edges(state.edges, calls, nodes, imports, importing, moved)))


def write(state: State, path: str, version: int) -> None:
    """One folder per version; the mark is written last, so a version is there whole or not at all, and writing it again replaces it."""
    for f in fields(state):
        getattr(state, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}/version={version}")
    spark = state.hashes.sparkSession
    spark.range(1).select(F.lit(version).alias("written")).write.mode("overwrite").parquet(f"{path}/marks/version={version}")


def read(spark: SparkSession, path: str) -> State:
    """The latest version that was written whole."""
    version = spark.read.parquet(f"{path}/marks").agg(F.max("written")).first()[0]
    return State(*[spark.read.parquet(f"{path}/{f.name}/version={version}") for f in fields(State)])
