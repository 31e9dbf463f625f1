"""Call graph joins and bounded traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import columns as X
from patchlight.operators.budget import budget_break, running_total
from patchlight.operators.similar import occupied_buckets
from patchlight.session import cut_lineage

BUCKET_LINES = 64


def changed_nodes(added: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nodes whose line range holds an added line of their file.

    The range join is an equi-join on (file, 64-line bucket) with a residual range test; a node is
    repeated once per bucket that it spans and that holds an added line. Semi-join: a node stops at its first hit.
    """
    keys = keys or ["pr_id", "file"]
    points = added.select(*keys, F.col("new_line").alias("_line"), F.floor(F.col("new_line") / BUCKET_LINES).alias("_b")).distinct()
    spans = occupied_buckets(nodes, points, keys, "start_line", "end_line", BUCKET_LINES)
    points = points.select(*[F.col(k).alias(f"_{k}") for k in keys], "_line", F.col("_b").alias("_lb"))
    on = F.col("_b") == F.col("_lb")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    on = on & F.col("_line").between(F.col("start_line"), F.col("end_line"))
    return spans.join(points, on, "left_semi").drop("_b").distinct()


def changed_seed(node_ids: DataFrame, names: DataFrame, nodes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Changed nodes per change: by line first, then by name for names that lines did not resolve.

    names (pr_id, repo, name): a name means nodes of the change's own repository only. only (id): nodes that are wanted by name; a walk over
    callers wants those that are called, and a name that many nodes share is then not joined with all of them.
    """
    cols = ["pr_id", "repo", "id", "file", "name", "start_line"]
    info = nodes.select("repo", "id", "file", "name", "start_line")
    by_line = node_ids.select("pr_id", "id").distinct().join(info, "id").select(*cols)
    open_names = names.select("pr_id", "repo", "name").distinct().join(
        by_line.select("pr_id", "repo", "name").distinct(), ["pr_id", "repo", "name"], "left_anti"
    )
    named = info if only is None else info.join(only, "id", "left_semi")
    by_name = open_names.join(named, ["repo", "name"]).select(*cols).join(
        by_line.select("pr_id", "id"), ["pr_id", "id"], "left_anti"
    )
    return by_line.withColumn("from_diff_line", F.lit(True)).unionByName(
        by_name.select(*cols).withColumn("from_diff_line", F.lit(False))
    )


def callers_of(targets: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Resolved callers of given nodes; targets has id."""
    e = edges.where(F.col("callee_id").isNotNull()).select("caller_id", F.col("callee_id").alias("id"))
    n = nodes.select(F.col("id").alias("caller_id"), F.col("file").alias("caller_file"),
                     F.col("name").alias("caller_name"), F.col("start_line").alias("caller_start"))
    return e.join(targets.select("id").distinct(), "id", "left_semi").join(n, "caller_id")


def unresolved_counts(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("callee_id").isNull()).groupBy("repo", "callee_name").agg(F.count("*").alias("n"))


#: Callers in one cell of a list, and callers of a root's callers that meet in one group, both about.
LIST, MEET = 8_192, 131_072


def caller_lists(edges: DataFrame, counts: DataFrame, size: int = LIST) -> DataFrame:
    """root, ids: the callers of a node, in cells of about `size`. edges: root, id; counts: root, n."""
    hot = counts.where(F.col("n") > size).select("root", F.expr(f"n div {size} + 1").alias("_k"))
    cell = F.coalesce(F.pmod(F.xxhash64("id"), F.col("_k")), F.lit(0)).alias("_cell")
    return edges.join(hot, "root", "left").groupBy("root", cell).agg(F.collect_list("id").alias("ids")).select("root", "ids")


def callers_within(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = C.BFS_DEPTH, size: int = LIST, meet: int = MEET) -> DataFrame:
    """root, id, depth for callers within depth hops, in no order: what `bfs_callers` visits, without its paths.

    Callers move as lists, not as one row per path: a hop joins the frontier with the lists of its nodes and takes their union less what was
    visited. A root with more than `meet` callers of callers is dealt to groups by the hash of the caller; nothing is left out.
    """
    pairs = cut_lineage(
        edges.where(F.col("callee_id").isNotNull()).select(F.col("callee_id").alias("root"), F.col("caller_id").alias("id")).distinct()
        .join(nodes.select("id"), "id", "left_semi").where("id <> root"))
    counts = cut_lineage(pairs.groupBy("root").agg(F.count("*").alias("n")))
    lists = cut_lineage(caller_lists(pairs, counts, size))
    roots = seeds.select(F.col("id").alias("root")).distinct()
    levels = [lists.join(roots, "root", "left_semi")]
    for _ in range(1, depth):
        front = levels[-1].select("root", F.explode("ids").alias("id")).join(counts.withColumnRenamed("root", "id"), "id")
        front = cut_lineage(front)
        groups = front.groupBy("root").agg(F.expr(f"cast(sum(n) div {meet} + 1 as int)").alias("_k"))
        fresh = front.join(groups, "root").select("root", "_k", "id").join(lists.withColumnRenamed("root", "id"), "id").select(
            "root", "_k", "ids", F.lit(True).alias("_new"))
        seen = groups.select("root", "_k", F.array("root").alias("ids"), F.lit(False).alias("_new"))
        for level in levels:
            seen = seen.unionByName(level.join(groups, "root").select("root", "_k", "ids", F.lit(False).alias("_new")))
        dealt = fresh.unionByName(seen).withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        mine = F.when(F.col("_k") == 1, F.col("ids")).otherwise(
            F.filter("ids", lambda x: F.pmod(F.xxhash64(x), F.col("_k")) == F.col("_g")))
        met = dealt.select("root", "_g", mine.alias("ids"), "_new").repartition("root", "_g").groupBy("root", "_g").agg(
            F.collect_list(F.when(F.col("_new"), F.col("ids"))).alias("_fresh"), F.collect_list(F.when(~F.col("_new"), F.col("ids"))).alias("_seen"))
        level = met.select("root", F.array_except(F.flatten("_fresh"), F.flatten("_seen")).alias("ids")).where(F.size("ids") > 0)
        levels.append(level if len(levels) + 1 == depth else cut_lineage(level))
    out = None
    for d, level in enumerate(levels, 1):
        rows = level.select("root", F.explode("ids").alias("id"), F.lit(d).alias("depth"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _fitting(level: DataFrame, room: DataFrame, order: list[str]) -> DataFrame:
    """Rows of each root, in order, up to and with the first whose running total (cum) is over its room.

    Parts of a root by the hash of the caller are cut first: what fits in the whole fits in its part, and a part keeps its first row over the
    room, which holds back all that come after it. So a root with very many callers is no single task.
    """
    rows = level.join(room, "root").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(8)))
    cost = F.coalesce("tokens", F.lit(0))
    for keys in (["root", "_s"], ["root"]):
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = rows.withColumn("cum", F.sum(cost).over(w)).where(F.col("cum") - cost <= F.col("room"))
    return rows.drop("_s")


def bfs_callers(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = C.BFS_DEPTH,
                room: DataFrame | None = None) -> DataFrame:
    """root, id, depth, path for callers within depth hops; path orders them as a queue would.

    Nodes get one global number in (file, start_line, name) order; a path is the numbers from the
    first caller on, so the first visit of a node is a minimum over numbers. Each hop is one
    equi-join of the frontier on callee_id. Each hop but the last is read again as frontier and visited set and is checkpointed.

    room (root, room): only a root's first callers whose tokens (of nodes) fit its room together and the next one are given, with their running
    total cum; a root that is full walks no further, and the walk ends when all are.
    """
    kept = ["tokens"] if room is not None else []
    numbered = running_total(
        nodes.select("id", "file", "start_line", "name", *kept, F.lit(1).alias("_one")),
        ["_one"], ["file", "start_line", "name", "id"], "_one", "rank",
    ).select("id", F.col("rank").cast("bigint").alias("rank"), *kept)
    steps = (
        edges.where(F.col("callee_id").isNotNull())
        .select("callee_id", F.col("caller_id").alias("id")).distinct()
    )
    frontier = seeds.select(F.col("id").alias("root")).distinct().select(
        "root", F.col("root").alias("id"), F.array().cast("array<bigint>").alias("path"), F.lit(0).cast("bigint").alias("last"))
    if room is not None:
        room = room.select("root", F.col("room").cast("bigint").alias("room"), F.lit(0).cast("bigint").alias("_used"))
    visited = levels = None
    for d in range(1, depth + 1):
        met = frontier.select("root", F.col("id").alias("callee_id"), "path", "last").join(steps, "callee_id").where("id <> root")
        if d == 1:
            # A root's own callers are distinct already.
            reached = met.select("root", "id", F.col("last").alias("_l"))
        else:
            # Paths of at most one number are compared as plain numbers, which hash aggregation can hold.
            first = F.min("last").alias("_l") if d == 2 else F.min("path").alias("_p")
            reached = met.groupBy("root", "id").agg(first).join(visited, ["root", "id"], "left_anti")
        reached = reached.join(numbered, "id").withColumnRenamed("rank", "last")
        if room is not None:
            reached = _fitting(reached, room, ["last"] if d == 1 else ["_l", "last"] if d == 2 else ["_p", "last"])
        if d == 1:
            before = F.array().cast("array<bigint>")
        else:
            before = F.array("_l") if d == 2 else F.col("_p")
        carried = ["tokens", "cum", "room", "_used"] if room is not None else []
        reached = reached.select("root", "id", F.concat(before, F.array("last")).alias("path"), "last", *carried)
        if d < depth:
            reached = cut_lineage(reached)
        level = reached.select("root", "id", "path", F.lit(d).alias("depth"))
        if room is not None:
            level = reached.select("root", "id", "path", F.lit(d).alias("depth"), "tokens", (F.col("cum") + F.col("_used")).alias("cum"))
            left = reached.groupBy("root").agg(
                F.max("cum").alias("_c"), (F.max("room") - F.max("cum")).alias("room"), (F.max("_used") + F.max("cum")).alias("_used"))
            room = left.where("room >= 0").select("root", "room", "_used")
            reached = reached.join(room.select("root"), "root", "left_semi")
            # Where no root has room for another hop, edges are not read again.
            if d < depth and reached.isEmpty():
                return levels.unionByName(level) if levels is not None else level
        levels = level if levels is None else levels.unionByName(level)
        seen = reached.select("root", "id")
        visited = seen if visited is None else visited.unionByName(seen)
        frontier = reached
    return levels


def blast_radius(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, budgets: DataFrame,
                 depth: int = C.BFS_DEPTH) -> DataFrame:
    """Callers per changed node and change, under the change's token budget.

    seeds: pr_id, id, file, name, start_line, from_diff_line. budgets: pr_id, budget. A group takes callers in order and ends at the first that
    does not fit, so of a root only the first callers within the largest budget it serves can be taken by any change; more are not met by its changes.
    """
    sized = nodes.select("id", "file", "start_line", "name", X.tokens(F.col("code")).alias("tokens"))
    seeds, budgets = cut_lineage(seeds), cut_lineage(budgets)
    room = seeds.select("pr_id", F.col("id").alias("root")).join(budgets, "pr_id").groupBy("root").agg(F.max("budget").alias("room"))
    reached = bfs_callers(seeds, edges, sized, depth, room)
    rows = seeds.select(
        "pr_id", F.col("id").alias("root"),
        F.struct(
            (~F.col("from_diff_line")).alias("by_name"),
            F.when(F.col("from_diff_line"), "").otherwise(F.col("name")).alias("seed_name"),
            "file", "start_line", "name", "id",
        ).alias("g"),
    ).join(reached.withColumnRenamed("id", "caller_id"), "root")
    taken = budget_break(
        rows.select("pr_id", "g", "caller_id", "depth", "path", "tokens", "cum"), budgets, ["g"], ["depth", "path"]
    )
    info = nodes.select(F.col("id").alias("caller_id"), F.col("file").alias("caller_file"),
                        F.col("name").alias("caller_name"), F.col("start_line").alias("caller_start"))
    return taken.join(info, "caller_id").select(
        "pr_id", F.col("g.id").alias("root"),
        F.concat(F.col("g.file"), F.lit(":"), F.col("g.name")).alias("changed_fn"),
        (~F.col("g.by_name")).alias("from_diff_line"), "g",
        "caller_id", "caller_file", "caller_name", "caller_start", "depth", "path",
    )


def resolve_calls(calls: DataFrame, nodes: DataFrame, imports: DataFrame, tasks: int | None = None) -> DataFrame:
    """repo, callee_id and resolution for (caller_id, callee_name, callee_short_name).

    Tried in order: same file by full name, by short name; import binding; dotted import prefix with
    a unique node; full name that is unique in the repository; unique short name. nodes and imports carry
    repo, and no step leaves the caller's repository. Calls of one file to one name resolve alike, so only distinct
    (repo, file, name, short name) go through the lookups; each lookup has one row per key. Calls that bring repo and file
    are not looked up for them. tasks: among how many tasks calls meet what was found, where the session's partitions are too few.
    """
    in_file = nodes.groupBy("repo", "file", "name").agg(
        F.max("id").alias("own"), F.min("id").alias("low"), F.count("*").alias("cnt"))
    bound = (
        imports.join(in_file.select("repo", F.col("file").alias("source_file"), "name", "low"), ["repo", "source_file", "name"])
        .groupBy("repo", "file", "name").agg(F.min("low").alias("imported"))
    )
    prefixes = imports.groupBy("repo", "file", F.col("name").alias("_prefix")).agg(F.min("source_file").alias("_sf"))
    unique = nodes.groupBy("repo", "name").agg(F.min("id").alias("nid"), F.count("*").alias("cnt")).where("cnt = 1")
    by = {
        "i1": in_file.select("repo", "file", F.col("name").alias("callee_name"), F.col("own").alias("i1")),
        "i2": in_file.select("repo", "file", F.col("name").alias("callee_short_name"), F.col("own").alias("i2")),
        "i3": bound.select("repo", "file", F.col("name").alias("callee_name"), F.col("imported").alias("i3")),
        "i4": in_file.where("cnt = 1").select("repo", F.col("file").alias("_sf"), F.col("name").alias("callee_short_name"), F.col("low").alias("i4")),
        "i5": unique.select("repo", F.col("name").alias("callee_name"), F.col("nid").alias("i5")),
        "i6": unique.select("repo", F.col("name").alias("callee_short_name"), F.col("nid").alias("i6")),
    }
    prefix = F.when(F.col("callee_name").contains("."), F.regexp_extract("callee_name", r"^(.*)\.[^.]*$", 1))
    placed = calls if {"repo", "file"} <= set(calls.columns) else calls.join(nodes.select(F.col("id").alias("caller_id"), "repo", "file"), "caller_id")
    key = ["repo", "file", "callee_name", "callee_short_name"]
    out = (
        placed.select(*key).distinct()
        .join(by["i1"], ["repo", "file", "callee_name"], "left")
        .join(by["i2"], ["repo", "file", "callee_short_name"], "left")
        .join(by["i3"], ["repo", "file", "callee_name"], "left")
        .withColumn("_prefix", prefix).join(prefixes, ["repo", "file", "_prefix"], "left")
        .join(by["i4"], ["repo", "_sf", "callee_short_name"], "left")
        .join(by["i5"], ["repo", "callee_name"], "left")
        .join(by["i6"], ["repo", "callee_short_name"], "left")
    )
    label = (
        F.when(F.coalesce("i1", "i2").isNotNull(), "in_file").when(F.col("i3").isNotNull(), "import")
        .when(F.col("i4").isNotNull(), "prefix").when(F.col("i5").isNotNull(), "unique")
        .when(F.col("i6").isNotNull(), "unique_short"))
    found = out.select(*key, F.coalesce("i1", "i2", "i3", "i4", "i5", "i6").alias("callee_id"), label.alias("resolution"))
    dealt = placed if tasks is None else placed.repartition(tasks, *key)
    return dealt.join(found, key, "left").select("repo", "caller_id", "callee_name", "callee_short_name", "callee_id", "resolution")


#: Fixed patterns.
DEFINITION = (
    r"(?:async\s+)?def\s+(\w+)\s*\(|(?:async\s+)?function\s+(\w+)\s*\(|(?:const|let)\s+(\w+)\s*=\s*(?:async\s+)?\("
)


def called_lines(lines: DataFrame) -> DataFrame:
    """Added lines with a parenthesis: all that `new_callers` and `new_functions` look at."""
    return lines.where((F.col("kind") == "add") & F.col("file").isNotNull() & F.col("text").contains("(")).select(
        "pr_id", "file", "new_line", "pos", "kind", "text")


def new_callers(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Added lines that call a function the same change defines, other than its definition line.

    Calls are tokenized and equi-joined on (change, name); no regex join.
    """
    add = lines.where((F.col("kind") == "add") & F.col("file").isNotNull()).select(
        "pr_id", "file", "new_line", "pos", "text")
    defs_on = F.filter(F.concat(*[F.regexp_extract_all("text", F.lit(DEFINITION), F.lit(i)) for i in (1, 2, 3)]),
                       lambda n: n != "")
    rows = add.withColumn("defs", defs_on)
    defined = rows.select("pr_id", "file", "pos", F.explode("defs").alias("name"))
    def_file = defined.groupBy("pr_id", "name").agg(F.min_by("file", "pos").alias("def_file"))
    calls = rows.select(
        "pr_id", "file", "new_line", "text",
        F.explode(F.array_except(
            F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\w+)\s*\("), F.lit(1))), "defs")).alias("name"),
    )
    return (
        calls.join(names.select("pr_id", "name").distinct(), ["pr_id", "name"])
        .join(def_file, ["pr_id", "name"], "left")
        .select(
            "pr_id", "name",
            F.when(F.col("def_file").isNull(), F.col("name")).otherwise(F.concat("def_file", F.lit(":"), "name")).alias("changed_fn"),
            F.col("file").alias("caller_file"), F.col("new_line").alias("caller_start"),
            F.concat(F.lit("<call at line "), F.col("new_line").cast("string"), F.lit(">")).alias("caller_name"),
            F.regexp_replace("text", r"[ \t]+$", "").alias("code"),
        )
    )


def fn_short(changed_fn: Column) -> Column:
    return F.substring_index(changed_fn, ":", -1)


def supplement(groups: DataFrame, from_diff: DataFrame) -> DataFrame:
    """Graph groups plus the diff-found groups whose short name the graph did not cover."""
    covered = groups.select("pr_id", fn_short(F.col("changed_fn")).alias("_s")).distinct()
    extra = from_diff.withColumn("_s", fn_short(F.col("changed_fn"))).join(covered, ["pr_id", "_s"], "left_anti").drop("_s")
    return groups.withColumn("from_diff", F.lit(False)).unionByName(
        extra.withColumn("from_diff", F.lit(True)), allowMissingColumns=True)


def first_callers(groups: DataFrame, order: list[str], n: int = C.CALLERS_PER_FUNCTION) -> DataFrame:
    """First n callers per changed function: a ranked limit, applied before and after the shuffle."""
    w = W.partitionBy("pr_id", "changed_fn").orderBy(*order)
    return groups.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def finding_callers(findings: DataFrame, groups: DataFrame, order: list[str], n: int = C.CALLERS_PER_FUNCTION) -> DataFrame:
    """(finding, caller) pairs over functions of the finding's file, at most n callers per function."""
    top = first_callers(groups, order, n).withColumn("file", F.regexp_extract("changed_fn", r"^(.*):[^:]*$", 1))
    return findings.join(top.where("file <> ''"), ["pr_id", "file"])


#: Fixed patterns.
UNSAFE = [r"\b(\w+)\s*\[", r"\b(\w+)\s*\.", r"\bgetattr\s*\(", r"\bsetattr\s*\(", r"f[\"'].*\{(\w+)\}"]
GUARD = r"\bif\s+\w+\s+is\s+(not\s+)?None\b|\bisinstance\s*\(|\bif\s+not\s+\w+\b|\bAssert\b|\bassert\b"


def unsafe_sink(chunk: Column) -> Column:
    """Added code uses a value as key, index or object, and holds no guard."""
    added = F.filter(F.split(chunk, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    body = F.array_join(F.transform(added, lambda x: F.substring(x, 2, 2**31 - 1)), "\n")
    risky = F.lit(False)
    for pattern in UNSAFE:
        risky = risky | body.rlike(pattern)
    return (F.size(added) > 0) & ~body.rlike(GUARD) & risky


def caller_check(groups: DataFrame, chunks: DataFrame, order: list[str],
                 functions: int = C.FUNCTIONS_PER_PR, callers: int = C.CALLERS_PER_FUNCTION) -> DataFrame:
    """Callers to check: the first functions per change whose file diff has an unsafe sink."""
    risky = chunks.where(unsafe_sink(F.col("chunk"))).select("pr_id", F.col("file").alias("_f"))
    keyed = groups.withColumn("_f", F.regexp_extract("changed_fn", r"^(.*):[^:]*$", 1))
    able = keyed.join(risky, ["pr_id", "_f"], "left_semi")
    fns = able.groupBy("pr_id", "changed_fn").agg(F.min("group_ord").alias("go"))
    w = W.partitionBy("pr_id").orderBy("go", "changed_fn")
    chosen = fns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= functions)
    return first_callers(able.join(chosen, ["pr_id", "changed_fn"], "left_semi"), order, callers).drop("_f")


def call_site(code: Column, name: Column, context: int = C.CALL_SITE_LINES) -> Column:
    """Short code whole; else from the first line to a few lines past the first call."""
    lines = F.split(F.regexp_replace(code, r"\n\z", ""), "\n")
    at = F.array_position(
        F.transform(lines, lambda x: x.contains(name) & x.contains("(") & ~x.contains("def ") & ~x.contains("function ")),
        True,
    )
    return (
        F.when(F.length(code) <= C.CALL_SITE_CHARS, code)
        .when(at > 0, F.array_join(F.slice(lines, F.lit(1), (at + context).cast("int")), "\n"))
        .otherwise(F.left(code, F.lit(C.CALL_SITE_CHARS)))
    )


def changed_files(current: DataFrame, known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files whose hash is new since the last index."""
    keys = keys or ["repo", "file"]
    return current.join(known.select(*keys, "hash"), [*keys, "hash"], "left_anti")


def replace_rows(stored: DataFrame, fresh: DataFrame, changed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stored rows of unchanged files plus fresh rows; the new table state to write per repository."""
    keys = keys or ["repo", "file"]
    return stored.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def stale_edges(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges whose callee lives in a changed file: to be resolved again."""
    gone = nodes.join(changed.select("repo", "file").distinct(), ["repo", "file"], "left_semi").select(
        F.col("id").alias("callee_id"))
    return edges.join(gone, "callee_id", "left_semi")
