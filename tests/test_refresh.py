import random

from patchlight.operators import refresh as RF

FILES = "repo string, file string, content string"


def _python(r, names, modules):
    lines = [f"from .{m} import {r.choice(names)}" for m in r.sample(modules, 2)] + [f"import {r.choice(modules)}"]
    for n in r.sample(names, r.randint(1, 3)):
        lines += ["", f"def {n}(x):", f"    y = {r.choice(names)}(x)", f"    return {r.choice(modules)}.{r.choice(names)}(y)"]
    return "\n".join(lines) + "\n"


def _script(r, names, modules):
    lines = [f"import {{ {r.choice(names)} }} from './{r.choice(modules)}';"]
    for n in r.sample(names, r.randint(1, 2)):
        lines += [f"export function {n}(x) {{", f"  return {r.choice(names)}({r.choice(names)}(x));", "}"]
    return "\n".join(lines) + "\n"


def _file(r, file):
    names, modules = [f"fn{k}" for k in range(9)], [f"m{k}" for k in range(6)]
    return (_python if file.endswith(".py") else _script)(r, names, modules)


def _same(spark, state, files):
    whole = RF.index(spark.createDataFrame([(a, b, c) for (a, b), c in files.items()], FILES))
    for name in ("hashes", "nodes", "calls", "imports", "edges"):
        got, want = getattr(state, name), getattr(whole, name)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())), name
    return whole


def test_refresh_equals_an_index_of_all_files(spark, tmp_path):
    """Two rounds of edits in two repositories: files changed, added, removed, put back, and a round without any edit."""
    r = random.Random(3)
    paths = [f"m{k}.py" for k in range(6)] + [f"m{k}.{e}" for k in range(4) for e in ("ts", "js")]
    files = {(repo, p): _file(r, p) for repo in "ab" for p in r.sample(paths, 9)}
    state = RF.index(spark.createDataFrame([(a, b, c) for (a, b), c in files.items()], FILES))
    path = str(tmp_path / "state")
    for version in range(3):
        if version:
            for key in r.sample(sorted(files), 2):
                del files[key]
            for p in r.sample(paths, 3):
                files["a", p] = _file(r, p)
        state = RF.refresh(state, spark.createDataFrame([(a, b, c) for (a, b), c in files.items()], FILES))
        whole = _same(spark, state, files)
        assert whole.edges.where("callee_id IS NOT NULL").count() > 10
        RF.write(state, path, version)
        RF.write(state, path, version)
        state = RF.read(spark, path)
    # A version that was not finished is not read.
    state.nodes.limit(1).write.parquet(f"{path}/nodes/version=9")
    _same(spark, RF.read(spark, path), files)


def test_only_calls_that_can_differ_are_resolved_again(spark):
    """Edges that no edit touches are carried over as they are, right or not."""
    a = "def one(x):\n    return two(x)\n"
    files = {("r", "a.py"): a, ("r", "b.py"): "def two(x):\n    return x\n", ("r", "c.py"): "def three(x):\n    return one(x)\n"}
    frame = lambda: spark.createDataFrame([(k, f, c) for (k, f), c in files.items()], FILES)
    state = RF.index(frame())
    marked = RF.State(state.hashes, state.nodes, state.calls, state.imports, state.edges.selectExpr("repo", "caller_id", "callee_name", "callee_short_name", "callee_id", "'kept' AS resolution"))
    files["r", "b.py"] = "def two(x):\n    return 1\n\ndef more(x):\n    return three(x)\n"
    got = {r.callee_name: r.resolution for r in RF.refresh(marked, frame()).edges.collect()}
    assert got == {"two": "kept", "one": "kept", "three": "unique"}
    files["r", "b.py"] = "def four(x):\n    return 1\n"
    got = {r.callee_name: r.resolution for r in RF.refresh(marked, frame()).edges.collect()}
    assert got == {"two": None, "one": "kept"}


def test_calls_are_looked_at_once_and_not_placed_again(spark, monkeypatch):
    """a call is asked by its file, its name or its short name, or stays; what is asked keeps the file it brings."""
    resolved, kept = [], RF.resolve_calls
    monkeypatch.setattr(RF, "resolve_calls", lambda calls, nodes, *a: resolved.append((calls.columns, calls.count(), nodes.count())) or kept(calls, nodes, *a))
    nodes = spark.createDataFrame([("r", "a.py", 1, "one"), ("r", "b.py", 2, "two"), ("r", "c.py", 3, "three")], "repo string, file string, id long, name string")
    called = [("r", "a.py", 1, "x.two", "two"), ("r", "b.py", 2, "three", "three"), ("r", "c.py", 3, "one", "one"), ("r", "c.py", 3, "new", "new")]
    calls = spark.createDataFrame(called, "repo string, file string, caller_id long, callee_name string, callee_short_name string")
    edges = calls.selectExpr("repo", "caller_id", "callee_name", "callee_short_name", "-1L AS callee_id", "'kept' AS resolution")
    gone = spark.createDataFrame([("r", 9, "gone", "gone", 1, "kept"), ("r", 2, "gone", "gone", 1, "kept")], edges.schema)
    imports = spark.createDataFrame([], "repo string, file string, name string, source_file string")
    touched = spark.createDataFrame([("r", "b.py")], "repo string, file string")
    moved = spark.createDataFrame([("r", "two"), ("r", "three")], "repo string, name string")
    got = {(r.caller_id, r.callee_name): (r.callee_id, r.resolution) for r in RF.refresh_edges(edges.unionByName(gone), calls, nodes, imports, touched, moved, 3).collect()}
    assert got == {(1, "x.two"): (2, "unique_short"), (2, "three"): (3, "unique"), (3, "one"): (-1, "kept"), (3, "new"): (-1, "kept")}
    assert resolved == [(RF.CALL, 2, 2)]
