import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlight.operators import budget as B
from patchlight.operators import code as CD
from patchlight.operators import graph as G
from patchlight.operators import names as N
from patchlight.operators import checks as CK


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id long, file string, name string, start_line int, end_line int, code string").withColumn("repo", F.lit("r"))


CHAIN = [(1, "a.py", "foo", 1, 5, "x" * 40), (2, "b.py", "bar", 1, 5, "y" * 40), (3, "c.py", "baz", 1, 5, "z" * 40)]


def test_bfs_levels_and_cycles(spark):
    n = nodes(spark, CHAIN)
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (1, 1)], "caller_id long, callee_id long")
    seeds = spark.createDataFrame([(1,)], "id long")
    got = {(r.id, r.depth) for r in G.bfs_callers(seeds, edges, n).collect()}
    assert got == {(2, 1), (3, 2)}
    deep = {(r.id, r.depth) for r in G.bfs_callers(seeds, edges, n, depth=4).collect()}
    assert deep == got


def test_blast_radius_budget(spark):
    n = nodes(spark, CHAIN)
    edges = spark.createDataFrame([(2, 1), (3, 2)], "caller_id long, callee_id long")
    seeds = spark.createDataFrame([(7, 1, "a.py", "foo", 1, True)], "pr_id long, id long, file string, name string, start_line int, from_diff_line boolean")
    for budget, want in ((100, {2, 3}), (19, {2}), (9, set())):
        b = spark.createDataFrame([(7, budget)], "pr_id long, budget long")
        assert {r.caller_id for r in G.blast_radius(seeds, edges, n, b).collect()} == want


def test_budget_break_goes_on_with_the_next_group(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, 50), (1, 0, 2, 1), (1, 1, 0, 4), (1, 1, 1, 1), (1, 2, 0, 0), (2, 0, 0, 0)],
                                 "pr_id long, g int, o int, tokens long")
    budgets = spark.createDataFrame([(1, 10), (2, 0)], "pr_id long, budget long")
    got = {(r.pr_id, r.g, r.o) for r in B.budget_break(rows, budgets, ["g"], ["o"]).collect()}
    assert got == {(1, 0, 0), (1, 1, 0), (1, 1, 1), (2, 0, 0)}


def test_budget_break_takes_running_totals_that_rows_bring(spark, monkeypatch):
    """what comes after a group's first row over the budget is not carried, and totals that are there are not made again."""
    rows = spark.createDataFrame([(1, 0, o, 4, 4 * (o + 1)) for o in range(50)] + [(1, 1, 0, 1, 1), (2, 0, 0, 9, 9), (2, 1, 0, 0, 0)],
                                 "pr_id long, g int, o int, tokens long, cum long")
    budgets = spark.createDataFrame([(1, 10), (2, 0)], "pr_id long, budget long")
    carried, cut = [], B.cut_lineage
    monkeypatch.setattr(B, "cut_lineage", lambda df: carried.append(df.count()) or cut(df))
    got = {(r.pr_id, r.g, r.o) for r in B.budget_break(rows, budgets, ["g"], ["o"]).collect()}
    assert got == {(1, 0, 0), (1, 0, 1), (1, 1, 0)}
    assert carried[0] == 3 + 1 + 2


@pytest.mark.parametrize("cell", [1, 7, 20_000])
def test_budget_break_against_a_scan(spark, cell):
    """Cells of one group, of a few, and whole changes; free rows, groups that take nothing, budgets that run out in the middle."""
    rnd = random.Random(cell)
    rows, budgets, want = [], [], set()
    for pr in range(12):
        budget = rnd.choice([0, 5, 40, 200])
        budgets.append((pr, budget))
        rest, stop = budget, False
        for g in range(rnd.randrange(1, 40)):
            fits = True
            for o in range(rnd.randrange(1, 6)):
                t = rnd.choice([0, 1, 3, 3, 17, 60])
                rows.append((pr, g, o, t))
                fits = fits and not stop and t <= rest
                if fits:
                    want.add((pr, g, o))
                    rest -= t
            stop = stop or rest <= 0
    rows = spark.createDataFrame(rows, "pr_id long, g long, o long, tokens long")
    got = B.budget_break(rows, spark.createDataFrame(budgets, "pr_id long, budget long"), ["g"], ["o"], cell)
    assert {(r.pr_id, r.g, r.o) for r in got.collect()} == want


def test_budget_break_of_one_change_with_very_many_groups(spark):
    rows = spark.range(120_000).selectExpr("1L AS pr_id", "id div 3 AS g", "id AS o", "id % 5 AS tokens")
    got = B.budget_break(rows, spark.createDataFrame([(1, 3000)], "pr_id long, budget long"), ["g"], ["o"])
    used, last = 0, 0
    for g in range(40_000):
        for k in range(3):
            t = (3 * g + k) % 5
            if used + t > 3000:
                break
            used, last = used + t, 3 * g + k
        if used >= 3000:
            break
    got = got.agg(F.sum("tokens").alias("t"), F.max("o").alias("o")).first()
    assert (got.t, got.o) == (used, last)


def test_budget_skip_tries_later_items(spark):
    rows = spark.createDataFrame([(1, 0, 5, 10), (1, 1, 50, 10), (1, 2, 5, 10), (1, 3, 1, 10)], "pr_id long, ord int, tokens long, budget long")
    assert sorted(r.ord for r in B.budget_skip(rows).collect()) == [0, 2]


def test_running_total_of_one_hot_key(spark):
    df = spark.range(20000).select(F.lit("k").alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = B.running_total(df, ["k"], ["o"], "v").orderBy("o").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.cum == total


def test_resolution_cascade(spark):
    n = nodes(spark, [(1, "a.py", "main", 1, 9, ""), (2, "a.py", "own", 10, 12, ""), (3, "lib/u.py", "helper", 1, 2, ""), (4, "x.py", "helper", 1, 2, ""),
                      (5, "x.py", "only", 3, 4, ""), (6, "x.py", "own", 5, 6, "")])
    imports = spark.createDataFrame([("a.py", "helper", "lib/u.py"), ("a.py", "u", "lib/u.py")], "file string, name string, source_file string").withColumn("repo", F.lit("r"))
    calls = spark.createDataFrame([(1, "own", "own"), (1, "self.own", "own"), (1, "helper", "helper"), (1, "u.helper", "helper"), (1, "only", "only"),
                                   (1, "z.only", "only"), (1, "nope", "nope"), (4, "q.helper", "helper")], "caller_id long, callee_name string, callee_short_name string")
    got = {(r.caller_id, r.callee_name): (r.callee_id, r.resolution) for r in G.resolve_calls(calls, n, imports).collect()}
    assert got == {(1, "own"): (2, "in_file"), (1, "self.own"): (2, "in_file"), (1, "helper"): (3, "import"), (1, "u.helper"): (3, "prefix"),
                   (1, "only"): (5, "unique"), (1, "z.only"): (5, "unique_short"), (1, "nope"): (None, None), (4, "q.helper"): (4, "in_file")}


def test_ranges_of_any_length_cost_no_more_than_the_lines_there_are(spark):
    n = nodes(spark, [(1, "f", "all", 1, 2_000_000_000, ""), (2, "f", "none", 500, 600, "")]).withColumn("pr_id", F.lit(1).cast("long"))
    added = spark.createDataFrame([(1, "f", 3), (1, "f", 1_999_999_999)], "pr_id long, file string, new_line int")
    assert [r.id for r in G.changed_nodes(added, n).collect()] == [1]


def test_two_repositories_never_meet(spark):
    n = spark.createDataFrame(
        [("p", 1, "src/a.py", "main"), ("p", 2, "src/a.py", "own"), ("q", 3, "src/a.py", "own"), ("q", 4, "src/a.py", "main"), ("q", 5, "src/u.py", "far")],
        "repo string, id long, file string, name string").withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2)).withColumn("code", F.lit(""))
    imports = spark.createDataFrame([("q", "src/a.py", "far", "src/u.py")], "repo string, file string, name string, source_file string")
    calls = spark.createDataFrame([(1, "own", "own"), (4, "own", "own"), (1, "far", "far"), (4, "far", "far")], "caller_id long, callee_name string, callee_short_name string")
    got = {(r.repo, r.caller_id, r.callee_name): (r.callee_id, r.resolution) for r in G.resolve_calls(calls, n, imports).collect()}
    assert got == {("p", 1, "own"): (2, "in_file"), ("q", 4, "own"): (3, "in_file"), ("p", 1, "far"): (None, None), ("q", 4, "far"): (5, "import")}
    seeds = G.changed_seed(spark.createDataFrame([(9, 1)], "pr_id long, id long"), spark.createDataFrame([(9, "p", "own"), (9, "p", "main")], "pr_id long, repo string, name string"), n)
    assert {(r.id, r.from_diff_line) for r in seeds.collect()} == {(1, True), (2, False)}


def test_range_join_over_bucket_borders(spark):
    n = nodes(spark, [(i, "f", f"n{i}", i * 30 + 1, i * 30 + 60, "") for i in range(40)]).withColumn("pr_id", F.lit(1).cast("long"))
    added = spark.createDataFrame([(1, "f", x) for x in (1, 64, 65, 128, 700, 5000)], "pr_id long, file string, new_line int")
    want = {i for i in range(40) if any(i * 30 + 1 <= x <= i * 30 + 60 for x in (1, 64, 65, 128, 700, 5000))}
    assert {r.id for r in G.changed_nodes(added, n).collect()} == want


PY = """import os
from .util import helper as h, other

class A:
    def one(
        self,
    ):
        x = helper(1)

        return x.go(2)

    async def two(self):
        def inner(y):
            return other(y)
        return inner(3)

def last(): return one()
"""


def test_python_functions_calls_and_imports(spark):
    files = spark.createDataFrame([("r", "pkg/a.py", PY)], "repo string, file string, content string")
    fns = CD.functions(files)
    assert {(r.name, r.start_line, r.end_line) for r in fns.collect()} == {("one", 5, 10), ("two", 12, 15), ("inner", 13, 14), ("last", 17, 17)}
    assert {(r.caller_name, r.callee_name) for r in CD.calls(files, fns).collect()} == {
        ("one", "helper"), ("one", "x.go"), ("inner", "other"), ("two", "inner"), ("last", "one")}
    assert {(r.name, r.source_file) for r in N.py_imports(files, ["repo", "file"]).collect()} == {
        ("os", "os.py"), ("h", "pkg/util.py"), ("other", "pkg/util.py")}


JS = """import D, { a as b, type T } from './lib';
export * from './x';
export { p as q, r };
export async function run(x) {
  if (x) { go(x); }
}
class K {
  async handle(y) {
    return y.map(z => z + 1);
  }
}
"""


def test_strings_and_comments_do_not_end_functions(spark):
    py = 'def a(x):\n    s = """\nat column 0 }\ndef fake(y):\n"""\n    # note (call())\n# note at column 0\n    return b(x, "c(1)")\n\ndef d():\n    return \'\'\'x\ny\'\'\'\n'
    ts = "function e(a) {\n  const s = \"}\";\n  // } g()\n  /* {\n } */\n  const t = `}\n${h}`;\n  return i(a);\n}\nfunction j() { return '{'; }\n"
    files = spark.createDataFrame([("r", "a.py", py), ("r", "a.ts", ts)], "repo string, file string, content string")
    fns = CD.functions(files)
    assert {(r.name, r.start_line, r.end_line) for r in fns.collect()} == {("a", 1, 8), ("d", 10, 12), ("e", 1, 9), ("j", 10, 10)}
    assert {(r.caller_name, r.callee_name) for r in CD.calls(files, fns).collect()} == {("a", "b"), ("e", "i")}
    assert next(r.code for r in fns.collect() if r.name == "e").startswith('function e(a) {\n  const s = "}";')


def test_next_at_most_against_a_scan():
    rnd = random.Random(5)
    for n in (1, 2, 9, 200):
        levels = np.array([rnd.randrange(-4, 6) for _ in range(n)])
        rows = np.array(sorted(rnd.sample(range(n), rnd.randrange(0, n + 1))), dtype=int)
        limits = np.array([rnd.randrange(-5, 6) for _ in rows], dtype=int)
        want = [next((j for j in range(r + 1, n) if levels[j] <= m), n) for r, m in zip(rows, limits)]
        assert CD.next_at_most(levels, rows, limits).tolist() == want


def test_extents_and_owners_against_a_scan(spark):
    """Random indents, braces that never close or close too often, names that repeat, rows in no function, missing contents."""
    rnd = random.Random(11)
    py, js = [], []
    for f in range(25):
        py.append((f"{f}.py", [" " * rnd.randrange(0, 4) + rnd.choice([f"def f{rnd.randrange(6)}(x):", "g(1)", "", ")", "y = 2"]) for _ in range(rnd.randrange(1, 40))]))
        js.append((f"{f}.ts", [rnd.choice([f"function f{rnd.randrange(6)}(a) {{", "}", "h(2);", "", "if (x) {", "} }", "k.m(() => 1)"]) for _ in range(rnd.randrange(1, 40))]))
    want = set()
    for file, rows in py:
        for i, r in enumerate(rows):
            if r.strip().startswith("def "):
                ind = len(r) - len(r.lstrip())
                stop = next((j for j in range(i + 1, len(rows)) if rows[j].strip() not in ("", ")") and len(rows[j]) - len(rows[j].lstrip()) <= ind), len(rows))
                name = r.split("(")[0].split()[-1]
                want = {w for w in want if w[:2] != (file, name)} | {(file, name, i + 1, 1 + max(j for j in range(i, stop) if rows[j].strip()))}
    for file, rows in js:
        delta = [r.count("{") - r.count("}") for r in rows]
        for i, r in enumerate(rows):
            name = r.split("(")[0].split()[-1] if r.startswith("function") else "<anonymous>" if "=>" in r else None
            if name:
                before = sum(delta[:i])
                end = next((j for j in range(i + 1, len(rows)) if sum(delta[: j + 1]) <= before), len(rows) - 1) if delta[i] > 0 else i
                want = {w for w in want if w[:2] != (file, name)} | {(file, name, i + 1, end + 1)}
    files = spark.createDataFrame([("r", f, "\n".join(rows)) for f, rows in py + js] + [("r", "none.py", None), ("r", "notes.md", "def f(x):")],
                                  "repo string, file string, content string")
    nodes = CD.functions(files)
    assert {(r.file, r.name, r.start_line, r.end_line) for r in nodes.collect()} == want
    made = {"g": "g", "h": "h", "k.m": "m"}
    expected = set()
    for file, rows in py + js:
        for i, r in enumerate(rows, 1):
            around = [w for w in want if w[0] == file and w[2] <= i <= w[3]]
            for call, short in made.items():
                if around and r.strip().startswith(call + "("):
                    expected.add((file, max(around, key=lambda w: w[2])[1], call, short, i))
    got = CD.calls(files, nodes).collect()
    assert {(r.file, r.caller_name, r.callee_name, r.callee_short_name, r.line) for r in got} == expected and len(got) == len(expected)


def test_a_large_source_file_is_one_pass(spark):
    """20,000 rows and 5,000 functions of one file, none of whose braces close: no row meets every function."""
    text = "\n".join(f"function f{i}(a) {{\n g{i}();\n\n" for i in range(5_000))
    files = spark.createDataFrame([("r", "a.ts", text), ("r", "a.py", "\n".join(f"def p{i}(a):\n    q{i}(a)\n\n" for i in range(5_000)))], "repo string, file string, content string")
    nodes = CD.functions(files)
    assert nodes.groupBy("file").agg(F.count("*").alias("n"), F.min("end_line").alias("e")).orderBy("file").collect() == [("a.py", 5_000, 2), ("a.ts", 5_000, 20_000)]
    own = CD.calls(files, nodes).where("substring(caller_name, 2) = substring(callee_name, 2)")
    assert own.count() == 10_000
    assert "Exchange" not in nodes._jdf.queryExecution().executedPlan().toString()


def test_js_functions_exports_and_imports(spark):
    files = spark.createDataFrame([("r", "s/a.ts", JS), ("r", "s/lib/index.ts", ""), ("r", "t/b.ts", "import { m } from '../../out'")], "repo string, file string, content string")
    fns = {(r.name, r.start_line, r.end_line) for r in CD.functions(files.where("file = 's/a.ts'")).collect()}
    assert {("run", 4, 6), ("handle", 8, 10), ("<anonymous>", 9, 9)} == fns
    exp = N.js_exports(files.where("file = 's/a.ts'"), ["repo", "file"]).collect()
    assert {r.symbol for r in exp} == {"q", "r", "run"} and all(r.has_star for r in exp)
    assert {(r.name, r.source_file) for r in N.ts_imports(files, ["repo", "file"]).collect()} == {
        ("D", "s/lib/index.ts"), ("b", "s/lib/index.ts"), ("T", "s/lib/index.ts")}


def test_import_checks(spark):
    refs = spark.createDataFrame(
        [("r", 1, "src/a.ts", 1, m, "s") for m in ("./b", "../../x", "./none", "@/b", "react", "@s/p/q", "left")] + [("q", 2, "a.ts", 1, "react", "s"), ("q", 2, "a.ts", 1, "@/b", "s")],
        "repo string, pr_id long, file string, line int, module string, statement string")
    manifests = spark.createDataFrame([("r", '{"dependencies":{"react":"1"},"devDependencies":{"@s/p":"1"}}')], "repo string, content string")
    configs = spark.createDataFrame([("r", "tsconfig.json", '{"compilerOptions":{"baseUrl":".","paths":{"@/*":["src/*"]}}}')], "repo string, path string, content string")
    files = spark.createDataFrame([("r", "src/b.tsx"), ("r", "src/a.ts")], "repo string, file string")
    got = {(r.repo, r.module): (r.status, r.detail) for r in CK.import_checks(
        refs, N.dependencies(manifests, ["repo"]), manifests, N.alias_rules(configs, ["repo"]), files).collect()}
    assert got == {
        ("r", "./b"): ("pass", "src/b.tsx"), ("r", "../../x"): ("unknown", "relative import resolves outside repository"),
        ("r", "./none"): ("fail", "./none not found from src/a.ts"), ("r", "@/b"): ("pass", "src/b.tsx"), ("r", "react"): ("pass", "dependencies"),
        ("r", "@s/p/q"): ("pass", "devDependencies"), ("r", "left"): ("fail", "left not declared in package.json"),
        ("q", "react"): ("unknown", "package.json not found"), ("q", "@/b"): ("unknown", "path alias for @/b is not configured")}


def test_export_star_is_unknown(spark):
    syms = spark.createDataFrame([("r", 1, "a.ts", 1, "./x", s, "named", "st") for s in ("q", "zz")],
                                 "repo string, pr_id long, file string, line int, module string, symbol string, import_kind string, statement string")
    files = spark.createDataFrame([("r", "x.ts", JS)], "repo string, file string, content string")
    rules = N.alias_rules(spark.createDataFrame([], "repo string, path string, content string"), ["repo"])
    got = {r.symbol: r.status for r in CK.export_checks(syms, N.js_exports(files, ["repo", "file"]), rules, files).collect()}
    assert got == {"q": "pass", "zz": "unknown"}


def test_call_site(spark):
    code = "def f(user=None):\n" + "    pad = 1\n" * 60 + "    go(user)\n" + "    tail = 2\n" * 30
    r = spark.createDataFrame([(code, "go"), ("short", "go"), ("x" * 700, "go")], "c string, n string").select(G.call_site(F.col("c"), F.col("n")).alias("s")).collect()
    assert r[0].s.splitlines()[0] == "def f(user=None):" and r[0].s.count("tail") == 5 and r[1].s == "short" and len(r[2].s) == 600


def test_unsafe_sinks(spark):
    rows = [("+def f(a):\n+    return cache[a]", True), ("+def f(a):\n+    if a is None:\n+        return\n+    return cache[a]", False), (" old[x]\n-gone[x]", False), ("+x = 1", False)]
    got = spark.createDataFrame([(c,) for c, _ in rows], "c string").select(G.unsafe_sink(F.col("c")).alias("u")).collect()
    assert [r.u for r in got] == [w for _, w in rows]


def _random_graph(spark, rnd):
    n, tokens = 40, {}
    rows = []
    for i in range(n):
        tokens[i] = rnd.choice([0, 1, 3, 10])
        rows.append((i, f"f{i % 5}.py", f"fn{i}", rnd.randrange(1, 30), "x" * 4 * tokens[i]))
    frame = spark.createDataFrame(rows, "id long, file string, name string, start_line int, code string")
    edges = sorted({(rnd.randrange(n), rnd.randrange(8 if rnd.random() < 0.7 else n)) for _ in range(160)})
    place = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[3], r[2], r[0])))}
    return frame, edges, place, tokens


def _walk(root, edges, place, depth):
    """Callers as a queue meets them: (id, depth)."""
    out, seen, level = [], {root}, [root]
    for d in range(1, depth + 1):
        nxt = []
        for at in level:
            for c in sorted({a for a, b in edges if b == at}, key=place.get):
                if c not in seen:
                    seen.add(c)
                    nxt.append(c)
                    out.append((c, d))
        level = nxt
    return out


def test_blast_radius_against_a_scan_meets_no_more_callers_than_fit(spark, monkeypatch):
    """of a root only callers within the largest budget, and one more, go to the changes that share it."""
    rnd = random.Random(5)
    frame, edges, place, tokens = _random_graph(spark, rnd)
    e = spark.createDataFrame(edges, "caller_id long, callee_id long")
    budgets = {pr: rnd.choice([0, 4, 12, 30]) for pr in range(20)}
    seeds = [(pr, i, f"f{i % 5}.py", f"fn{i}", 1, True) for pr in budgets for i in rnd.sample(range(10), 4)]
    s = spark.createDataFrame(seeds, "pr_id long, id long, file string, name string, start_line int, from_diff_line boolean")
    b = spark.createDataFrame(list(budgets.items()), "pr_id long, budget long")
    met, kept = [], B.budget_break
    monkeypatch.setattr(G, "budget_break", lambda rows, *a, **k: met.append(rows.count()) or kept(rows, *a, **k))
    got = {(r.pr_id, r.root, r.caller_id, r.depth) for r in G.blast_radius(s, e, frame, b).collect()}
    want, most = set(), 0
    widest = {i: max(budgets[p] for p, k, *_ in seeds if k == i) for _, i, *_ in seeds}
    for pr, budget in budgets.items():
        rest = budget
        for k, (_, root, *_) in enumerate(sorted((x for x in seeds if x[0] == pr), key=lambda x: (x[2], x[4], x[3], x[1]))):
            cum, full = 0, k > 0 and rest <= 0
            for c, d in _walk(root, edges, place, 2):
                most += cum <= widest[root]
                cum += tokens[c]
                if not full and tokens[c] <= rest:
                    rest -= tokens[c]
                    want.add((pr, root, c, d))
                else:
                    full = True
    assert got == want
    assert met == [most]


def test_bfs_reads_edges_again_only_where_a_root_has_room(spark, monkeypatch):
    """roots that are full after their own callers end the walk; steps of groups are made once."""
    frame, edges, place, tokens = _random_graph(spark, random.Random(11))
    e = spark.createDataFrame(edges, "caller_id long, callee_id long")
    sized = frame.select("id", "file", "start_line", "name", F.floor(F.length("code") / 4).cast("bigint").alias("tokens"))
    seeds = spark.createDataFrame([(i,) for i in range(10)], "id long")
    for most, hops in ((0, 1), (10**6, 2)):
        room = spark.createDataFrame([(i, most) for i in range(10)], "root long, room long")
        df = G.bfs_callers(seeds, e, sized, 2, room)
        assert df.select("depth").distinct().count() == hops
        assert ("Union" in df._jdf.queryExecution().optimizedPlan().toString()) == (hops == 2)
    written, cut = [], B.cut_lineage
    monkeypatch.setattr(B, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    rows = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 0, 2)], "pr_id long, g int, o int, tokens long")
    assert B.budget_break(rows, spark.createDataFrame([(1, 5)], "pr_id long, budget long"), ["g"], ["o"]).count() == 1
    assert ["pr_id", "g", "budget", "steps"] in written


def test_called_nodes_are_where_edges_end(spark, sf):
    """nodes that are called come without a comparison of all edges."""
    from patchlight.sources import carriers as K

    want = {r.callee_id for r in K.edges(spark, sf).select("callee_id").distinct().collect()}
    assert {r.id for r in K.called(spark, sf).collect()} == want
    assert K.called(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_calls_are_compared_once_in_tasks_of_bounded_size(spark, sf, monkeypatch):
    """calls are those of pairs compared one by one; they are dealt by caller to more tasks when there are more, and moved once."""
    from patchlight.sources import carriers as K

    monkeypatch.setattr(K, "call_tasks", lambda *a, f=K.call_tasks: f(*a, per=500))
    pairs = K.table(spark, sf, "lineitem").where("l_partkey <> l_suppkey").selectExpr("l_partkey AS c", "l_suppkey * 3 + l_linenumber AS t").distinct().collect()
    name = {r.id: r.name for r in K.nodes(spark, sf).select("id", "name").collect()}
    want = set()
    for c, t in pairs:
        if t in name:
            n = name[t]
            want.add((c, *[(n, n), (f"mod{t % 3}.{n}", n), (f"self.{n}", n), (f"{n}_q", f"{n}_q")][(c + t) % 4]))
    calls = K.raw_calls(spark, sf)
    got = [tuple(r) for r in calls.collect()]
    assert set(got) == want and len(got) == len(want)
    assert calls.rdd.getNumPartitions() == K.call_tasks(spark, sf) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes, imports = K.nodes(spark, sf), K.imports(spark, sf)
    one = G.resolve_calls(calls, nodes, imports)
    own = calls.join(nodes.select(F.col("id").alias("caller_id"), "repo", "file"), "caller_id")
    many = G.resolve_calls(own, nodes, imports, 9)
    assert many.exceptAll(one).isEmpty() and one.exceptAll(many).isEmpty()


@pytest.mark.parametrize("size, meet", [(8192, 131072), (2, 3)])
def test_callers_within_meets_what_a_queue_meets(spark, size, meet):
    """lists of callers, whole and in cells, roots in one group and in many."""
    frame, edges, place, _ = _random_graph(spark, random.Random(7))
    e = spark.createDataFrame([*edges, (3, None), (99, 1)], "caller_id long, callee_id long")
    seeds = spark.createDataFrame([(i,) for i in range(12)], "id long")
    for depth in (1, 2, 3):
        got = sorted((r.root, r.id, r.depth) for r in G.callers_within(seeds, e, frame, depth, size, meet).collect())
        assert got == sorted((i, c, d) for i in range(12) for c, d in _walk(i, edges, place, depth))


def _diff_reads(df):
    """Times that a plan reads documents to make diffs of them."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("documents.parquet") + df._jdf.queryExecution().optimizedPlan().toString().count("Relation [doc_id")


def test_lines_are_split_once_where_they_are_read_several_times(spark, sf):
    """F3, F5, F8, F10: callers, import checks and scanner hits write the lines they share; files of a change come without its texts."""
    from patchlight.catalog import q_checks, q_graph
    from patchlight.sources import carriers as K

    assert _diff_reads(q_graph.diff_groups(spark, sf)) == 0
    scan = q_checks.scan_hits(spark, sf)
    assert "split(" not in scan._jdf.queryExecution().optimizedPlan().toString().replace("split(text", "")
    files = K.prs(spark, sf, True).select("pr_id", F.size("files"))
    assert "section" not in files._jdf.queryExecution().optimizedPlan().toString()
