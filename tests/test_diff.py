from pyspark.sql import functions as F

from patchlight.operators import diff as D

SAMPLE = """diff --git a/lib/store.ts b/lib/store.ts
--- a/lib/store.ts
+++ b/lib/store.ts
@@ -3,4 +3,5 @@ class Store {
   open() {
-    this.n = 0;
+    this.n = 1;
+    this.log();
   }
   close() {}
@@ -20,2 +21,3 @@ function load() {
   return read(
+    path,
   );
diff --git a/docs/notes.md b/docs/notes.md
--- a/docs/notes.md
+++ b/docs/notes.md
@@ -0,0 +1,2 @@
+# Notes
+Nothing yet.
"""


def frame(spark, *diffs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(diffs)], "pr_id long, diff string")


def python_lines(diff):
    """Row-by-row model of the line rules, for diffs whose headers are plain."""
    out, file, new, lenient, pos, inside = [], None, 0, 0, 0, False
    rows = diff.split("\n")
    if rows and rows[-1] == "":
        rows = rows[:-1]
    for i, x in enumerate(rows):
        if x.startswith("diff --git "):
            file, inside = None, False
        elif x.startswith("+++ b/"):
            file, pos, inside = x[6:], 0, False
        elif x.startswith("@@") and file:
            new = lenient = int(x.split("+")[1].split(",")[0].split(" ")[0]) - 1
            pos, inside = pos + 1, True
        elif file and inside:
            if x[:1] in "+ " and x:
                new, lenient, pos = new + 1, lenient + 1, pos + 1
                out.append((i, file, "add" if x[0] == "+" else "ctx", new, lenient, pos, x[1:]))
            elif x[:1] == "-":
                pos += 1
                out.append((i, file, "del", None, None, pos, x[1:]))
            else:
                lenient += 1
                out.append((i, file, "meta", None, lenient, None, x))
    return out


def spark_lines(df):
    rows = D.diff_lines(df).where("kind <> 'hunk' and file is not null").orderBy("pr_id", "pos").collect()
    return [(r.pr_id, r.pos, r.file, r.kind, r.new_line, r.new_line_lenient, r.position, r.text) for r in rows]


def test_lines_match_a_row_by_row_model(spark):
    odd = SAMPLE.replace("+    z = 3\n", "\n+    z = 3\n-    gone\n\\ No newline at end of file\n+--- still content\n")
    want = [(p, *r) for p, d in enumerate((SAMPLE, odd)) for r in python_lines(d)]
    assert spark_lines(frame(spark, SAMPLE, odd)) == want


def test_deleted_file_adds_nothing_to_its_neighbour(spark):
    d = SAMPLE + "diff --git a/z.py b/z.py\n--- a/z.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n"
    assert D.position_map(D.diff_lines(frame(spark, d))).count() == 5


def test_removed_sql_comment_is_content(spark):
    d = "+++ b/q.sql\n@@ -1,2 +1,1 @@\n--- old comment\n kept\n"
    rows = [(r.kind, r.text) for r in D.diff_lines(frame(spark, d)).where("kind <> 'hunk'").orderBy("pos").collect()]
    assert rows == [("del", "-- old comment"), ("ctx", "kept")]


def test_rows_that_a_hunk_owes_are_content(spark):
    """A removed "-- x" directly before an added "++ y" or "++ b/y" looks like a file header."""
    d = ("--- a/q.sql\n+++ b/q.sql\n@@ -1,3 +1,4 @@\n--- old comment\n+++ new text\n+++ b/looks like a path\n a\n b\n"
         "--- a/z.sql\n+++ b/z.sql\n@@ -5 +5 @@\n--- x\n+++ y\n--- a/gone.sql\n+++ /dev/null\n@@ -1,2 +0,0 @@\n--- p\n-q\n\\ No newline at end of file")
    rows = [(r.file, r.kind, r.new_line, r.text) for r in D.diff_lines(frame(spark, d)).where("kind not in ('hunk', 'meta')").orderBy("pos").collect()]
    assert rows == [
        ("q.sql", "del", None, "-- old comment"), ("q.sql", "add", 1, "++ new text"), ("q.sql", "add", 2, "++ b/looks like a path"), ("q.sql", "ctx", 3, "a"),
        ("q.sql", "ctx", 4, "b"), ("z.sql", "del", None, "-- x"), ("z.sql", "add", 5, "++ y"), (None, "del", None, "-- p"), (None, "del", None, "q")]


def test_position_counts_headers_and_runs_over_hunks(spark):
    got = {(r.file, r.new_line): r.position for r in D.position_map(D.diff_lines(frame(spark, SAMPLE))).collect()}
    assert got == {("lib/store.ts", 4): 4, ("lib/store.ts", 5): 5, ("lib/store.ts", 22): 10, ("docs/notes.md", 1): 2, ("docs/notes.md", 2): 3}


def test_added_lines_without_any_header(spark):
    rows = D.added_lines(D.diff_lines(frame(spark, "@@ -0,0 +1 @@\n+a\n+b", SAMPLE))).groupBy("pr_id").count().collect()
    assert {r.pr_id: r["count"] for r in rows} == {0: 2, 1: 5}


def test_hunk_ranges(spark):
    got = {(r.file, r.hunk, r.start_line, r.end_line) for r in D.hunk_ranges(frame(spark, SAMPLE, "+++ b/o.py\n@@ -0,0 +5 @@\n+x")).collect()}
    assert got == {("lib/store.ts", 0, 3, 7), ("lib/store.ts", 1, 21, 23), ("docs/notes.md", 0, 1, 2), ("o.py", 0, 5, 5)}


def test_empty_and_null_diffs_give_no_lines(spark):
    assert D.diff_lines(frame(spark, "", None)).where("kind <> 'meta'").count() == 0


def test_later_chunk_of_a_name_wins(spark):
    d = "diff --git a/a b/a\n+++ b/a\n@@ -1 +1 @@\n+one\ndiff --git a/b b/b\n+++ b/b\n@@ -1 +1 @@\n+x\ndiff --git a/a b/a\n+++ b/a\n@@ -1 +1 @@\n+two"
    got = {r.file: (r.part, r.chunk[-3:]) for r in D.split_files(frame(spark, d)).collect()}
    assert got == {"a": (0, "two"), "b": (1, "\n+x"[-3:])}


def kind(spark, rows):
    df = spark.createDataFrame([(rows,)], "rows array<string>")
    return df.select(D.classify_hunk(F.col("rows")).alias("k")).first().k


def test_hunk_kinds(spark):
    assert kind(spark, ["@@", " a"]) == "mechanical"
    assert kind(spark, ["-x = 1", "+  x = 1 "]) == "mechanical"
    assert kind(spark, ["+import os", "+from a import b"]) == "mechanical"
    assert kind(spark, ["+import os", "-x = 1"]) == "logical"
    assert kind(spark, ["-foo(a)", "+bar(b)"]) == "mechanical"
    assert kind(spark, ["-foo(a)", "+bar(b, c)"]) == "logical"
    assert kind(spark, ["-gone"]) == "logical"


def test_chunks_hold_whole_hunks_with_the_header(spark):
    hunk = "@@ -1,1 +1,1 @@\n+" + "x" * 50
    files = spark.createDataFrame([(1, "f", "head\n" + "\n".join([hunk] * 5))], "pr_id long, file string, chunk string")
    rows = [r.chunk for r in D.chunk_files(files, 150).orderBy("chunk_no").collect()]
    assert [c.count("@@ -1") for c in rows] == [2, 2, 1] and all(c.startswith("head\n@@") for c in rows)


def test_patch_convert(spark):
    p = "## file: 'a/b.py'\n@@ -1,2 +1,3 @@\n__new hunk__\n10  ctx\n11 +added\nloose"
    got = spark.createDataFrame([(p,)], "p string").select(D.patch_convert(F.col("p")).alias("d")).first().d
    assert got == "--- a/a/b.py\n+++ b/a/b.py\n@@ -1,2 +1,3 @@\n ctx\n+added\nloose\n"


def test_routes(spark):
    df = spark.createDataFrame([("x" * 40000, ["a"]), ("x", ["a"] * 31), ("x", ["a"])], "d string, f array<string>")
    assert [r.m for r in df.select(D.route(F.col("d"), F.col("f")).alias("m")).collect()] == ["per_file", "multi", "single"]


def test_read_order(spark):
    d = "--- a\n+++ b\n@@ -1 +1 @@\n ctx\n-x\n+y"
    got = spark.createDataFrame([(d,)], "diff string").select(D.read_order("diff").alias("p")).first().p
    assert got == [5, 6, 1, 2, 3, 4]


def test_line_relation_needs_no_shuffle(spark):
    plan = D.diff_lines(frame(spark, SAMPLE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
