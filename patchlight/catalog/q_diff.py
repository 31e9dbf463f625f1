"""Diff queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlight.catalog import ctes as T
from patchlight.catalog.base import CTES, query
from patchlight.functions import columns as X
from patchlight.operators import diff as D
from patchlight.sources import carriers as K

CTES["c_hunks"] = """SELECT pr_id, file, hunk, string_agg(CASE kind WHEN 'hunk' THEN text WHEN 'add' THEN '+' || text
 WHEN 'del' THEN '-' || text ELSE ' ' || text END, chr(10) ORDER BY pos) AS body FROM c_lines GROUP BY 1, 2, 3"""
CTES["c_chunks"] = "SELECT pr_id, file, row_number() OVER (PARTITION BY pr_id ORDER BY doc_id) - 1 AS part, section AS chunk FROM c_sec"
CTES["c_kinds"] = r"""SELECT pr_id, file, hunk, body,
 CASE WHEN len(a) = 0 AND len(r) = 0 THEN 'mechanical'
  WHEN len(a) > 0 AND len(r) > 0 AND list_transform(a, lambda x: trim(x, e' \t\r\n\f\v')) = list_transform(r, lambda x: trim(x, e' \t\r\n\f\v')) THEN 'mechanical'
  WHEN len(a) > 0 AND len(list_filter(a, lambda x: NOT regexp_matches(x, '^\s*(import |from .+ import |require\(|const .+ = require)'))) = 0
   AND len(list_filter(r, lambda x: NOT regexp_matches(x, '^\s*(import |from .+ import |require\(|const .+ = require)'))) = 0 THEN 'mechanical'
  WHEN len(a) > 0 AND len(r) > 0 AND list_transform(a, lambda x: regexp_replace(trim(x, e' \t\r\n\f\v'), '[a-zA-Z_]\w*', '_', 'g'))
   = list_transform(r, lambda x: regexp_replace(trim(x, e' \t\r\n\f\v'), '[a-zA-Z_]\w*', '_', 'g')) THEN 'mechanical' ELSE 'logical' END AS hunk_kind
FROM (SELECT *, list_transform(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: substr(x, 2)) AS a,
 list_transform(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')), lambda x: substr(x, 2)) AS r FROM {src})"""
CTES["c_chunkinds"] = CTES["c_kinds"].replace("{src}", "c_chunks_h")
CTES["c_kinds"] = CTES["c_kinds"].replace("{src}", "c_hunks")
CTES["c_chunks_h"] = CTES["c_hunks"].replace("c_lines", "c_clines")


def lines_of(spark, sf, code=False):
    return D.diff_lines(K.prs(spark, sf, code).select("pr_id", "diff"))


@query("diff_lines", "SELECT pr_id, file, hunk, pos, kind, new_line, position, text FROM c_lines")
def _(spark, sf):
    return lines_of(spark, sf).where(F.col("file").isNotNull()).select(
        "pr_id", "file", "hunk", F.col("pos").cast("bigint").alias("pos"), "kind", "new_line", "position", "text"
    )


@query("diff_position_map", "SELECT pr_id, file, new_line, position FROM c_lines WHERE kind = 'add'")
def _(spark, sf):
    return D.position_map(lines_of(spark, sf))


@query("diff_added_lines", "SELECT pr_id, file, pos, text FROM c_lines WHERE kind = 'add'")
def _(spark, sf):
    return D.added_lines(lines_of(spark, sf)).select("pr_id", "file", F.col("pos").cast("bigint").alias("pos"), "text")


@query("diff_visible_lines", "SELECT DISTINCT pr_id, file, new_line FROM c_lines WHERE kind IN ('add', 'ctx')")
def _(spark, sf):
    return D.visible_lines(lines_of(spark, sf))


@query("diff_added_numbered", r"""SELECT pr_id, file, (hstart + n)::INT AS line, raw AS text FROM (
 SELECT *, count(*) FILTER (kind NOT IN ('hunk', 'del')) OVER (PARTITION BY pr_id, sec, hunk ORDER BY pos) - 1 AS n,
  first_value(CASE WHEN kind = 'hunk' THEN regexp_extract(raw, '\+([0-9]+)', 1)::INT END) OVER (PARTITION BY pr_id, sec, hunk ORDER BY pos) AS hstart
 FROM (SELECT *, sum(CASE WHEN kind = 'hunk' THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id, sec ORDER BY pos) AS hunk FROM (
  SELECT pr_id, pos, raw,
   last_value(CASE WHEN starts_with(raw, '+++ b/') THEN substr(raw, 7) END IGNORE NULLS) OVER (PARTITION BY pr_id ORDER BY pos) AS file,
   sum(CASE WHEN starts_with(raw, '+++ b/src/') THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id ORDER BY pos) AS sec,
   CASE WHEN starts_with(raw, 'diff --git a/src/') OR starts_with(raw, '--- a/src/') OR starts_with(raw, '+++ b/src/') THEN 'head'
    WHEN starts_with(raw, '@@') THEN 'hunk' WHEN starts_with(raw, '+') THEN 'add' WHEN starts_with(raw, '-') THEN 'del' ELSE 'ctx' END AS kind
  FROM (SELECT pr_id, pos, ltrim(raw, e' \t') AS raw FROM c_craw)) WHERE kind <> 'head')) WHERE kind = 'add' AND NOT starts_with(raw, '+++')""")
def _(spark, sf):
    return D.added_numbered(K.prs(spark, sf, True).select("pr_id", "diff"))


@query("diff_split_files", "SELECT pr_id, file, part::INT AS part, chunk FROM c_chunks")
def _(spark, sf):
    return D.split_files(K.prs(spark, sf)).select("pr_id", "file", "part", "chunk")


@query("diff_chunk", f"""SELECT pr_id, file, chunk_no::INT AS chunk_no, chunk FROM (
WITH RECURSIVE h AS (SELECT c.pr_id, c.file, b.hunk AS i, b.body, length(b.body) AS n,
   {T._HEAD.replace(T.doc_file(), 'c.file').rstrip().removesuffix('|| chr(10)')} AS header, length(c.chunk) AS total
   FROM c_chunks c JOIN c_hunks b USING (pr_id, file)),
 p AS (SELECT pr_id, file, i, body, header, total, 0 AS chunk_no, length(header) + n AS used FROM h WHERE i = 0
  UNION ALL
  SELECT h.pr_id, h.file, h.i, h.body, h.header, h.total, CASE WHEN p.used + h.n > 4800 THEN p.chunk_no + 1 ELSE p.chunk_no END,
   CASE WHEN p.used + h.n > 4800 THEN length(h.header) + h.n ELSE p.used + h.n END
  FROM p JOIN h ON h.pr_id = p.pr_id AND h.file = p.file AND h.i = p.i + 1)
SELECT pr_id, file, CASE WHEN total <= 4800 THEN 0 ELSE chunk_no END AS chunk_no,
 any_value(header) || chr(10) || string_agg(body, chr(10) ORDER BY i) AS chunk FROM p GROUP BY ALL)""")
def _(spark, sf):
    return D.chunk_files(D.split_files(K.prs(spark, sf)).drop("part"))


@query("diff_hunk_ranges", r"""SELECT pr_id, file, hunk, s AS start_line, s + greatest(n - 1, 0) AS end_line FROM (
 SELECT pr_id, file, hunk, regexp_extract(text, '\+([0-9]+)', 1)::INT AS s,
  coalesce(nullif(regexp_extract(text, '\+[0-9]+,([0-9]+)', 1), '')::INT, 1) AS n FROM c_lines WHERE kind = 'hunk')""")
def _(spark, sf):
    return D.hunk_ranges(K.prs(spark, sf))


@query("diff_snippet", """SELECT t.pr_id, t.file, t.ord, string_agg(CASE l.kind WHEN 'hunk' THEN l.text WHEN 'add' THEN '+' || l.text
 WHEN 'del' THEN '-' || l.text ELSE ' ' || l.text END, chr(10) ORDER BY l.position) AS snippet
FROM (SELECT f.pr_id, f.file, f.ord, min(l.position) AS t FROM c_find f JOIN c_lines l ON l.pr_id = f.pr_id AND l.file = f.file
  AND l.new_line = f.line GROUP BY 1, 2, 3) t
JOIN c_lines l ON l.pr_id = t.pr_id AND l.file = t.file AND l.position BETWEEN t.t - 3 AND t.t + 3 GROUP BY 1, 2, 3""")
def _(spark, sf):
    return D.snippets(K.findings(spark, sf), lines_of(spark, sf))


@query("diff_stats", """SELECT pr_id, len(string_split(diff, chr(10) || '+')) - 1 AS additions,
 len(string_split(diff, chr(10) || '-')) - 1 AS deletions, len(files) AS files_changed, length(diff) // 4 AS est_tokens FROM c_prs""")
def _(spark, sf):
    add, rem = D.diff_stats(F.col("diff"))
    return K.prs(spark, sf).select(
        "pr_id", add.cast("bigint").alias("additions"), rem.cast("bigint").alias("deletions"),
        F.size("files").cast("bigint").alias("files_changed"), X.tokens(F.col("diff")).alias("est_tokens"))


@query("tok_usage", """SELECT pr_id, sum(tokens)::BIGINT AS total_tokens, count(*) AS call_count, sum(tokens) >= 2000 AS exceeded FROM (
 SELECT pr_id, length(section) // 4 AS tokens FROM c_sec) GROUP BY pr_id""")
def _(spark, sf):
    calls = D.split_files(K.prs(spark, sf)).select("pr_id", X.tokens(F.col("chunk")).alias("tokens"))
    return D.token_usage(calls, 2000)


@query("diff_truncate", """SELECT pr_id, file, CASE WHEN length(chunk) > 12000 THEN left(chunk, 12000) || chr(10) || '... [truncated]' ELSE chunk END AS chunk
FROM c_chunks""")
def _(spark, sf):
    return D.split_files(K.prs(spark, sf)).select("pr_id", "file", D.truncate_file(F.col("chunk")).alias("chunk"))


_SPLIT = """SELECT {keys}, piece, string_agg(x, chr(10) ORDER BY i) AS diff FROM (
WITH RECURSIVE r AS (SELECT {keys}, unnest(string_split(diff, chr(10))) AS raw, unnest(range(len(string_split(diff, chr(10))))) AS i,
   length(diff) <= {limit} AS whole FROM {src}),
 p AS (SELECT {rkeys}, r.i, r.raw, r.whole, [raw] AS header, length(raw) + 1 AS used, 0 AS piece, raw AS x FROM r WHERE i = 0
  UNION ALL
  SELECT {qkeys}, q.i, q.raw, q.whole, h, CASE WHEN cut THEN list_sum(list_transform(h, lambda t: length(t) + 1)) + n ELSE used + n END,
   CASE WHEN cut THEN piece + 1 ELSE piece END, CASE WHEN cut THEN array_to_string(list_append(h, q.raw), chr(10)) ELSE q.raw END
  FROM (SELECT {rkeys}, r.i, r.raw, r.whole, length(r.raw) + 1 AS n, p.used, p.piece, NOT r.whole AND p.used + length(r.raw) + 1 > {limit} AS cut,
    CASE WHEN starts_with(r.raw, 'diff --git') THEN [r.raw] WHEN starts_with(r.raw, '+++') OR starts_with(r.raw, '---') OR starts_with(r.raw, '@@')
     THEN list_append(p.header, r.raw) ELSE p.header END AS h
   FROM p JOIN r ON {on} AND r.i = p.i + 1) q)
SELECT * FROM p) GROUP BY ALL"""


@query("diff_token_split", _SPLIT.format(keys="pr_id", rkeys="r.pr_id", qkeys="q.pr_id", limit=2000, src="c_prs", on="r.pr_id = p.pr_id"))
def _(spark, sf):
    return D.token_split(K.prs(spark, sf).select("pr_id", "diff"), "diff", 500)


@query("diff_batches", _SPLIT.format(
    keys="pr_id, batch", rkeys="r.pr_id, r.batch", qkeys="q.pr_id, q.batch", limit=4000, on="r.pr_id = p.pr_id AND r.batch = p.batch",
    src="(SELECT pr_id, (part // 2)::INT AS batch, string_agg(chunk, chr(10) ORDER BY part) AS diff FROM c_chunks GROUP BY 1, 2)"))
def _(spark, sf):
    return D.batch_diffs(K.prs(spark, sf), 2, 1000)


@query("diff_route", """SELECT pr_id, CASE WHEN length(diff) // 4 > 8000 THEN 'per_file' WHEN len(files) > 30 OR length(diff) // 4 > 2000 THEN 'multi'
 ELSE 'single' END AS mode FROM c_prs""")
def _(spark, sf):
    return K.prs(spark, sf).select("pr_id", D.route(F.col("diff"), F.col("files"), 2000).alias("mode"))


@query("diff_read_order", """SELECT pr_id, array_to_string(list_transform(list_sort(list_transform(string_split(diff, chr(10)), lambda x, i:
  (CASE WHEN starts_with(ltrim(x), '--- ') OR starts_with(ltrim(x), '+++ ') OR starts_with(ltrim(x), '@@') THEN 1
    WHEN starts_with(x, '+') OR starts_with(x, '-') THEN 0 ELSE 1 END) * 10000000 + i))[1:15], lambda v: v % 10000000), ',') AS path FROM c_prs""")
def _(spark, sf):
    return K.prs(spark, sf).select("pr_id", F.array_join(D.read_order("diff").cast("array<string>"), ",").alias("path"))


@query("diff_patch_convert", """SELECT doc_id, array_to_string(list_transform(rows_, lambda x, i: CASE WHEN i = 1 THEN
  '--- a/' || x || chr(10) || '+++ b/' || x || chr(10) || '@@ -1,3 +1,4 @@' ELSE ' ' || x END), chr(10)) || chr(10) AS diff
FROM (SELECT doc_id, list_transform(rows_, lambda x: replace(x, '''', '’')) AS rows_ FROM c_docs)""")
def _(spark, sf):
    # A quote would end the path of the file row.
    docs = K.table(spark, sf, "documents").withColumn("rows", F.split(F.replace("text", F.lit("'"), F.lit("’")), "\n"))
    patch = F.array_join(F.transform("rows", lambda x, i: F.when(i == 0, F.concat(
        F.lit("## file: '"), x, F.lit("'\n@@ -1,3 +1,4 @@\n__new hunk__"))).otherwise(
            F.concat(i.cast("string"), F.lit("  "), x))), "\n")
    return docs.select("doc_id", D.patch_convert(patch).alias("diff"))


_PATHS = """(SELECT page_id, (['', 'vendor/', 'a/node_modules/', 'docs/', 'src/dist2/'])[(page_id % 5) + 1] || regexp_extract(url, '//([^/]+)/', 1) || '/'
 || (['test_', '', 'x_', ''])[(page_id % 4) + 1] || regexp_extract(url, '/([a-z]+)/', 1) || page_id
 || (['.py', '.test.ts', '.md', '.lock', '.tsx', '_test.py', '.json', '.css', '.spec.js'])[(page_id % 9) + 1] AS file, page_id % 6 AS pr_id FROM pages)"""


def page_paths(spark, sf):
    """File paths of many kinds, named after the pages' hosts and languages."""
    p = F.col("page_id")
    return K.table(spark, sf, "pages").select("page_id", F.concat(
        K.pick(["", "vendor/", "a/node_modules/", "docs/", "src/dist2/"], p), F.regexp_extract("url", "//([^/]+)/", 1),
        F.lit("/"), K.pick(["test_", "", "x_", ""], p), F.regexp_extract("url", "/([a-z]+)/", 1), p.cast("string"),
        K.pick([".py", ".test.ts", ".md", ".lock", ".tsx", "_test.py", ".json", ".css", ".spec.js"], p)).alias("file"),
        (p % 6).alias("pr_id"))


@query("flt_skip_file", f"SELECT file FROM {_PATHS} WHERE NOT {T.SKIP_FILE}")
def _(spark, sf):
    return page_paths(spark, sf).where(~D.skip_file(F.col("file"))).select("file")


@query("flt_large_pr", f"""SELECT pr_id, file, n > 30 AS is_large FROM (SELECT *, count(*) OVER (PARTITION BY pr_id) AS n FROM {_PATHS} WHERE NOT {T.SKIP_FILE})
WHERE NOT (n > 30 AND {T.SKIP_LARGE})""")
def _(spark, sf):
    return D.large_pr_files(page_paths(spark, sf)).select("pr_id", "file", "is_large")


@query("hunk_classify", "SELECT pr_id, file, hunk, hunk_kind FROM c_chunkinds")
def _(spark, sf):
    return D.hunk_kinds(D.split_files(K.prs(spark, sf, True))).select("pr_id", "file", "hunk", "hunk_kind")


_FILTERED = """SELECT pr_id, file, count(*) FILTER (hunk_kind = 'logical') = 0 AS skipped,
 CASE WHEN count(*) FILTER (hunk_kind = 'logical') > 0 THEN 'diff --git a/' || file || ' b/' || file || chr(10) || '--- a/' || file || chr(10)
 || '+++ b/' || file || chr(10) || string_agg(body, chr(10) ORDER BY hunk) FILTER (hunk_kind = 'logical') END AS chunk FROM c_chunkinds GROUP BY 1, 2"""


@query("hunk_filter", _FILTERED)
def _(spark, sf):
    return D.filter_mechanical(D.split_files(K.prs(spark, sf, True)).drop("part"))


@query("pr_coverage", f"""SELECT p.pr_id, p.total, coalesce(r.reviewed, 0) AS reviewed, coalesce(r.skipped_mechanical, 0) AS skipped_mechanical,
 p.total > 30 AS is_large_pr FROM (SELECT pr_id, len(files) AS total FROM c_cprs) p LEFT JOIN (SELECT pr_id, count(*) FILTER (NOT skipped) AS reviewed,
 count(*) FILTER (skipped) AS skipped_mechanical FROM ({_FILTERED}) WHERE NOT {T.SKIP_FILE} GROUP BY 1) r USING (pr_id)""")
def _(spark, sf):
    return D.coverage(D.split_files(K.prs(spark, sf, True)))
