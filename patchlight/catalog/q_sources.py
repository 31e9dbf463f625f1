"""Source queries: landed shapes derived from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.catalog import ctes as T
from patchlight.catalog.base import CTES, query
from patchlight.catalog.q_diff import page_paths
from patchlight.operators import code as CD
from patchlight.operators import diff as D
from patchlight.session import new_folder
from patchlight.sources import carriers as K
from patchlight.sources import checkouts as CO
from patchlight.sources import landed as L


@query("src_prs", """SELECT repo, pr_id AS number, file AS filename, len(list_filter(string_split(section, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++ b/'))) AS additions,
 'modified' AS status FROM c_sec JOIN c_prs USING (pr_id)""")
def _(spark, sf):
    prs = K.prs(spark, sf)
    chunks = D.split_files(prs).select(
        "pr_id", F.struct(
            F.col("file").alias("filename"),
            F.size(F.filter(F.split("chunk", "\n"), lambda x: x.startswith("+") & ~x.startswith("+++ b/"))).alias("additions"),
            F.lit(0).alias("deletions"), F.lit("modified").alias("status"), F.col("chunk").alias("patch")).alias("f"))
    detail = chunks.groupBy("pr_id").agg(F.collect_list("f").alias("files_detail"))  # four files per change
    folder = new_folder(spark, "prs")
    prs.join(detail, "pr_id").select("repo", F.col("pr_id").alias("number"), "title", "files_detail").write.option("compression", "gzip").json(folder)
    return L.pr_files(L.read_prs(spark, folder)).select("repo", "number", "filename", F.col("additions").cast("bigint").alias("additions"), "status")


@query("src_pr_meta", """SELECT pr_id, title, coalesce(author_name, 'unknown') AS author, base_branch, head_branch, commits, len(files) AS changed_files, array_to_string(files, ',') AS files FROM c_prs""")
def _(spark, sf):
    return L.pr_meta(K.prs(spark, sf))


@query("src_synthetic_ctx", """SELECT 's' || pr_id AS id, title, len(files) AS files_changed, len(string_split(diff, chr(10) || '+')) - 1 AS additions,
 len(string_split(diff, chr(10) || '-')) - 1 AS deletions, '' AS head_sha, 'feature' AS head_branch FROM c_prs WHERE pr_id % 3 <> 0""")
def _(spark, sf):
    samples = K.prs(spark, sf).select(
        F.concat(F.lit("s"), F.col("pr_id").cast("string")).alias("id"), "url", F.when(F.col("pr_id") % 3 != 0, F.col("diff")).alias("synthetic_diff"),
        F.col("files").alias("synthetic_files"), F.col("title").alias("synthetic_pr_title"), F.lit(None).cast("string").alias("synthetic_pr_description"))
    return L.synthetic_context(samples).select("id", "title", "files_changed", "additions", "deletions", "head_sha", "head_branch")


CTES["c_urls"] = r"""SELECT page_id, CASE WHEN page_id % 6 = 5 THEN url ELSE 'https://github.com/' || regexp_extract(url, '//([^./]+)', 1) || '/' || regexp_extract(url, '/([a-z]+)/', 1)
 || (['/pull/', '/pulls/', '/issues/'])[page_id % 3 + 1] || page_id || '/files' END AS url FROM pages"""


def urls(spark, sf):
    p = F.col("page_id")
    return K.table(spark, sf, "pages").select("page_id", F.when(p % 6 == 5, F.col("url")).otherwise(F.concat(
        F.lit("https://github.com/"), F.regexp_extract("url", "//([^./]+)", 1), F.lit("/"), F.regexp_extract("url", "/([a-z]+)/", 1),
        K.pick(["/pull/", "/pulls/", "/issues/"], p), p.cast("string"), F.lit("/files"))).alias("url"))


@query("src_pr_url", r"""SELECT page_id, nullif(regexp_extract(url, 'github\.com/([^/]+)/([^/]+)/pulls?/(\d+)', 1), '') AS owner,
 nullif(regexp_extract(url, 'github\.com/([^/]+)/([^/]+)/pulls?/(\d+)', 2), '') AS repo_name, nullif(regexp_extract(url, 'github\.com/([^/]+)/([^/]+)/pulls?/(\d+)', 3), '')::BIGINT AS number FROM c_urls""")
def _(spark, sf):
    return L.pr_url_parts(urls(spark, sf)).drop("url")


_DIRS = f"len(list_filter(string_split(file, '/')[:-2], lambda d: d IN {T.in_list(C.SOURCE_SKIP_DIRS)} OR starts_with(d, '.'))) = 0"


@query("src_repo_files", rf"""SELECT file, n FROM (SELECT page_id, length(html) AS n, (['', 'vendor/', 'a/node_modules/', 'docs/', 'src/dist2/'])[(page_id % 5) + 1] || regexp_extract(url, '//([^/]+)/', 1) || '/'
 || (['test_', '', 'x_', ''])[(page_id % 4) + 1] || regexp_extract(url, '/([a-z]+)/', 1) || page_id
 || (['.py', '.test.ts', '.md', '.lock', '.tsx', '_test.py', '.json', '.css', '.spec.js'])[(page_id % 9) + 1] AS file FROM pages)
WHERE {_DIRS} AND regexp_extract(string_split(file, '/')[-1], '^.+(\.[^.]+)$', 1) IN {T.in_list(list(C.LANGUAGE_OF_SUFFIX))} AND n * 200 <= {C.MAX_SOURCE_BYTES}
 AND NOT {T.any_word("string_split(file, '/')[-1]", C.SOURCE_SKIP_PATTERNS)}""")
def _(spark, sf):
    sized = page_paths(spark, sf).join(K.table(spark, sf, "pages").select("page_id", F.length("html").cast("bigint").alias("n")), "page_id")
    return sized.where(CD.reviewed_source(F.col("file"), F.col("n") * 200)).select("file", "n")


@query("src_checkout", rf"""SELECT repo, file, n AS length, sha FROM (SELECT 'org/' || regexp_extract(url, '//([^/]+)/', 1) AS repo, CASE WHEN page_id % 7 = 3 THEN 'pkg' || page_id || '/__init__.py'
 ELSE (['', 'vendor/', 'a/node_modules/', 'docs/', 'src/dist2/'])[(page_id % 5) + 1] || regexp_extract(url, '//([^/]+)/', 1) || '/' || (['test_', '', 'x_', ''])[(page_id % 4) + 1]
 || regexp_extract(url, '/([a-z]+)/', 1) || page_id || (['.py', '.test.ts', '.md', '.lock', '.tsx', '_test.py', '.json', '.css', '.spec.js'])[(page_id % 9) + 1] END AS file,
 strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS sha FROM pages)
WHERE {_DIRS} AND regexp_extract(string_split(file, '/')[-1], '^.+(\.[^.]+)$', 1) IN {T.in_list(list(C.LANGUAGE_OF_SUFFIX))} AND n <= {C.MAX_SOURCE_BYTES}
 AND NOT {T.any_word("string_split(file, '/')[-1]", C.SOURCE_SKIP_PATTERNS)}""")
def _(spark, sf):
    """Pages written as the files of one repository per host, listed, and read again."""
    p = F.col("page_id")
    pages = K.table(spark, sf, "pages").select("page_id", F.concat(F.lit("org/"), F.regexp_extract("url", "//([^/]+)/", 1)).alias("repo"), F.col("html").alias("content"))
    files = page_paths(spark, sf).select("page_id", F.when(p % 7 == 3, F.concat(F.lit("pkg"), p.cast("string"), F.lit("/__init__.py"))).otherwise(F.col("file")).alias("file"))
    root = new_folder(spark, "checkouts")
    CO.write_checkouts(pages.join(files, "page_id"), root)
    return CO.with_content(CO.list_checkouts(spark, root, levels=2), root).select("repo", "file", "length", F.sha2("content", 256).alias("sha"))


@query("src_golden", """SELECT 's' || pr_id AS sample_id, id, file, line_start, line_end, title_keywords[1] AS keyword, len(evidence_keywords) AS n_evidence, description, severity
FROM (SELECT * EXCLUDE (evidence_keywords), coalesce(evidence_keywords, []) AS evidence_keywords FROM c_exp)""")
def _(spark, sf):
    """Expected findings written as YAML lists of samples, and read again."""
    finding = F.struct("ord", "id", "file", F.when(F.col("line_start").isNotNull(), F.array("line_start", "line_end")).alias("line_range"), "title_keywords", "evidence_keywords", "description", "severity")
    samples = K.expected(spark, sf).groupBy("pr_id").agg(F.sort_array(F.collect_list(finding)).alias("expected_findings"))  # four documents per change
    folder = new_folder(spark, "golden")
    samples.select(F.concat(F.lit("- "), F.to_json(F.struct(F.concat(F.lit("s"), F.col("pr_id").cast("string")).alias("id"), "expected_findings")))).write.option("maxRecordsPerFile", 10_000).text(folder)
    return L.golden_expected(L.read_golden(spark, folder)).select(
        "sample_id", "id", "file", "line_start", "line_end", F.get("title_keywords", F.lit(0)).alias("keyword"), F.size("evidence_keywords").cast("bigint").alias("n_evidence"), "description", "severity")


@query("src_scan_results", """SELECT ord AS report, 'r.' || title AS check_id, file AS path, coalesce(line, 0) AS start_line, coalesce(line, 0) AS end_line, severity FROM c_find""")
def _(spark, sf):
    f = K.findings(spark, sf)
    body = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("r."), "title").alias("check_id"), F.col("file").alias("path"), F.struct(F.col("line").alias("line")).alias("start"),
        F.struct(F.lit(None).cast("int").alias("line")).alias("end"),
        F.struct(F.col("description").alias("message"), "severity").alias("extra"))).alias("results")))
    reports = f.select(F.col("ord").alias("report"), F.from_json(body, L.SCAN_SCHEMA)["results"].alias("results"))
    return L.scan_rows(reports).select("report", "check_id", "path", "start_line", "end_line", "severity")


@query("src_run_results", """SELECT p.pr_id::VARCHAR AS id, CASE WHEN p.pr_id % 5 = 0 OR p.pr_id % 7 = 3 THEN 0 ELSE n END AS n_issues,
 CASE WHEN p.pr_id % 5 = 0 THEN 'timeout' WHEN p.pr_id % 7 = 3 THEN 'no result' ELSE '' END AS error FROM c_prs p JOIN (SELECT pr_id, count(*) AS n FROM c_find GROUP BY 1) USING (pr_id)""")
def _(spark, sf):
    f = K.findings(spark, sf).groupBy("pr_id").agg(F.count("*").alias("n_issues"))
    samples = K.prs(spark, sf).select("pr_id", F.col("pr_id").cast("string").alias("id"))
    results = f.where("pr_id % 7 <> 3").select(F.col("pr_id").cast("string").alias("id"), "n_issues")
    errors = samples.where("pr_id % 5 = 0").select("id", F.lit("timeout").alias("error"))
    return L.run_results(samples, results, errors)


@query("src_run_findings", "SELECT ord AS run, file, line, title FROM c_find")
def _(spark, sf):
    f = K.findings(spark, sf)
    issue = F.array(F.struct("file", "line", "title"))
    k = F.col("ord") % 4
    payload = (
        F.when(k == 0, F.to_json(F.struct(F.struct(issue.alias("issues")).alias("result"))))
        .when(k == 1, F.to_json(F.struct(F.struct(issue.alias("findings")).alias("result"))))
        .when(k == 2, F.to_json(F.struct(issue.alias("issues")))).otherwise(F.to_json(F.struct(issue.alias("findings")))))
    return L.run_findings(f.select(F.col("ord").alias("run"), payload.alias("payload"))).select("run", "file", "line", "title")


@query("src_run_diff", "SELECT pr_id AS id, CASE WHEN pr_id % 3 = 2 THEN NULL ELSE diff END AS diff FROM c_prs")
def _(spark, sf):
    p = K.prs(spark, sf)
    own = p.select(F.col("pr_id").alias("id"), F.when(F.col("pr_id") % 3 == 0, F.col("diff")).alias("synthetic_diff"))
    copy = p.where("pr_id % 3 = 1").select(F.col("pr_id").alias("id"), F.col("diff").alias("synthetic_diff"))
    return L.run_diff(own, copy)
