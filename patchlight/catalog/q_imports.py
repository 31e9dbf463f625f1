"""Importer queries over benchmark-shaped rows derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.catalog import ctes as T
from patchlight.catalog.base import CTES, query
from patchlight.functions import columns as X
from patchlight.sources import carriers as K
from patchlight.sources import importers as I

RULES = ["Crash when null", "Naming of value", "Stale cache is wrong", "Indentation fail", "Add docs"]
LEVELS = ["Critical", "High", "Medium", "Low", "Odd"]
AUTHORS = ["ann", "review-bot", "Copilot", "joe", "eve"]


def docs(spark, sf):
    return K.table(spark, sf, "documents")


def d_():
    return F.col("doc_id")


def crb_raw(spark, sf):
    d = d_()
    bug = F.struct(K.doc_file().alias("relevantFile"), (d % 30 + 1).cast("int").alias("relevantLinesStart"), (d % 30 + 3).cast("int").alias("relevantLinesEnd"))
    return docs(spark, sf).select(
        d.alias("ord"), F.concat(F.lit("Case #"), F.expr("doc_id div 2").cast("string"), F.lit(" (ü) End")).alias("testDescription"),
        F.concat(F.lit("## file: '"), K.doc_file(), F.lit("'\n@@ -1,2 +1,3 @@\n__new hunk__\n1  a\n2 +b")).alias("patch"),
        F.when(d % 3 == 0, F.array(bug, bug)).otherwise(F.array(bug)).alias("referenceBugs"),
        K.pick(["local", "cross-file"], d).alias("category"), "lang", F.when(d % 4 != 0, F.col("text")).alias("prSummary"))


CTES["c_crb"] = f"""SELECT *, 'codereviewbench__case_' || (doc_id // 2) || '_end' AS id, {T.doc_file()} AS file FROM c_docs WHERE doc_id % 2 = 0"""


@query("imp_codereviewbench", """SELECT id AS sample_id, id || '-b' || b AS id, file, (doc_id % 30 + 1)::INT AS line_start, (doc_id % 30 + 3)::INT AS line_end,
 'Bug at lines ' || (doc_id % 30 + 1) || '-' || (doc_id % 30 + 3) || ' per CodeReviewBench ground truth' AS reason FROM c_crb, LATERAL (SELECT unnest(CASE WHEN doc_id % 3 = 0 THEN [1, 2] ELSE [1] END) AS b)""")
def _(spark, sf):
    return I.codereviewbench(crb_raw(spark, sf))[1].select("sample_id", "id", "file", "line_start", "line_end", "reason")


@query("imp_codereviewbench_samples", """SELECT id, 'codereviewbench-' || (['local','cross-file'])[doc_id % 2 + 1] AS kind, lang, file AS files, left(coalesce(CASE WHEN doc_id % 4 <> 0 THEN text END, 'Case #' || (doc_id // 2) || ' (ü) End'), 120) AS title,
 '--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -1,2 +1,3 @@' || chr(10) || ' a' || chr(10) || '+b' || chr(10) AS synthetic_diff FROM c_crb""")
def _(spark, sf):
    return I.codereviewbench(crb_raw(spark, sf))[0].select("id", "kind", "lang", F.array_join("synthetic_files", ",").alias("files"), F.col("synthetic_pr_title").alias("title"), "synthetic_diff")


def wm_items(spark, sf):
    d = d_()
    n = d.cast("string")
    return docs(spark, sf).select(
        F.col("source").alias("repo"), d.alias("idx"),
        F.concat(F.when(d % 3 == 0, "https://github.com/ai-code-review-evaluation/x/pull/").otherwise("https://github.com/o/x/pull/"), n).alias("url"),
        F.when(d % 2 == 0, F.concat(F.when(d % 5 == 0, "https://github.com/o/x/commit/").otherwise("https://github.com/o/y/pull/"), n)).alias("original_url"),
        F.concat(F.lit("T"), n).alias("pr_title"),
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("comment"), F.element_at(
            F.array(*[F.lit(v) for v in LEVELS]), (i % 5 + 1).cast("int")).alias("severity"))).alias("comments"))


CTES["c_wm"] = """SELECT *, 'withmartian_' || source || '_' || (doc_id + 1) AS id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN 'https://github.com/o/y/pull/' || doc_id
 ELSE 'https://github.com/ai-code-review-evaluation/x/pull/' || doc_id END ELSE 'https://github.com/o/x/pull/' || doc_id END AS url,
 doc_id % 3 = 0 AND NOT (doc_id % 2 = 0 AND doc_id % 5 <> 0) AS is_mirror FROM c_docs"""
CTES["c_wmexp"] = f"""SELECT id AS sample_id, id || '-g' || j AS id, trim(x, e' \\t\\r\\n') AS description, (['ERROR','ERROR','WARNING','INFO','WARNING'])[(j - 1) % 5 + 1] AS severity
FROM (SELECT id, unnest(rows_) AS x, unnest(range(1, len(rows_) + 1)) AS j FROM c_wm) WHERE trim(x, e' \\t\\r\\n') <> ''"""


@query("imp_withmartian", "SELECT * FROM c_wmexp")
def _(spark, sf):
    return I.withmartian(wm_items(spark, sf))[1].select("sample_id", "id", "description", "severity")


@query("imp_withmartian_samples", "SELECT id, url, is_mirror FROM c_wm WHERE id IN (SELECT sample_id FROM c_wmexp)")
def _(spark, sf):
    return I.withmartian(wm_items(spark, sf))[0].select("id", "url", "is_mirror")


def qodo_rows(spark, sf):
    d = d_()
    return docs(spark, sf).select(
        F.concat(F.lit("Org/Re.po"), F.col("source")).alias("repo"), F.concat(F.lit("https://github.com/o/r/pull/"), d.cast("string"), F.lit("/")).alias("pr_url_to_review"),
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(
            F.element_at(F.array(*[F.lit(v) for v in RULES]), ((i + d) % 5 + 1).cast("int")).alias("title"), x.alias("description"), F.lit("").alias("rule_name"),
            F.when(i % 7 != 3, F.concat(F.lit("src/Mod"), i.cast("string"), F.lit(".py"))).alias("file_path"), (i * 2).cast("int").alias("start_line"),
            (i * 2 + 1).cast("int").alias("end_line"), F.lit("let snippet_value = get_item(item)").alias("problematic_code_snippet"))).alias("issues"))


def _kw(title: str) -> str:
    return {"Crash when null": "['Crash', 'null']", "Naming of value": "['Naming', 'value']", "Stale cache is wrong": "['Stale', 'cache', 'wrong']",
            "Indentation fail": "['Indentation', 'fail']", "Add docs": "['docs']"}[title]


CTES["c_qodo"] = f"""SELECT *, 'qodo-org-re-po' || source || '-' || doc_id AS sid, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
 SELECT doc_id, source, x, i, {T.lit(RULES)}[(i + doc_id) % 5 + 1] AS title, lower({T.lit(RULES)}[(i + doc_id) % 5 + 1] || ' ' || x || ' ') AS t FROM (
  SELECT doc_id, source, unnest(rows_) AS x, unnest(range(len(rows_))) AS i FROM c_docs))
WHERE i % 7 <> 3 AND NOT {T.any_word('t', C.QODO_STYLE)} AND {T.any_word('t', C.QODO_RISK)}"""


@query("imp_qodo", f"""SELECT sid AS sample_id, sid || '-i' || k AS id, 'src/Mod' || i || '.py' AS file, (CASE WHEN i = 0 THEN 1 ELSE i * 2 END)::INT AS line_start, (i * 2 + 1)::INT AS line_end,
 array_to_string(list_append(CASE title {' '.join(f"WHEN '{r}' THEN {_kw(r)}" for r in RULES)} END, 'Mod' || i), ',') AS title_keywords,
 'snippet_value,get_item,item,Mod' || i AS evidence_keywords FROM c_qodo WHERE k <= 2""")
def _(spark, sf):
    return I.qodo(qodo_rows(spark, sf))[1].select("sample_id", "id", "file", "line_start", "line_end", F.array_join("title_keywords", ",").alias("title_keywords"),
                                                  F.array_join("evidence_keywords", ",").alias("evidence_keywords"))


@query("flt_functional_issue", f"SELECT ord FROM c_find WHERE {T.any_word('t', C.QODO_RISK)} AND NOT {T.any_word('t', C.QODO_STYLE)}".replace(
    "FROM c_find", "FROM (SELECT ord, lower(title || ' ' || description || ' ' || category) AS t FROM c_find)"))
def _(spark, sf):
    f = K.findings(spark, sf)
    return f.where(I.functional_issue(F.col("title"), F.col("description"), F.col("category"))).select("ord")


def comments(spark, sf):
    t = F.col("conv_id") + F.col("turn")
    return K.table(spark, sf, "conversations").select(
        "conv_id", "turn", K.pick(AUTHORS, t).alias("author"),
        F.concat(F.col("text"), K.pick([" This may crash at runtime.", " nit: out of scope error", " looks good", " why would this fail"], t)).alias("body"),
        F.when(t % 6 != 5, F.concat(F.lit("src/c"), F.col("conv_id").cast("string"), F.lit(".py"))).alias("path"),
        F.when(t % 7 != 6, F.col("turn").cast("int") + 1).alias("line"))


CTES["c_comm"] = f"""SELECT conv_id, turn, {T.pick(AUTHORS, 'conv_id + turn')} AS author, text || {T.pick([' This may crash at runtime.', ' nit: out of scope error', ' looks good', ' why would this fail'], 'conv_id + turn')} AS body,
 CASE WHEN (conv_id + turn) % 6 <> 5 THEN 'src/c' || conv_id || '.py' END AS path, CASE WHEN (conv_id + turn) % 7 <> 6 THEN turn::INT + 1 END AS line FROM conversations"""
CTES["c_human"] = f"""SELECT * FROM c_comm WHERE NOT {T.any_word('lower(author)', C.SWE_BOTS)} AND length(lower(body)) >= 30 AND NOT {T.any_word('lower(body)', C.SWE_LOW_SIGNAL)}
 AND {T.any_word('lower(body)', C.SWE_RISK)} AND path IS NOT NULL AND line IS NOT NULL"""


@query("flt_human_comment", "SELECT conv_id, turn FROM c_human")
def _(spark, sf):
    return comments(spark, sf).where(I.human_comment(F.col("author"), F.col("body"), F.col("path"), F.col("line"))).select("conv_id", "turn")


@query("imp_swe_prbench", f"""SELECT 'task' || doc_id AS sample_id, 'task' || doc_id || '-c' || k AS id, 'src/s' || i || '.py' AS file, i::INT AS line_start FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, {T.pick(AUTHORS, 'i')} AS author, lower(x || ' it may crash here') AS b FROM (SELECT doc_id, unnest(rows_) AS x, unnest(range(len(rows_))) AS i FROM c_docs WHERE lang = 'en'))
 WHERE NOT {T.any_word('lower(author)', C.SWE_BOTS)} AND length(b) >= 30 AND NOT {T.any_word('b', C.SWE_LOW_SIGNAL)} AND {T.any_word('b', C.SWE_RISK)}) WHERE k <= 3""")
def _(spark, sf):
    rows = docs(spark, sf).select(
        F.concat(F.lit("task"), d_().cast("string")).alias("task_id"), F.lit("o/r").alias("repo"), F.lit("u").alias("pr_url"),
        F.when(F.col("lang") == "en", "Python").otherwise("Go").alias("language"), F.lit("easy").alias("difficulty"),
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(
            F.element_at(F.array(*[F.lit(a) for a in AUTHORS]), (i % 5 + 1).cast("int")).alias("author"), F.concat(x, F.lit(" it may crash here")).alias("body"),
            F.concat(F.lit("src/s"), i.cast("string"), F.lit(".py")).alias("path"), i.cast("int").alias("line"), F.lit("@@ hunk_text").alias("diffHunk"))).alias("human_review_comments"))
    return I.swe_prbench(rows)[1].select("sample_id", "id", "file", "line_start")


CATS = ["Code Defect", "Security Vulnerability", "Performance", "Maintainability and Readability", "Other"]
LANGS = ["Python", "Java", "TypeScript"]


def aacr_rows(spark, sf):
    e = F.col("event_id")
    n = docs(spark, sf).select(F.floor(F.max("doc_id") / 4) + 1).scalar()
    pr = e % n
    return K.table(spark, sf, "events").select(
        e.alias("ord"), F.concat(F.lit("https://github.com/own/rep"), (pr % 8).cast("string"), F.lit("/pull/"), pr.cast("string")).alias("pr_url"),
        (F.col("user_id") % 2).alias("label"), F.concat(F.lit("p"), (e % 9).cast("string")).alias("path"), (e % 4).cast("int").alias("from_line"),
        (e % 4 + 2).cast("int").alias("to_line"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("note"), K.pick(CATS, e).alias("category"),
        K.pick(list(C.AACR_CONTEXT.values()), F.col("user_id")).alias("context"), K.pick(LANGS, pr).alias("project_main_language"))


CTES["c_aacr0"] = f"""SELECT event_id AS ord, event_id % (SELECT max(doc_id) // 4 + 1 FROM documents) AS pr, user_id % 2 AS label, event_type, user_id,
 {T.pick(CATS, 'event_id')} AS category, {T.pick(list(C.AACR_CONTEXT.values()), 'user_id')} AS context FROM events"""
CTES["c_aacr"] = f"""SELECT 'aacr_own_rep' || (pr % 8) || '_' || pr AS sample_id, 'aacr_own_rep' || (pr % 8) || '_' || pr || '-g' || row_number() OVER (PARTITION BY pr ORDER BY ord) AS id,
 CASE WHEN ord % 4 > 0 THEN (ord % 4)::INT END AS line_start, CASE WHEN ord % 4 > 0 THEN (ord % 4 + 2)::INT END AS line_end, event_type AS description,
 CASE category WHEN 'Code Defect' THEN 'ERROR' WHEN 'Security Vulnerability' THEN 'ERROR' WHEN 'Performance' THEN 'WARNING' WHEN 'Maintainability and Readability' THEN 'INFO' ELSE 'WARNING' END AS severity,
 {T.pick(LANGS, 'pr')} AS language, context FROM c_aacr0 WHERE label = 1"""


@query("imp_aacr", "SELECT sample_id, id, line_start, line_end, description, severity FROM c_aacr")
def _(spark, sf):
    return I.aacr(aacr_rows(spark, sf)).select("sample_id", "id", "line_start", "line_end", "description", "severity")


@query("imp_aacr_limited", """SELECT sample_id, count(*) AS n FROM c_aacr WHERE lower(language) = 'python' AND context = 'File Level' AND sample_id IN (SELECT sample_id FROM (
 SELECT DISTINCT sample_id, 'https://github.com/own/rep' || string_split(sample_id, '_')[3][4:] || '/pull/' || string_split(sample_id, '_')[-1] AS u FROM c_aacr WHERE lower(language) = 'python' AND context = 'File Level') ORDER BY u LIMIT 20) GROUP BY 1""")
def _(spark, sf):
    return I.aacr(aacr_rows(spark, sf), lang="Python", context="file", limit=20).groupBy("sample_id").agg(F.count("*").alias("n"))


@query("imp_lang_counts", "SELECT language, count(DISTINCT sample_id) AS n FROM c_aacr GROUP BY 1")
def _(spark, sf):
    samples = I.aacr(aacr_rows(spark, sf)).select("sample_id", "language").distinct()
    return I.language_counts(samples)


@query("imp_filters", """SELECT count(*) AS samples, sum(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS expected FROM (SELECT doc_id FROM c_crb WHERE lang = 'en' ORDER BY id LIMIT 50)""")
def _(spark, sf):
    samples, expected = I.codereviewbench(crb_raw(spark, sf))
    return I.import_totals(I.pick_samples(samples, "id", lang="en", category="local", limit=50), expected)


def entries(spark, sf):
    return wm_items(spark, sf).select(F.col("idx").alias("ord"), "url", "original_url", "pr_title", F.concat("repo", F.lit(".json")).alias("source_file"))


CTES["c_entries"] = """SELECT doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN 'https://github.com/ai-code-review-evaluation/x/pull/' || doc_id ELSE 'https://github.com/o/x/pull/' || doc_id END AS url,
 CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'https://github.com/o/x/commit/' || doc_id ELSE 'https://github.com/o/y/pull/' || doc_id END END AS original_url, 'T' || doc_id AS pr_title, source || '.json' AS source_file FROM c_docs"""


@query("imp_benchmark_prs", "SELECT ord, url, coalesce(original_url, url) AS original_url, pr_title, source_file FROM c_entries")
def _(spark, sf):
    return I.benchmark_prs(entries(spark, sf))


@query("imp_golden_join", """SELECT p.url, CASE WHEN p.pr_id % 3 = 0 THEN 0 ELSE coalesce(n, 0) END AS goldens FROM c_prs p LEFT JOIN (SELECT pr_id, len(rows_) AS n FROM c_docs QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY doc_id DESC) = 1) USING (pr_id)""")
def _(spark, sf):
    goldens = docs(spark, sf).withColumn("pr_id", F.expr("doc_id div 4")).where("pr_id % 3 <> 0").select(
        F.concat(F.lit("https://github.com/org/repo"), (F.col("pr_id") % 8).cast("string"), F.lit("/pull/"), F.col("pr_id").cast("string")).alias("url"),
        d_().alias("ord"), F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("comment"), F.lit("High").alias("severity"))).alias("golden_comments"))
    return I.golden_join(K.prs(spark, sf).select("url"), goldens).select("url", F.size("golden_comments").cast("bigint").alias("goldens"))
