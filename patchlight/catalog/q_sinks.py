"""Sink and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.catalog.base import CTES, query
from patchlight.catalog.q_diff import lines_of
from patchlight.catalog.q_findings import decided, gated
from patchlight.catalog.q_names import code_nodes  # noqa: F401
from patchlight.catalog.q_scoring import scores
from patchlight.functions import columns as X
from patchlight.operators import diff as D
from patchlight.operators import findings as O
from patchlight.operators import scoring as S
from patchlight.operators.similar import salted_first
from patchlight.plans import report as R
from patchlight.sources import carriers as K
from patchlight.sources import landed as L


@query("sink_finding_row", """SELECT file, line, title, description, severity, confidence, category, impact_type, impact_statement, NULL::VARCHAR AS diff_snippet,
 array_to_string(evidence, '|') AS evidence, token_cost FROM c_find""")
def _(spark, sf):
    return K.findings(spark, sf).select(*O.finding_row()).withColumn("evidence", F.array_join("evidence", "|"))


@query("sink_review_comments", """SELECT pr_id, ord, file AS path, line, body FROM (SELECT *, '[' || CASE severity WHEN 'ERROR' THEN 'High' WHEN 'WARNING' THEN 'Medium' WHEN 'INFO' THEN 'Low' ELSE 'Medium' END
 || '] ' || title || chr(10) || chr(10) || description AS body FROM c_find) QUALIFY row_number() OVER (PARTITION BY pr_id, body ORDER BY ord) = 1""")
def _(spark, sf):
    return O.review_comments(K.findings(spark, sf))


@query("sink_review_comments_raw", "SELECT pr_id, ord, file AS path, line, '[' || severity || '] ' || title || chr(10) || chr(10) || description AS body FROM c_find")
def _(spark, sf):
    return O.review_comments_raw(K.findings(spark, sf))


@query("rpt_inline_body", f"""SELECT ord, CASE severity WHEN 'ERROR' THEN '**[blocking]** 🔴' WHEN 'WARNING' THEN '**[non-blocking]** 🟡' ELSE '**[nitpick]** ℹ️' END || ' **' || title || '**' || chr(10) || chr(10) || description
 || CASE WHEN length(impact_type) > 0 THEN chr(10) || chr(10) || '{C.INLINE_IMPACT}`' || impact_type || '`' ELSE '' END
 || CASE WHEN length(impact_statement) > 0 THEN chr(10) || chr(10) || '{C.INLINE_CONSEQUENCE}' || impact_statement ELSE '' END AS body FROM c_find""")
def _(spark, sf):
    return K.findings(spark, sf).select("ord", O.inline_body().alias("body"))


CTES["c_runs"] = """SELECT d.pr_id, p.url, p.title, d.n AS issue_count, CASE WHEN d.n_error > 0 THEN 'HIGH' WHEN d.n_warning > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, s.before_gate, s.after_gate,
 (d.pr_id % 97)::DOUBLE / 8.0::DOUBLE AS elapsed, CASE WHEN d.pr_id % 6 = 0 THEN 'review_failed' END AS error FROM c_decide d JOIN c_prs p USING (pr_id) JOIN c_gstats s USING (pr_id)"""


def runs(spark, sf):
    from patchlight.catalog.q_findings import gate_stats

    d = decided(spark, sf).select("pr_id", F.col("n").alias("issue_count"), "risk_level")
    p = K.prs(spark, sf).select("pr_id", "url", "title")
    return p.join(d, "pr_id").join(gate_stats(spark, sf), "pr_id").select(
        "pr_id", "url", "title", "issue_count", "risk_level", "before_gate", "after_gate", ((F.col("pr_id") % 97) / 8.0).alias("elapsed"),
        F.when(F.col("pr_id") % 6 == 0, "review_failed").alias("error"))


@query("sink_run_row", """SELECT url, CASE WHEN error IS NULL THEN left(title, 80) END AS pr_title, CASE WHEN error IS NULL THEN coalesce(g.n, 0) END AS golden_count, CASE WHEN error IS NULL THEN issue_count END AS issue_count,
 CASE WHEN error IS NULL THEN risk_level END AS risk_level, CASE WHEN error IS NULL THEN before_gate END AS before_gate, CASE WHEN error IS NULL THEN after_gate END AS after_gate, round(elapsed, 1) AS elapsed, error
FROM c_runs r LEFT JOIN (SELECT pr_id, count(*) AS n FROM c_exp GROUP BY 1) g USING (pr_id)""")
def _(spark, sf):
    goldens = K.expected(spark, sf).join(K.prs(spark, sf).select("pr_id", "url"), "pr_id")
    return L.run_rows(runs(spark, sf), goldens)


@query("flt_error_runs", "SELECT pr_id, url FROM c_runs WHERE error IS NULL")
def _(spark, sf):
    return L.without_errors(runs(spark, sf), "pr_id").select("pr_id", "url")


@query("sink_context_summary", "SELECT pr_id, title, coalesce(head_sha, '') AS head_sha, array_to_string(files, ',') AS files, length(diff) AS diff_len, false AS diff_truncated FROM c_prs")
def _(spark, sf):
    return L.context_summary(K.prs(spark, sf))


@query("sink_review_json", """SELECT pr_id, 'run1' AS run_id, '{"pr_id":' || pr_id || ',"findings":' || n || ',"risk_level":"' || CASE WHEN n_error > 0 THEN 'HIGH' WHEN n_warning > 0 THEN 'MEDIUM' ELSE 'LOW' END || '"}' AS value FROM c_decide""")
def _(spark, sf):
    d = decided(spark, sf).select("pr_id", F.col("n").alias("findings"), "risk_level")
    return d.select("pr_id", F.lit("run1").alias("run_id"), F.to_json(F.struct("pr_id", "findings", "risk_level")).alias("value"))


@query("sink_dataset_export", """SELECT 's' || pr_id AS id, '{"id":"s' || pr_id || '","url":"' || url || '","lang":"' || lang || '"}' AS input, CASE WHEN e.id IS NOT NULL THEN '{"id":"' || e.id || '","severity":"' || e.severity || '"}' END AS expected_output
FROM c_prs LEFT JOIN c_exp e USING (pr_id)""")
def _(spark, sf):
    sid = F.concat(F.lit("s"), F.col("pr_id").cast("string"))
    samples = K.prs(spark, sf).select(sid.alias("id"), "url", "lang")
    expected = K.expected(spark, sf).select(sid.alias("sample_id"), "id", "severity")
    return L.dataset_items(samples, expected)


_HEAD_NAMES = "samples expected_total hit_count miss_count review_count noise_count duplicate_count clean_false_positives error_count".split()
_REASONS = "not_detected line_offset severity_miss".split()
_HEAD = " || ".join(
    ["'# Eval Score' || chr(10) || chr(10) || '| metric | value |' || chr(10) || '|---|---:|'"] + [f"chr(10) || '| {n} | ' || {n} || ' |'" for n in _HEAD_NAMES]
    + ["chr(10) || chr(10) || '## Miss Reason Breakdown' || chr(10) || chr(10) || '| reason | count |' || chr(10) || '|---|---:|'"]
    + [f"chr(10) || '| {n} | ' || {n} || ' |'" for n in _REASONS]
    + ["chr(10) || chr(10) || '## Samples' || chr(10) || chr(10) || '| sample | expected | hits | misses | review | noise | dup | not_det | line_off | sev_miss |' || chr(10)"
       " || '|---|---:|---:|---:|---:|---:|---:|---:|---:|---:|'"])
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in _HEAD_NAMES[1:7] + _REASONS)


@query("rpt_score_md", f"""SELECT 0 AS part, '' AS id, {_HEAD} AS text FROM (SELECT count(*) AS samples, {_SUMS},
 sum(CASE WHEN expected_total = 0 THEN noise_count ELSE 0 END)::BIGINT AS clean_false_positives, 0 AS error_count FROM c_score) UNION ALL """ + """SELECT 1 AS part, pr_id::VARCHAR AS id, '| ' || pr_id || ' | ' || expected_total || ' | ' || hit_count || ' | ' || miss_count || ' | ' || review_count || ' | ' || noise_count || ' | ' || duplicate_count
 || ' | ' || not_detected || ' | ' || line_offset || ' | ' || severity_miss || ' |' AS text FROM c_score""")
def _(spark, sf):
    s = scores(spark, sf)
    return R.score_markdown(s, S.totals(s))


@query("rpt_review_md", """SELECT pr_id AS id, 0 AS part, 0 AS idx, concat_ws(chr(10), '# ' || pr_id, '', 'PR: ' || url, 'Summary: ' || title,
 'Risk: ' || CASE WHEN n_error > 0 THEN 'HIGH' WHEN n_warning > 0 THEN 'MEDIUM' ELSE 'LOW' END,
 'Recommendation: ' || CASE WHEN n = 0 THEN 'APPROVE' WHEN n_error > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END, 'Issues: ' || n, '', '## Findings',
 CASE WHEN n = 0 THEN chr(10) || 'No findings.' END) AS text FROM c_decide JOIN c_prs USING (pr_id)
UNION ALL SELECT pr_id, 1, ord // 7, concat_ws(chr(10), '### ' || (ord // 7) || '. ' || coalesce(title, ''), '- severity: ' || coalesce(severity, ''),
 '- file: ' || coalesce(file, '') || ':' || coalesce(line::VARCHAR, ''), '- confidence: ' || coalesce(confidence::VARCHAR, ''),
 '- description: ' || coalesce(description, ''), '- evidence: ' || coalesce(array_to_string(evidence, ', '), ''), '- human_label: TODO', '- label_reason: TODO', '') FROM c_gate""")
def _(spark, sf):
    idx = F.expr("ord div 7")
    issues = gated(spark, sf).select(F.col("pr_id").alias("id"), "ord", idx.alias("idx"), *[c for c in O.finding_row() if c != "token_cost"])
    res = decided(spark, sf).join(K.prs(spark, sf).select("pr_id", "title", "url"), "pr_id").select(
        F.col("pr_id").alias("id"), "url", F.col("title").alias("summary"), "risk_level", F.col("final_decision").alias("merge_recommendation"), F.col("n").alias("n_issues"))
    return R.review_markdown(res.select("id", "url"), res.drop("url"), issues)


@query("rpt_review_body", f"""SELECT f.pr_id, 1 AS part, f.ord, '| ' || CASE severity WHEN 'ERROR' THEN '**[blocking]** 🔴' WHEN 'WARNING' THEN '**[non-blocking]** 🟡' ELSE '**[nitpick]** ℹ️' END || ' | `' || f.file || '` | ' || title || ' |' AS text
FROM c_gate f LEFT JOIN c_clines m ON m.pr_id = f.pr_id AND m.file = f.file AND m.new_line = f.line AND m.kind = 'add' WHERE m.position IS NULL
UNION ALL SELECT p.pr_id, 0, 0, '## Review' || chr(10) || chr(10) || '{C.REVIEW_RISK}' || CASE WHEN n_error > 0 THEN 'HIGH' WHEN n_warning > 0 THEN 'MEDIUM' ELSE 'LOW' END || chr(10) || chr(10) || '{C.REVIEW_SUMMARY}' || title || chr(10)
 || CASE WHEN EXISTS (SELECT 1 FROM c_gate f LEFT JOIN c_clines m ON m.pr_id = f.pr_id AND m.file = f.file AND m.new_line = f.line AND m.kind = 'add' WHERE f.pr_id = p.pr_id AND m.position IS NULL)
   THEN chr(10) || '{C.REVIEW_UNPLACED}' ELSE '' END FROM c_prs p JOIN c_decide USING (pr_id)""")
def _(spark, sf):
    prs = K.prs(spark, sf)
    add, rem = D.diff_stats(F.col("diff"))
    summary = prs.select("pr_id", F.col("title").alias("summary"), (add + rem).alias("changed_lines")).join(decided(spark, sf).select("pr_id", "risk_level"), "pr_id")
    chunks = D.split_files(K.prs(spark, sf, True))
    cover = D.coverage(chunks)
    skipped = D.filter_mechanical(chunks.select("pr_id", "file", "chunk")).where("skipped").select("pr_id", "file")
    first = salted_first(skipped, ["pr_id"], [F.col("file")], F.col("file"), F.lit(5)).groupBy("pr_id").agg(F.array_sort(F.collect_list("file")).alias("skipped_first"))
    split = O.inline_split(gated(spark, sf), D.position_map(lines_of(spark, sf, True)))
    return R.review_body(summary, cover.join(first, "pr_id", "left"), split.where("is_fallback"))


@query("fn_labels", """SELECT ord, trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CASE severity WHEN 'ERROR' THEN 'WARNING' ELSE 'INFO' END AS lower_severity,
 round(least(confidence * 0.85::DOUBLE, 0.9::DOUBLE), 9) AS impact_confidence, left(sha256(title), 16) AS hash, length(description) // 4 AS est_tokens,
 CASE category WHEN 'security' THEN 'security' WHEN 'performance' THEN 'performance' ELSE 'maintainability' END AS perspective FROM c_find""")
def _(spark, sf):
    from patchlight.operators.replies import perspective

    return K.findings(spark, sf).select(
        "ord", X.slug(F.col("title")).alias("slug"), X.downgrade(F.col("severity")).alias("lower_severity"), F.round(X.impact_confidence(F.col("confidence")), 9).alias("impact_confidence"),
        X.file_hash(F.col("title")).alias("hash"), X.tokens(F.col("description")).alias("est_tokens"), perspective(F.col("category"), F.lit("maintainability")).alias("perspective"))


@query("set_union_names", "SELECT pr_id, count(*) AS names FROM c_chfns GROUP BY 1")
def _(spark, sf):
    from patchlight.operators.names import changed_functions

    return changed_functions(lines_of(spark, sf, True)).groupBy("pr_id").agg(F.count("*").alias("names"))
