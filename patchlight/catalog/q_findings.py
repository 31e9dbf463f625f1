"""Finding, judge and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.catalog import ctes as T
from patchlight.catalog.base import CTES, query
from patchlight.catalog.q_diff import lines_of
from patchlight.functions import columns as X
from patchlight.operators import diff as D
from patchlight.operators import findings as O
from patchlight.sources import carriers as K

FT = T.FTEXT
CTES["c_exact"] = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, min(ord) OVER (PARTITION BY pr_id, file, line, title) AS first_ord,
 row_number() OVER (PARTITION BY pr_id, file, line, title ORDER BY {T.RANK}, ord) AS rn FROM c_find) WHERE rn = 1"""
CTES["c_sem"] = f"""SELECT a.* EXCLUDE (w, rk) FROM (SELECT *, {T.RANK} AS rk, list_distinct(regexp_extract_all(lower(concat_ws(' ', title, description)), '[a-z0-9_]+')) AS w FROM c_exact) a
WHERE a.line IS NULL OR len(a.w) = 0 OR NOT EXISTS (SELECT 1 FROM (SELECT *, {T.RANK} AS rk,
  list_distinct(regexp_extract_all(lower(concat_ws(' ', title, description)), '[a-z0-9_]+')) AS w FROM c_exact) b
 WHERE b.pr_id = a.pr_id AND b.file = a.file AND abs(b.line - a.line) <= 3
  AND (b.rk < a.rk OR (b.rk = a.rk AND (b.confidence > a.confidence OR (b.confidence = a.confidence AND b.ord < a.ord))))
  AND len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.8)"""


def _score(cat: str) -> str:
    return "(" + " + ".join(f"contains(t, '{w}')::INT" for w in C.CATEGORY_WORDS[cat]) + ")"


_CATS = list(C.CATEGORY_WORDS)
_GUESS = f"""CASE WHEN greatest(s0, s1, s2) = 0 THEN NULL
 ELSE CASE WHEN s0 = greatest(s0, s1, s2) THEN '{_CATS[0]}' WHEN s1 = greatest(s0, s1, s2) THEN '{_CATS[1]}' ELSE '{_CATS[2]}' END END"""
CTES["c_guess"] = f"""SELECT ord, nullif({_GUESS}, category) AS guessed FROM (SELECT ord, category, {_score(_CATS[0])} AS s0,
 {_score(_CATS[1])} AS s1, {_score(_CATS[2])} AS s2 FROM (SELECT ord, category, lower(title || ' ' || description) AS t FROM c_find))"""
FRONT = f"""(category = 'security' AND ({T.ends_any("'/' || lower(file)", C.FRONTEND_SUFFIXES)} OR {T.any_word("'/' || lower(file)", C.FRONTEND_PATHS)})
 AND {T.any_word(FT, C.GUESS_WORDS)} AND {T.any_word(FT, C.CLIENT_WORDS)} AND NOT {T.any_word(FT, C.SERVER_WORDS)})"""
WEAK = f"""(category = 'performance' AND severity = 'WARNING' AND {T.any_word(FT, C.MICRO_WORDS)} AND NOT {T.any_word(FT, C.HARD_WORDS)})"""
ACT = f"""(NOT {FRONT} AND NOT {WEAK} AND coalesce(lower(trim(impact_type)) IN {T.in_list(C.IMPACT_TYPES)}, false)
 AND trim(coalesce(impact_statement, '')) <> '')"""
CTES["c_decide"] = """SELECT p.pr_id, coalesce(n, 0) AS n, coalesce(n_error, 0) AS n_error, coalesce(n_warning, 0) AS n_warning, coalesce(n_info, 0) AS n_info
FROM c_prs p LEFT JOIN (SELECT pr_id, count(*) AS n, count(*) FILTER (severity = 'ERROR') AS n_error,
 count(*) FILTER (severity = 'WARNING') AS n_warning, count(*) FILTER (severity = 'INFO') AS n_info FROM c_gate GROUP BY 1) USING (pr_id)"""


def f(spark, sf):
    return K.findings(spark, sf)


def gated(spark, sf):
    return O.publication_gate(K.findings(spark, sf), lines_of(spark, sf, True))


def decided(spark, sf):
    return O.decisions(K.prs(spark, sf), gated(spark, sf))


@query("flt_comment_line", "SELECT f.ord FROM c_find f JOIN c_marks m USING (pr_id, file, line) WHERE m.is_comment")
def _(spark, sf):
    return O.comment_findings(f(spark, sf), lines_of(spark, sf, True)).select("ord")


@query("flt_evidence_match", """SELECT DISTINCT f.ord FROM (SELECT pr_id, file, ord, unnest(evidence) AS e FROM c_find) f
JOIN c_lines l ON l.pr_id = f.pr_id AND l.file = f.file AND l.kind = 'add' AND contains(l.text, ltrim(f.e, '+'))""")
def _(spark, sf):
    return O.evidence_matches(f(spark, sf), lines_of(spark, sf)).select("ord")


@query("flt_line_in_diff", "SELECT f.ord FROM c_find f LEFT JOIN c_marks m USING (pr_id, file, line) WHERE f.line IS NULL OR m.line IS NOT NULL")
def _(spark, sf):
    return O.in_diff(f(spark, sf), lines_of(spark, sf, True)).select("ord")


@query("gate_publication", "SELECT pr_id, ord, file, line, title, severity, confidence FROM c_gate")
def _(spark, sf):
    return gated(spark, sf).select("pr_id", "ord", "file", "line", "title", "severity", "confidence")


@query("gate_strict", f"""SELECT f.ord FROM c_find f LEFT JOIN c_marks m USING (pr_id, file, line)
WHERE severity <> 'INFO' AND ((evidence_source = 'CONTEXT' AND coalesce(len(evidence), 0) > 0)
 OR (evidence_source <> 'CONTEXT' AND (f.line IS NULL OR (m.is_comment IS NOT NULL AND NOT m.is_comment AND m.is_added))
   AND EXISTS (SELECT 1 FROM (SELECT unnest(f.evidence) AS e) x JOIN c_clines l ON l.pr_id = f.pr_id AND l.file = f.file AND l.kind = 'add' AND contains(l.text, ltrim(x.e, '+')))))
QUALIFY row_number() OVER (PARTITION BY f.pr_id, f.file, f.line, title ORDER BY {T.RANK}, confidence DESC, ord) = 1""")
def _(spark, sf):
    return O.publication_gate(K.findings(spark, sf), lines_of(spark, sf, True), strict=True).select("ord")


@query("flt_severity", "SELECT ord FROM c_find WHERE severity IN ('ERROR', 'WARNING')")
def _(spark, sf):
    return O.keep_severity(f(spark, sf)).select("ord")


@query("flt_noise", f"SELECT ord FROM c_find WHERE confidence >= 0.6 AND {ACT}")
def _(spark, sf):
    return O.reduce_noise(f(spark, sf)).select("ord")


@query("flt_actionable", f"SELECT ord, {ACT} AS actionable FROM c_find")
def _(spark, sf):
    return f(spark, sf).select("ord", O.actionable().alias("actionable"))


@query("flt_frontend_guess", f"SELECT ord FROM c_find WHERE {FRONT}")
def _(spark, sf):
    return f(spark, sf).where(O.frontend_guess()).select("ord")


@query("flt_weak_perf", f"SELECT ord FROM c_find WHERE {WEAK}")
def _(spark, sf):
    return f(spark, sf).where(O.weak_performance()).select("ord")


@query("flt_min_conf", "SELECT ord FROM c_find WHERE severity <> 'INFO' AND confidence >= 0.7")
def _(spark, sf):
    return O.min_confidence(f(spark, sf)).select("ord")


@query("dedup_exact", "SELECT pr_id, file, line, title, ord, severity, first_ord FROM c_exact")
def _(spark, sf):
    return O.dedup_exact(f(spark, sf)).select("pr_id", "file", "line", "title", "ord", "severity", "first_ord")


@query("group_findings_file", """SELECT pr_id, file, ord, count(*) OVER (PARTITION BY pr_id, file) AS group_size,
 min(ord) OVER (PARTITION BY pr_id, file) AS group_ord FROM c_find""")
def _(spark, sf):
    return O.file_groups(f(spark, sf)).select("pr_id", "file", "ord", "group_size", "group_ord")


@query("dedup_semantic", "SELECT pr_id, file, line, ord FROM c_sem")
def _(spark, sf):
    return O.semantic_dedup(O.dedup_exact(f(spark, sf)).drop("first_ord")).select("pr_id", "file", "line", "ord")


@query("cat_guess", "SELECT f.ord, coalesce(guessed, category) AS category FROM c_find f JOIN c_guess USING (ord)")
def _(spark, sf):
    return O.recategorize(f(spark, sf)).select("ord", "category")


@query("merge_decision", "SELECT pr_id, CASE WHEN n_error > 0 THEN 'REQUEST_CHANGES' WHEN n_warning > 0 THEN 'COMMENT' ELSE 'APPROVE' END AS merge_decision FROM c_decide")
def _(spark, sf):
    return decided(spark, sf).select("pr_id", "merge_decision")


@query("final_decision", """SELECT pr_id, n AS findings, CASE WHEN n = 0 THEN 'APPROVE' WHEN n_error > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS final_decision,
 CASE WHEN n_error > 0 THEN 'HIGH' WHEN n_warning > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM c_decide""")
def _(spark, sf):
    return decided(spark, sf).select("pr_id", F.col("n").alias("findings"), "final_decision", "risk_level")


@query("risk_level", "SELECT pr_id, CASE WHEN n_error > 0 THEN 'HIGH' WHEN n_warning > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM c_decide")
def _(spark, sf):
    return decided(spark, sf).select("pr_id", "risk_level")


@query("severity_counts", """SELECT p.pr_id, count(*) FILTER (severity = 'ERROR') AS n_error, count(*) FILTER (severity = 'WARNING') AS n_warning,
 count(*) FILTER (severity = 'INFO') AS n_info FROM c_prs p LEFT JOIN c_find f USING (pr_id) GROUP BY 1""")
def _(spark, sf):
    return O.decisions(K.prs(spark, sf), f(spark, sf)).select("pr_id", "n_error", "n_warning", "n_info")


CTES["c_gstats"] = """SELECT pr_id, before_gate, coalesce(after_gate, 0) AS after_gate, before_gate - coalesce(after_gate, 0) AS filtered
FROM (SELECT pr_id, count(*) AS before_gate FROM c_find GROUP BY 1) LEFT JOIN (SELECT pr_id, count(*) AS after_gate FROM c_gate GROUP BY 1) USING (pr_id)"""


def gate_stats(spark, sf):
    before = f(spark, sf).groupBy("pr_id").agg(F.count("*").alias("before_gate"))
    after = gated(spark, sf).groupBy("pr_id").agg(F.count("*").alias("after_gate"))
    return before.join(after, "pr_id", "left").select(
        "pr_id", "before_gate", F.coalesce("after_gate", F.lit(0)).alias("after_gate")
    ).withColumn("filtered", F.col("before_gate") - F.col("after_gate"))


@query("gate_stats", "SELECT pr_id, before_gate, after_gate, filtered FROM c_gstats")
def _(spark, sf):
    return gate_stats(spark, sf)


@query("gate_summary", """SELECT sum(before_gate)::BIGINT AS total_before_gate, sum(after_gate)::BIGINT AS total_after_gate,
 round((sum(before_gate) - sum(after_gate))::DOUBLE / greatest(sum(before_gate), 1)::DOUBLE, 3) AS filter_rate,
 round((sum(before_gate) - sum(after_gate))::DOUBLE / greatest(sum(before_gate), 1)::DOUBLE * 100, 1) AS filter_pct FROM c_gstats""")
def _(spark, sf):
    g = gate_stats(spark, sf).agg(F.sum("before_gate").alias("b"), F.sum("after_gate").alias("a"))
    rate = (F.col("b") - F.col("a")) / F.greatest("b", F.lit(1))
    return g.select(F.col("b").alias("total_before_gate"), F.col("a").alias("total_after_gate"),
                    F.round(rate, 3).alias("filter_rate"), F.round(rate * 100, 1).alias("filter_pct"))


@query("skipped_agents", """SELECT conv_id, turn AS idx, 'agent_' || turn AS agent, 'agent_' || turn || '(' ||
 CASE WHEN length(text) % 3 = 0 THEN 'timeout' ELSE 'format_error' END || ': ' || length(text) || ' chars)' AS note
FROM conversations WHERE role = 'assistant' AND length(text) % 3 <> 1""")
def _(spark, sf):
    runs = K.table(spark, sf, "conversations").where("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("idx"),
        F.when(F.length("text") % 3 == 0, "timeout").when(F.length("text") % 3 == 1, "success")
        .otherwise("format_error").alias("status"),
        F.concat(F.length("text").cast("string"), F.lit(" chars")).alias("error_message"))
    return runs.where("status <> 'success'").select(
        "conv_id", "idx", F.concat(F.lit("agent_"), F.col("idx").cast("string")).alias("agent"),
        F.concat(F.lit("agent_"), F.col("idx").cast("string"), F.lit("("), "status", F.lit(": "), "error_message", F.lit(")")).alias("note"))


@query("repo_review_stats", """SELECT 'org/repo' || (user_id % 8) AS repo, count(*) AS total_reviews, sum(event_id % 5)::BIGINT AS total_issues_found,
 round(avg(value), 2) AS avg_duration_ms, count(*) FILTER (event_type = 'error') AS n_high, count(*) FILTER (event_type IN ('purchase','signup')) AS n_medium,
 count(*) FILTER (event_type NOT IN ('error','purchase','signup')) AS n_low, epoch_us(max(ts)) AS last_review_us FROM events GROUP BY 1""")
def _(spark, sf):
    from patchlight.streaming.jobs import repo_stats

    e = K.table(spark, sf, "events")
    reviews = e.select(
        F.concat(F.lit("org/repo"), (F.col("user_id") % 8).cast("string")).alias("repo"), "ts",
        F.col("value").alias("duration_ms"), (F.col("event_id") % 5).alias("issue_count"),
        F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type").isin("purchase", "signup"), "MEDIUM")
        .otherwise("LOW").alias("risk_level"))
    return repo_stats(reviews).select(
        "repo", "total_reviews", "total_issues_found", "avg_duration_ms", "n_high", "n_medium", "n_low",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', last_review_at)").alias("last_review_us"))


@query("join_inline_position", """SELECT f.ord, m.position AS inline_position, m.position IS NULL AS is_fallback FROM c_gate f
LEFT JOIN c_clines m ON m.pr_id = f.pr_id AND m.file = f.file AND m.new_line = f.line AND m.kind = 'add'""")
def _(spark, sf):
    return O.inline_split(gated(spark, sf), D.position_map(lines_of(spark, sf, True))).select("ord", "inline_position", "is_fallback")
