"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlight.catalog.base import CTES, query
from patchlight.catalog.q_diff import lines_of
from patchlight.catalog.q_findings import gated
from patchlight.functions import columns as X
from patchlight.operators import diff as D
from patchlight.operators import scoring as S
from patchlight.operators.similar import similar_sets
from patchlight.session import cut_lineage
from patchlight.sources import carriers as K

CTES["c_hr"] = r"""SELECT pr_id, file, hunk, s AS start_line, s + greatest(n - 1, 0) AS end_line FROM (
 SELECT pr_id, file, hunk, regexp_extract(text, '\+([0-9]+)', 1)::INT AS s,
  coalesce(nullif(regexp_extract(text, '\+[0-9]+,([0-9]+)', 1), '')::INT, 1) AS n FROM c_clines WHERE kind = 'hunk')"""


def _rank(col: str) -> str:
    return f"(CASE {col} WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END)"


def _hx(line: str) -> str:
    return f"(SELECT min(h.hunk) FROM c_hr h WHERE h.pr_id = f.pr_id AND h.file = f.file AND {line} BETWEEN h.start_line - 1 AND h.end_line + 1)"


CTES["c_pairs0"] = f"""SELECT f.pr_id, f.file, f.ord AS issue_ord, e.ord AS expected_ord, e.id AS expected_id, f.line, e.line_start, e.line_end,
 {_hx('f.line')} AS ih, {_hx('e.line_start')} AS hs, {_hx('e.line_end')} AS he,
 EXISTS (SELECT 1 FROM c_hr h WHERE h.pr_id = f.pr_id AND h.file = f.file) AS has_hunks,
 {_rank('f.severity')} >= {_rank('e.severity')} - 1 AS sev,
 (len(title_keywords) = 0 OR len(list_filter(title_keywords, lambda k: contains(t, lower(k)))) > 0
  OR coalesce(len(evidence_keywords), 0) = 0 OR len(list_filter(evidence_keywords, lambda k: contains(t, lower(k)))) > 0) AS text_ok
FROM (SELECT *, lower(coalesce(title, '') || chr(10) || coalesce(description, '') || chr(10) || coalesce(impact_statement, 'None') || chr(10) || coalesce(array_to_string(evidence, chr(10)), '')) AS t FROM c_find) f
JOIN c_exp e USING (pr_id, file)"""


def _within(gap: int, lines: int) -> str:
    return f"(CASE WHEN has_hunks THEN coalesce(abs(ih - gh) <= {gap}, false) ELSE line BETWEEN line_start - {lines} AND line_end + {lines} END)"


CTES["c_pairs"] = f"""SELECT pr_id, file, issue_ord, expected_ord, expected_id, line_ok AND text_ok AND sev AS is_match, near OR text_ok AS is_review,
 CASE WHEN broad AND text_ok AND NOT sev THEN 'severity_miss' WHEN NOT (line_ok AND text_ok AND sev) THEN 'line_offset' END AS reason
FROM (SELECT *, CASE WHEN known THEN {_within(0, 5)} ELSE true END AS line_ok, known AND {_within(1, 20)} AS near, known AND {_within(2, 50)} AS broad
 FROM (SELECT *, CASE WHEN hs IS NULL OR hs = 0 THEN he ELSE hs END AS gh, line IS NOT NULL AND line_start IS NOT NULL AS known FROM c_pairs0))
WHERE text_ok OR near OR broad"""
CTES["c_match"] = """SELECT pr_id, max(dup) AS duplicates, max_by(taken, seq) AS matched FROM (
WITH RECURSIVE l AS (SELECT pr_id, issue_ord, list_sort(list(expected_ord)) AS cands FROM c_pairs WHERE is_match GROUP BY 1, 2),
 q AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY len(cands), issue_ord) AS seq FROM l),
 w AS (SELECT pr_id, seq, [cands[1]] AS taken, 0 AS dup FROM q WHERE seq = 1
  UNION ALL SELECT q.pr_id, q.seq, CASE WHEN len(free) > 0 THEN list_append(w.taken, free[1]) ELSE w.taken END, w.dup + CASE WHEN len(free) > 0 THEN 0 ELSE 1 END
  FROM w JOIN q ON q.pr_id = w.pr_id AND q.seq = w.seq + 1, LATERAL (SELECT list_filter(q.cands, lambda c: NOT list_contains(w.taken, c)) AS free) x)
SELECT * FROM w) GROUP BY 1"""
CTES["c_taken"] = "SELECT pr_id, unnest(matched) AS expected_ord FROM c_match"
CTES["c_score"] = """SELECT p.pr_id, coalesce(n_exp, 0) AS expected_total, coalesce(n_iss, 0) AS issue_total, coalesce(len(m.matched), 0) AS hit_count,
 coalesce(ms.n, 0) AS miss_count, coalesce(r.ids, 0) AS review_count, coalesce(m.duplicates, 0) AS duplicate_count, coalesce(ms.nd, 0) AS not_detected,
 coalesce(ms.lo, 0) AS line_offset, coalesce(ms.sm, 0) AS severity_miss, coalesce(n_iss, 0) - coalesce(mi.n, 0) - coalesce(r.n, 0) AS noise_count
FROM c_prs p LEFT JOIN (SELECT pr_id, count(*) AS n_exp FROM c_exp GROUP BY 1) USING (pr_id) LEFT JOIN (SELECT pr_id, count(*) AS n_iss FROM c_find GROUP BY 1) USING (pr_id)
LEFT JOIN c_match m USING (pr_id) LEFT JOIN (SELECT pr_id, count(DISTINCT issue_ord) AS n FROM c_pairs WHERE is_match GROUP BY 1) mi USING (pr_id)
LEFT JOIN (SELECT pr_id, count(*) AS n, count(DISTINCT e) AS ids FROM (SELECT q.pr_id, q.issue_ord, min(q.expected_ord) AS e FROM c_pairs q WHERE q.is_review
   AND NOT EXISTS (SELECT 1 FROM c_pairs z WHERE z.is_match AND z.pr_id = q.pr_id AND z.issue_ord = q.issue_ord)
   AND NOT EXISTS (SELECT 1 FROM c_taken t WHERE t.pr_id = q.pr_id AND t.expected_ord = q.expected_ord) GROUP BY 1, 2) GROUP BY 1) r USING (pr_id)
LEFT JOIN (SELECT e.pr_id, count(*) AS n, count(*) FILTER (z.reason IS NULL) AS nd, count(*) FILTER (z.reason = 'line_offset') AS lo, count(*) FILTER (z.reason = 'severity_miss') AS sm
  FROM c_exp e LEFT JOIN c_reason z ON z.pr_id = e.pr_id AND z.expected_ord = e.ord
  WHERE NOT EXISTS (SELECT 1 FROM c_taken t WHERE t.pr_id = e.pr_id AND t.expected_ord = e.ord) GROUP BY 1) ms USING (pr_id)"""
CTES["c_reason"] = "SELECT pr_id, expected_ord, min_by(reason, issue_ord) AS reason FROM c_pairs WHERE reason IS NOT NULL GROUP BY 1, 2"
CTES["c_gold"] = "SELECT pr_id, ord, description AS text, list_sort(list_distinct(regexp_extract_all(lower(description), '[a-z0-9_]+'))) AS w FROM c_exp"
CTES["c_said"] = "SELECT pr_id, ord, title || ' ' || description AS text, list_sort(list_distinct(regexp_extract_all(lower(title || ' ' || description), '[a-z0-9_]+'))) AS w FROM c_gate"
CTES["c_sim"] = """SELECT * FROM (SELECT g.pr_id, g.ord AS golden_ord, f.ord AS finding_ord, g.w AS lw, f.w AS rw,
 len(list_intersect(g.w, f.w))::DOUBLE / (len(g.w) + len(f.w) - len(list_intersect(g.w, f.w))) AS sim FROM c_gold g JOIN c_said f USING (pr_id)) WHERE sim >= 0.3"""
CTES["c_scpr"] = """SELECT *, CASE WHEN finding_count > 0 AND golden_count > 0 THEN round(tp_precision::DOUBLE / finding_count, 3) WHEN finding_count > 0 THEN 0.0::DOUBLE END AS precision,
 CASE WHEN finding_count > 0 AND golden_count > 0 THEN round(tp_recall::DOUBLE / golden_count, 3) WHEN golden_count > 0 THEN 0.0::DOUBLE END AS recall,
 finding_count - tp_precision AS fp, golden_count - tp_recall AS fn, golden_count * finding_count AS pairs_judged,
 CASE WHEN golden_count = 0 AND finding_count = 0 THEN 'no goldens and no findings' WHEN finding_count = 0 THEN 'nothing reported' WHEN golden_count = 0 THEN 'no golden comments available' END AS note
FROM (SELECT p.pr_id, coalesce(a.n, 0) AS golden_count, coalesce(b.n, 0) AS finding_count, coalesce(c.g, 0) AS tp_recall, coalesce(c.f, 0) AS tp_precision
 FROM c_prs p LEFT JOIN (SELECT pr_id, count(*) AS n FROM c_gold GROUP BY 1) a USING (pr_id) LEFT JOIN (SELECT pr_id, count(*) AS n FROM c_said GROUP BY 1) b USING (pr_id)
 LEFT JOIN (SELECT pr_id, count(DISTINCT golden_ord) AS g, count(DISTINCT finding_ord) AS f FROM c_sim GROUP BY 1) c USING (pr_id))"""
CTES["c_best"] = """SELECT pr_id, golden_ord, finding_ord, conf FROM (
WITH RECURSIVE c AS (SELECT pr_id, golden_ord, dense_rank() OVER (PARTITION BY pr_id ORDER BY golden_ord) AS seq,
   list({'s': sim, 'f': finding_ord} ORDER BY sim DESC, finding_ord) AS cs FROM c_sim WHERE sim > 0.5 GROUP BY 1, 2),
 w AS (SELECT pr_id, seq, golden_ord, cs[1].f AS finding_ord, cs[1].s AS conf, [cs[1].f] AS used FROM c WHERE seq = 1
  UNION ALL SELECT c.pr_id, c.seq, c.golden_ord, free[1].f, free[1].s, CASE WHEN len(free) > 0 THEN list_append(w.used, free[1].f) ELSE w.used END
  FROM w JOIN c ON c.pr_id = w.pr_id AND c.seq = w.seq + 1, LATERAL (SELECT list_filter(c.cs, lambda x: NOT list_contains(w.used, x.f)) AS free) z)
SELECT * FROM w) WHERE finding_ord IS NOT NULL"""
CTES["c_scsem"] = """SELECT g.pr_id, 'org/repo' || (g.pr_id % 8) AS repo, coalesce(m.n, 0) AS tp, coalesce(f.n, 0) - coalesce(m.n, 0) AS fp, g.n - coalesce(m.n, 0) AS fn
FROM (SELECT pr_id, count(*) AS n FROM c_gold GROUP BY 1) g LEFT JOIN (SELECT pr_id, count(*) AS n FROM c_said GROUP BY 1) f USING (pr_id)
LEFT JOIN (SELECT pr_id, count(*) AS n FROM c_best GROUP BY 1) m USING (pr_id)"""


def hunks(spark, sf):
    return D.hunk_ranges(K.prs(spark, sf, True))


def scored_tables(spark, sf):
    """Issues, goldens and hunks as tables: scoring reads each several times, and here they are derived."""
    issues = K.findings(spark, sf).select("pr_id", "ord", "file", "line", "title", "description", "impact_statement", "evidence", "severity")
    return cut_lineage(issues), cut_lineage(K.expected(spark, sf)), cut_lineage(hunks(spark, sf))


def pairs(spark, sf):
    return S.issue_pairs(*scored_tables(spark, sf))


def scores(spark, sf):
    return S.score_samples(K.prs(spark, sf).select("pr_id"), *scored_tables(spark, sf))


def goldens(spark, sf):
    return K.expected(spark, sf).select("pr_id", "ord", F.col("description").alias("text"))


def said(spark, sf):
    return cut_lineage(gated(spark, sf).select("pr_id", "ord", F.concat("title", F.lit(" "), "description").alias("text")))


def pr_scores(spark, sf):
    return S.score_prs(K.prs(spark, sf), goldens(spark, sf), said(spark, sf))


def best(g, f):
    return S.match_best_confidence(S.confidence_candidates(g, f), g)


def semantic(spark, sf):
    samples = K.prs(spark, sf).select("pr_id", "repo")
    g, f = cut_lineage(goldens(spark, sf)), said(spark, sf)
    return S.score_semantic(samples, g, f, best(g, f))


@query("pairs_issue_expected", "SELECT pr_id, file, issue_ord, expected_ord, is_match, is_review FROM c_pairs")
def _(spark, sf):
    return pairs(spark, sf).select("pr_id", "file", "issue_ord", "expected_ord", "is_match", "is_review")


@query("sc_match", "SELECT pr_id, issue_ord, expected_id FROM c_pairs WHERE is_match")
def _(spark, sf):
    return pairs(spark, sf).where("is_match").select("pr_id", "issue_ord", "expected_id")


@query("sc_near", "SELECT pr_id, issue_ord, expected_id FROM c_pairs WHERE is_review")
def _(spark, sf):
    return pairs(spark, sf).where("is_review").select("pr_id", "issue_ord", "expected_id")


@query("sc_hunk_index", f"SELECT DISTINCT pr_id, file, line, {_hx('f.line')} AS hunk FROM c_find f WHERE {_hx('f.line')} IS NOT NULL")
def _(spark, sf):
    return S.hunk_index(K.findings(spark, sf), hunks(spark, sf))


@query("sc_same_hunk", "SELECT pr_id, issue_ord, expected_ord, coalesce(ih = CASE WHEN hs IS NULL OR hs = 0 THEN he ELSE hs END, false) AS same_hunk FROM c_pairs0 WHERE line IS NOT NULL AND line_start IS NOT NULL")
def _(spark, sf):
    i, e = S.with_hunks(K.findings(spark, sf), K.expected(spark, sf), hunks(spark, sf))
    j = i.select("pr_id", "file", F.col("ord").alias("issue_ord"), "line", "issue_hunk").join(
        e.select("pr_id", "file", F.col("ord").alias("expected_ord"), "line_start", "golden_hunk"), ["pr_id", "file"])
    return j.where("line is not null and line_start is not null").select(
        "pr_id", "issue_ord", "expected_ord", F.coalesce(F.col("issue_hunk") == F.col("golden_hunk"), F.lit(False)).alias("same_hunk"))


@query("sc_severity_ok", "SELECT pr_id, issue_ord, expected_ord, sev FROM c_pairs0")
def _(spark, sf):
    i = K.findings(spark, sf).select("pr_id", "file", F.col("ord").alias("issue_ord"), "severity")
    e = K.expected(spark, sf).select("pr_id", "file", F.col("ord").alias("expected_ord"), F.col("severity").alias("es"))
    return i.join(e, ["pr_id", "file"]).select("pr_id", "issue_ord", "expected_ord", S.severity_ok(F.col("severity"), F.col("es")).alias("sev"))


@query("sc_miss_reason", "SELECT e.pr_id, e.id, coalesce(r.reason, 'not_detected') AS reason FROM c_exp e LEFT JOIN c_reason r ON r.pr_id = e.pr_id AND r.expected_ord = e.ord")
def _(spark, sf):
    return S.miss_reasons(*scored_tables(spark, sf)).select("pr_id", "id", "reason")


@query("match_constrained", "SELECT pr_id, array_to_string(list_sort(matched), ',') AS matched, duplicates FROM c_match")
def _(spark, sf):
    return S.match_constrained(pairs(spark, sf)).select(
        "pr_id", F.array_join(F.array_sort("matched").cast("array<string>"), ",").alias("matched"), "duplicates")


@query("sc_sample", "SELECT *, CASE WHEN expected_total = 0 THEN noise_count ELSE 0 END AS clean_false_positives FROM c_score")
def _(spark, sf):
    return scores(spark, sf)


_SUMS = "expected_total hit_count miss_count review_count noise_count duplicate_count not_detected line_offset severity_miss".split()


@query("sc_totals", "SELECT count(*) AS samples, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in _SUMS)
       + ", sum(CASE WHEN expected_total = 0 THEN noise_count ELSE 0 END)::BIGINT AS clean_false_positives, 0 AS error_count FROM c_score")
def _(spark, sf):
    return S.totals(scores(spark, sf))


@query("set_misses", "SELECT e.pr_id, e.id FROM c_exp e WHERE NOT EXISTS (SELECT 1 FROM c_taken t WHERE t.pr_id = e.pr_id AND t.expected_ord = e.ord)")
def _(spark, sf):
    taken = S.match_constrained(pairs(spark, sf)).select("pr_id", F.explode("matched").alias("ord"))
    return K.expected(spark, sf).join(taken, ["pr_id", "ord"], "left_anti").select("pr_id", "id")


@query("pairs_golden_finding", "SELECT pr_id, golden_count, finding_count, pairs_judged FROM c_scpr")
def _(spark, sf):
    return pr_scores(spark, sf).select("pr_id", "golden_count", "finding_count", "pairs_judged")


@query("sc_pair_judge", "SELECT DISTINCT pr_id, array_to_string(lw, ' ') AS golden_words, array_to_string(rw, ' ') AS finding_words, sim FROM c_sim")
def _(spark, sf):
    def w(d):
        return d.select("pr_id", X.word_set(F.col("text")).alias("words"))

    return similar_sets(w(goldens(spark, sf)), w(said(spark, sf)), ["pr_id"], 0.3).select(
        "pr_id", F.array_join("lw", " ").alias("golden_words"), F.array_join("rw", " ").alias("finding_words"), "sim")


@query("sc_pr", "SELECT * FROM c_scpr")
def _(spark, sf):
    return pr_scores(spark, sf)


@query("sc_f1", """SELECT pr_id, CASE WHEN precision IS NULL OR recall IS NULL THEN NULL WHEN precision + recall = 0 THEN 0.0::DOUBLE
 ELSE round(2 * precision * recall / (precision + recall), 3) END AS f1 FROM c_scpr""")
def _(spark, sf):
    return pr_scores(spark, sf).select("pr_id", S.f1(F.col("precision"), F.col("recall")).alias("f1"))


@query("sc_micro", """SELECT *, round(p, 3) AS precision, round(r, 3) AS recall, CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p + r = 0 THEN 0.0::DOUBLE
 ELSE round(2 * p * r / (p + r), 3) END AS f1 FROM (SELECT count(*) AS total_prs, sum(finding_count)::BIGINT AS total_findings, sum(golden_count)::BIGINT AS total_goldens,
 sum(tp_precision)::BIGINT AS total_tp_precision, sum(tp_recall)::BIGINT AS total_tp_recall, sum(fp)::BIGINT AS total_fp, sum(fn)::BIGINT AS total_fn,
 sum(tp_precision)::DOUBLE / nullif(sum(finding_count), 0)::DOUBLE AS p, sum(tp_recall)::DOUBLE / nullif(sum(golden_count), 0)::DOUBLE AS r FROM c_scpr WHERE golden_count > 0)""".replace(
    "SELECT *, round(p, 3)", "SELECT * EXCLUDE (p, r), round(p, 3)"))
def _(spark, sf):
    return S.micro(pr_scores(spark, sf))


@query("match_best_conf", "SELECT pr_id, golden_ord, finding_ord, conf FROM c_best")
def _(spark, sf):
    return best(goldens(spark, sf), said(spark, sf))


@query("sc_semantic", "SELECT * FROM c_scsem")
def _(spark, sf):
    return semantic(spark, sf)


@query("sc_by_repo", """SELECT repo, tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1 FROM (
 SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS r
 FROM (SELECT repo, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c_scsem GROUP BY 1))""")
def _(spark, sf):
    return S.by_repo(semantic(spark, sf))


@query("sc_run_summary", """SELECT count(*) AS total, count(*) FILTER (bad) AS errors, sum(CASE WHEN NOT bad THEN l_linenumber ELSE 0 END)::BIGINT AS total_issues,
 round(sum(CASE WHEN NOT bad THEN l_quantity ELSE 0 END) / greatest(count(*) FILTER (NOT bad), 1), 6) AS avg_elapsed
FROM (SELECT *, l_returnflag = 'R' AS bad FROM lineitem)""")
def _(spark, sf):
    runs = K.table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "review_failed").alias("error"), F.col("l_linenumber").cast("bigint").alias("issue_count"),
        F.col("l_quantity").alias("elapsed"))
    return S.run_summary(runs).withColumn("avg_elapsed", F.round("avg_elapsed", 6))


CTES["c_labels"] = """SELECT pr_id, severity, coalesce(len(evidence), 0) > 0 AS has_evidence, (['TP', 'FP', 'PARTIAL', 'TP'])[ord % 4 + 1] AS label,
 ord % 6 = 0 AS severity_wrong FROM c_find"""


@query("sc_label_metrics", """SELECT *, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / fp, 9) AS snr, round(w::DOUBLE / n, 9) AS severity_error_rate, round(n::DOUBLE / p, 9) AS avg_comments
FROM (SELECT count(*) FILTER (label = 'TP') AS tp, count(*) FILTER (label = 'FP') AS fp, count(*) FILTER (label = 'PARTIAL') AS partial,
 count(*) FILTER (severity_wrong) AS w, count(*) AS n, count(DISTINCT pr_id) AS p FROM c_labels WHERE severity <> 'INFO' AND has_evidence)""".replace("SELECT *, round(tp", "SELECT * EXCLUDE (w, n, p), round(tp"))
def _(spark, sf):
    labels = K.findings(spark, sf).select(
        "pr_id", "severity", (F.coalesce(F.size("evidence"), F.lit(0)) > 0).alias("has_evidence"),
        K.pick(["TP", "FP", "PARTIAL", "TP"], F.col("ord")).alias("label"), (F.col("ord") % 6 == 0).alias("severity_wrong"))
    m = S.label_metrics(labels)
    for c in ("precision", "snr", "severity_error_rate", "avg_comments"):
        m = m.withColumn(c, F.round(c, 9))
    return m


@query("run_compare", """SELECT pr_id, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) <= 1 AS ok
FROM (SELECT pr_id, count(*) AS n FROM c_find WHERE ord // 7 % 2 = 0 GROUP BY 1) a FULL OUTER JOIN (SELECT pr_id, count(*) AS n FROM c_find WHERE ord // 7 % 2 = 1 GROUP BY 1) b USING (pr_id)""")
def _(spark, sf):
    f = K.findings(spark, sf).withColumn("run", F.expr("ord div 7 % 2"))
    return S.compare_runs(f.where("run = 0"), f.where("run = 1"))


@query("sample_pairs")
def _(spark, sf):
    return S.sample_pairs(goldens(spark, sf), said(spark, sf), 50)
