"""Import checks, scanner joins, replies, judge and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.catalog import ctes as T
from patchlight.catalog.base import CTES, query
from patchlight.catalog.q_diff import lines_of
from patchlight.catalog.q_findings import FRONT, WEAK, gated
from patchlight.catalog.q_graph import diff_groups
from patchlight.functions import columns as X
from patchlight.operators import checks as CK
from patchlight.operators import context as CX
from patchlight.operators import diff as D
from patchlight.operators import findings as O
from patchlight.operators import graph as G
from patchlight.operators import names as N
from patchlight.operators import replies as RP
from patchlight.plans import review as R
from patchlight.session import cut_lineage
from patchlight.sources import carriers as K

CTES["c_ikind"] = """SELECT 'r' || pr_id AS repo, *, CASE WHEN starts_with(module, './') OR starts_with(module, '../') THEN 'relative'
 WHEN starts_with(module, '@/') OR starts_with(module, '~/') OR starts_with(module, '#/') THEN 'alias' ELSE 'package' END AS kind FROM c_imps"""
CTES["c_pkg"] = """SELECT i.pr_id, i.file, i.line, i.module, CASE WHEN m.repo IS NULL THEN 'unknown' WHEN d.section IS NOT NULL THEN 'pass' ELSE 'fail' END AS status,
 CASE WHEN m.repo IS NULL THEN 'package.json not found' WHEN d.section IS NOT NULL THEN d.section ELSE i.pk || ' not declared in package.json' END AS detail, i.statement
FROM (SELECT *, string_split(module, '/')[1] AS pk FROM c_ikind WHERE kind = 'package') i LEFT JOIN (SELECT DISTINCT repo FROM c_deps) m USING (repo)
LEFT JOIN c_deps d ON d.repo = i.repo AND d.package = i.pk"""


def _cands(base: str) -> str:
    exts = C.CHECK_EXTENSIONS
    return "[" + ", ".join([base] + [f"{base} || '{e}'" for e in exts] + [f"{base} || '/index{e}'" for e in exts]) + "]"


CTES["c_relmods"] = "SELECT DISTINCT 'r' || pr_id AS repo, file, module FROM (SELECT pr_id, file, module FROM c_imps UNION SELECT pr_id, file, module FROM c_isyms) WHERE starts_with(module, './')"
CTES["c_reltgt"] = f"""SELECT m.repo, m.file, m.module, t.target FROM c_relmods m LEFT JOIN (SELECT repo, file, module, min_by(c, n) AS target FROM (
 SELECT repo, file, module, unnest({_cands("regexp_extract(file, '^(.*/)', 1) || substr(module, 3)")}) AS c, unnest(range(13)) AS n FROM c_relmods)
 JOIN (SELECT repo, file AS c FROM c_files) USING (repo, c) GROUP BY 1, 2, 3) t USING (repo, file, module)"""
CTES["c_rel"] = """SELECT pr_id, file, line, module, CASE WHEN target IS NOT NULL THEN 'pass' ELSE 'fail' END AS status,
 coalesce(target, module || ' not found from ' || file) AS detail, statement FROM c_ikind JOIN c_reltgt USING (repo, file, module) WHERE kind = 'relative'"""
CTES["c_ali"] = f"""SELECT i.pr_id, i.file, i.line, i.module, CASE WHEN r.repo IS NULL THEN 'unknown' WHEN t.target IS NOT NULL THEN 'pass' ELSE 'fail' END AS status,
 CASE WHEN r.repo IS NULL THEN 'path alias for ' || i.module || ' is not configured' ELSE coalesce(t.target, i.module || ' not found from ' || i.file) END AS detail, i.statement
FROM c_ikind i LEFT JOIN (SELECT DISTINCT repo FROM c_rules WHERE prefix IS NOT NULL) r USING (repo)
LEFT JOIN (SELECT repo, module, min_by(c, n) AS target FROM (
 SELECT repo, module, unnest({_cands('b')}) AS c, t * 100 + unnest(range(13)) AS n FROM (
  SELECT i.repo, i.module, CASE WHEN r.base_url = '.' THEN '' ELSE r.base_url || '/' END || replace(x.p, '*', substr(i.module, length(r.prefix) + 1)) AS b, r.ord * 10 + x.k AS t
  FROM (SELECT DISTINCT repo, module FROM c_ikind WHERE kind = 'alias') i JOIN c_rules r ON r.repo = i.repo AND starts_with(i.module, r.prefix),
  LATERAL (SELECT unnest(string_split(r.targets, ',')) AS p, unnest(range(len(string_split(r.targets, ',')))) AS k) x))
 JOIN (SELECT repo, file AS c FROM c_files) USING (repo, c) GROUP BY 1, 2) t ON t.repo = i.repo AND t.module = i.module WHERE i.kind = 'alias'"""
CTES["c_exp_checks"] = """SELECT s.pr_id, s.file, s.line, s.module, s.symbol, s.statement, CASE WHEN r.target IS NULL THEN 'fail' WHEN n.symbol IS NOT NULL THEN 'pass' ELSE 'fail' END AS status,
 CASE WHEN r.target IS NULL THEN s.module || ' not found from ' || s.file WHEN n.symbol IS NOT NULL THEN 'named export found' ELSE s.symbol || ' is not exported by ' || r.target END AS detail
FROM c_isyms s JOIN c_reltgt r ON r.repo = 'r' || s.pr_id AND r.file = s.file AND r.module = s.module
LEFT JOIN (SELECT DISTINCT repo, file, symbol FROM c_exports) n ON n.repo = r.repo AND n.file = r.target AND n.symbol = s.symbol"""
CTES["c_ichecks"] = "SELECT * FROM c_rel UNION ALL SELECT * FROM c_ali UNION ALL SELECT * FROM c_pkg"


def refs(spark, sf, lines=None):
    lines = lines_of(spark, sf, True) if lines is None else lines
    return N.js_imports(lines).withColumn("repo", F.concat(F.lit("r"), F.col("pr_id").cast("string")))


def symbol_refs(spark, sf, lines=None):
    lines = lines_of(spark, sf, True) if lines is None else lines
    return N.js_symbols(lines).withColumn("repo", F.concat(F.lit("r"), F.col("pr_id").cast("string")))


def rules(spark, sf):
    return N.alias_rules(K.alias_configs(spark, sf), ["repo"])


def deps(spark, sf):
    return N.dependencies(K.manifests(spark, sf), ["repo"])


def repo_files(spark, sf):
    return K.source_files(spark, sf).select("repo", "file")


def exports(spark, sf):
    return N.js_exports(K.source_files(spark, sf), ["repo", "file"])


def import_checks(spark, sf):
    return CK.import_checks(refs(spark, sf), deps(spark, sf), K.manifests(spark, sf), rules(spark, sf), repo_files(spark, sf))


def export_checks(spark, sf):
    return CK.export_checks(symbol_refs(spark, sf), exports(spark, sf), rules(spark, sf), repo_files(spark, sf))


def both_checks(spark, sf):
    # Diffs are split once for both kinds of references.
    lines = cut_lineage(N.import_lines(lines_of(spark, sf, True)))
    return CK.verify_changes(refs(spark, sf, lines), symbol_refs(spark, sf, lines), deps(spark, sf), K.manifests(spark, sf), rules(spark, sf), exports(spark, sf), repo_files(spark, sf))


OUT = ["pr_id", "file", "line", "module", "status", "detail"]


@query("import_kind", "SELECT pr_id, file, line, module, kind FROM c_ikind")
def _(spark, sf):
    return refs(spark, sf).select("pr_id", "file", "line", "module", N.import_kind(F.col("module")).alias("kind"))


@query("join_package_dep", "SELECT pr_id, file, line, module, status, detail FROM c_pkg")
def _(spark, sf):
    r = refs(spark, sf).where(N.import_kind(F.col("module")) == "package")
    return CK.package_checks(r, deps(spark, sf), K.manifests(spark, sf)).select(*OUT)


@query("join_relative_import", "SELECT pr_id, file, line, module, status, detail FROM c_rel")
def _(spark, sf):
    r = refs(spark, sf).where(N.is_relative(F.col("module")))
    t = CK.relative_targets(r.select("repo", "file", "module").distinct(), repo_files(spark, sf))
    return r.join(t, ["repo", "file", "module"]).select(*OUT)


@query("join_alias_import", "SELECT pr_id, file, line, module, status, detail FROM c_ali")
def _(spark, sf):
    r = refs(spark, sf).where(N.is_alias(F.col("module")))
    t = CK.alias_targets(r.select("repo", "file", "module").distinct(), rules(spark, sf), repo_files(spark, sf))
    return r.join(t, ["repo", "file", "module"]).select(*OUT)


@query("join_export_check", "SELECT pr_id, file, line, module, symbol, status, detail FROM c_exp_checks")
def _(spark, sf):
    return export_checks(spark, sf).select("pr_id", "file", "line", "module", "symbol", "status", "detail")


@query("verify_diff_imports", """SELECT 'import' AS check_kind, pr_id, file, line, module, NULL AS symbol, status, detail FROM c_ichecks
UNION ALL SELECT 'export', pr_id, file, line, module, symbol, status, detail FROM c_exp_checks""")
def _(spark, sf):
    imp, exp = both_checks(spark, sf)
    a = imp.select(F.lit("import").alias("check_kind"), "pr_id", "file", "line", "module", F.lit(None).cast("string").alias("symbol"), "status", "detail")
    b = exp.select(F.lit("export").alias("check_kind"), "pr_id", "file", "line", "module", "symbol", "status", "detail")
    return a.unionByName(b)


CTES["c_vfind"] = """SELECT pr_id, file, line, 'Unresolved import' AS title, trim('The import `' || module || '` cannot be resolved. ' || detail) AS description,
 'Importing ' || module || ' fails at build time.' AS impact_statement, statement FROM c_ichecks WHERE status = 'fail' UNION ALL
SELECT pr_id, file, line, 'Missing named export', trim('The symbol `' || symbol || '` is not exported by `' || module || '`. ' || detail),
 'Importing ' || symbol || ' from ' || module || ' fails at build time.', statement FROM c_exp_checks WHERE status = 'fail'"""


def check_findings(spark, sf):
    return CK.check_findings(*both_checks(spark, sf))


@query("fn_verif_findings", "SELECT pr_id, file, line, title, description, impact_statement, 'ERROR' AS severity, 1.0::DOUBLE AS confidence, statement AS evidence FROM c_vfind")
def _(spark, sf):
    return check_findings(spark, sf).select("pr_id", "file", "line", "title", "description", "impact_statement", "severity", "confidence",
                                            F.col("evidence")[0].alias("evidence"))


CTES["c_scan"] = """SELECT pr_id, ord, 'lang.rules.' || lower(replace(title, ' ', '-')) AS check_id,
 CASE WHEN ord % 31 = 0 THEN '/other/' || file WHEN ord % 3 = 0 THEN '/work/repo/' || file ELSE file END AS path,
 coalesce(line, 0) AS start_line, (coalesce(line, 0) + ord % 4)::INT AS end_line, description AS message, CASE WHEN ord % 5 = 0 THEN 'NOTE' ELSE severity END AS severity FROM c_find"""
CTES["c_scanp"] = """SELECT * EXCLUDE (path), CASE WHEN starts_with(path, '/work/repo/') THEN substr(path, 12) ELSE path END AS file FROM c_scan WHERE NOT starts_with(path, '/') OR starts_with(path, '/work/repo/')"""
CTES["c_shits"] = """SELECT pr_id, file, start_line, end_line, check_id, any_value(ord) AS ord, any_value(message) AS message, any_value(severity) AS severity,
 min(new_line) AS line, min_by(text, new_line) AS text FROM (
 SELECT s.*, l.new_line, '+' || l.text AS text FROM (SELECT * FROM c_scanp WHERE start_line > 0 QUALIFY row_number() OVER (PARTITION BY pr_id, file, start_line, end_line, check_id ORDER BY ord) = 1) s
 JOIN c_clines l ON l.pr_id = s.pr_id AND l.file = s.file AND l.kind = 'add' AND l.new_line BETWEEN s.start_line AND s.end_line) GROUP BY 1, 2, 3, 4, 5"""


def scan_rows(spark, sf):
    o = F.col("ord")
    return K.findings(spark, sf).select(
        "pr_id", "ord", F.concat(F.lit("lang.rules."), F.lower(F.replace("title", F.lit(" "), F.lit("-")))).alias("check_id"),
        F.when(o % 31 == 0, F.concat(F.lit("/other/"), "file")).when(o % 3 == 0, F.concat(F.lit("/work/repo/"), "file")).otherwise(F.col("file")).alias("path"),
        F.coalesce("line", F.lit(0)).alias("start_line"), (F.coalesce("line", F.lit(0)) + o % 4).cast("int").alias("end_line"),
        F.col("description").alias("message"), F.when(o % 5 == 0, "NOTE").otherwise(F.col("severity")).alias("severity"))


def scan_hits(spark, sf):
    rows = CK.scan_paths(scan_rows(spark, sf), F.lit("/work/repo"))
    return CK.scan_hits(rows, D.added_numbered(K.prs(spark, sf, True).select("pr_id", "diff")))


@query("join_scan_path", "SELECT ord, file AS path FROM c_scanp")
def _(spark, sf):
    return CK.scan_paths(scan_rows(spark, sf), F.lit("/work/repo")).select("ord", "path")


@query("join_scan_diff", "SELECT pr_id, file, ord, check_id, start_line, end_line, line, text FROM c_shits")
def _(spark, sf):
    return scan_hits(spark, sf).select("pr_id", "file", "ord", "check_id", "start_line", "end_line", "line", "text")


@query("fn_scan_findings", """SELECT pr_id, file, line, string_split(check_id, '.')[-1] AS title, message AS description, CASE WHEN severity IN ('ERROR','WARNING','INFO') THEN severity ELSE 'WARNING' END AS severity,
 0.95::DOUBLE AS confidence, 'security_risk' AS impact_type, text AS evidence FROM c_shits""")
def _(spark, sf):
    return CK.scan_findings(scan_hits(spark, sf), "security").select("pr_id", "file", "line", "title", "description", "severity", "confidence", "impact_type",
                                                                    F.col("evidence")[0].alias("evidence"))


CTES["c_claims"] = f"""SELECT pr_id, {T.doc_file()} AS file, {T.pick(['module', 'cache', 'declared', 'handler'], 'doc_id')} AS module,
 {T.pick(['Symbol', 'Member', 'target'], 'doc_id')} AS symbol, CASE WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'fail' END AS status FROM c_docs"""


def claims(spark, sf):
    d = F.col("doc_id")
    return K.table(spark, sf, "documents").select(
        F.floor(d / 4).alias("pr_id"), K.doc_file().alias("file"), K.pick(["module", "cache", "declared", "handler"], d).alias("module"),
        K.pick(["Symbol", "Member", "target"], d).alias("symbol"), F.when(d % 2 == 0, "pass").otherwise("fail").alias("status"))


def _claimed(src: str) -> tuple[str, str]:
    imp = f"""({T.any_word(T.FTEXT, C.IMPORT_CLAIMS)} AND EXISTS (SELECT 1 FROM c_claims c WHERE c.status = 'pass' AND c.pr_id = {src}.pr_id AND c.file = {src}.file AND contains({T.FTEXT}, c.module)))"""
    exp = f"""({T.any_word(T.FTEXT, C.EXPORT_CLAIMS)} AND EXISTS (SELECT 1 FROM c_claims c WHERE c.status = 'pass' AND c.pr_id = {src}.pr_id AND c.file = {src}.file AND contains({T.FTEXT}, lower(c.symbol))))"""
    return imp, exp


_IMP, _EXP = _claimed("f")


@query("anti_import_claim", f"SELECT ord FROM c_find f WHERE NOT {_IMP}")
def _(spark, sf):
    return O.drop_import_claims(K.findings(spark, sf), claims(spark, sf)).select("ord")


@query("anti_export_claim", f"SELECT ord FROM c_find f WHERE NOT {_EXP}")
def _(spark, sf):
    return O.drop_export_claims(K.findings(spark, sf), claims(spark, sf)).select("ord")


CTES["c_judged"] = f"""SELECT * FROM (SELECT f.* EXCLUDE (category), coalesce(g.guessed, f.category) AS category FROM c_sem f JOIN c_guess g USING (ord) WHERE NOT {_IMP} AND NOT {_EXP})
WHERE confidence >= 0.7 AND severity IN ('ERROR', 'WARNING') AND NOT {FRONT} AND NOT {WEAK} AND coalesce(lower(trim(impact_type)) IN {T.in_list(C.IMPACT_TYPES)}, false)
 AND trim(coalesce(impact_statement, '')) <> ''"""
CTES["c_jgate"] = T.CTES["c_gate"].replace("c_find", "c_judged")


def judged(spark, sf):
    c = claims(spark, sf)
    return R.judge(K.findings(spark, sf), c, c)


@query("judge_rollup", "SELECT pr_id, ord, file, line, category, severity FROM c_judged")
def _(spark, sf):
    return judged(spark, sf).select("pr_id", "ord", "file", "line", "category", "severity")


CTES["c_impact"] = """SELECT f.pr_id, t.caller_file AS file, t.caller_start AS line, 'Cross-file impact: ' || f.title AS title,
 'The issue in `' || t.changed_fn || '` propagates to caller `' || t.caller_name || '`: calls ' || t.name AS description,
 CASE f.severity WHEN 'ERROR' THEN 'WARNING' ELSE 'INFO' END AS severity, least(f.confidence * 0.85::DOUBLE, 0.9::DOUBLE) AS confidence, 'calls ' || t.name AS evidence
FROM {src} f JOIN c_top3 t ON t.pr_id = f.pr_id AND t.ffile = f.file WHERE f.severity = 'ERROR'"""
CTES["c_jimpact"] = CTES["c_impact"].replace("{src}", "c_jgate")
CTES["c_impact"] = CTES["c_impact"].replace("{src}", "c_gate")


def impacts(found, spark, sf):
    p = G.finding_callers(found, diff_groups(spark, sf), ["caller_file", "caller_start"])
    return R.impact_findings(p, F.when(F.col("severity") == "ERROR", F.concat(F.lit("calls "), "name")))


@query("fn_impact_findings", "SELECT pr_id, file, line, title, description, severity, round(confidence, 9) AS confidence, evidence FROM c_impact")
def _(spark, sf):
    return impacts(gated(spark, sf), spark, sf).select("pr_id", "file", "line", "title", "description", "severity", F.round("confidence", 9).alias("confidence"),
                                                       F.col("evidence")[0].alias("evidence"))


@query("fn_caller_findings", """SELECT pr_id, caller_file AS file, caller_start AS line, 'Caller passes invalid argument to `' || name || '` (arg: `a`)' AS title,
 '`' || caller_name || '` in `' || caller_file || '` calls `' || name || '` with a value the function does not handle: may be null' AS description,
 'Calling `' || name || '` with this argument may cause a runtime error.' AS impact_statement, 0.75::DOUBLE AS confidence FROM c_newcallers""")
def _(spark, sf):
    return R.caller_findings(diff_groups(spark, sf), F.lit("may be null"), F.lit("a")).select(
        "pr_id", "file", "line", "title", "description", "impact_statement", "confidence")


@query("set_union_sources", """SELECT source_no, count(*) AS n, count(DISTINCT pr_id) AS prs FROM (SELECT 0 AS source_no, pr_id FROM c_find UNION ALL SELECT 1, pr_id FROM c_shits
UNION ALL SELECT 2, pr_id FROM c_vfind) GROUP BY 1""")
def _(spark, sf):
    u = R.union_sources(K.findings(spark, sf), CK.scan_findings(scan_hits(spark, sf), "security"), check_findings(spark, sf))
    return u.groupBy("source_no").agg(F.count("*").alias("n"), F.countDistinct("pr_id").alias("prs"))


@query("set_files_overlap", """SELECT DISTINCT g.pr_id, g.file FROM c_gate g WHERE EXISTS (SELECT 1 FROM c_newcallers n WHERE n.pr_id = g.pr_id AND regexp_extract(n.changed_fn, '^(.*):[^:]*$', 1) = g.file)""")
def _(spark, sf):
    blast_files = diff_groups(spark, sf).select("pr_id", F.regexp_extract("changed_fn", r"^(.*):[^:]*$", 1).alias("file"))
    return gated(spark, sf).select("pr_id", "file").intersect(blast_files)


#: A reviewer per change and category; how its run ended hangs on its last finding.
CTES["c_agents"] = """SELECT pr_id, category AS agent, list_position(['security', 'performance', 'quality'], category) AS place,
 CASE max(ord) % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'format_error' ELSE 'success' END AS status, count(*) || ' findings' AS error_message FROM c_find GROUP BY pr_id, category"""
CTES["c_failures"] = """SELECT a.pr_id, count(*) FILTER (status <> 'success') AS failed, count(*) FILTER (status = 'success') = 0 AND any_value(d.pr_id) IS NULL AS aborted,
 string_agg(agent || '(' || status || ': ' || error_message || ')', '; ' ORDER BY place) FILTER (status <> 'success') AS notes
FROM c_agents a LEFT JOIN (SELECT pr_id FROM c_shits UNION SELECT pr_id FROM c_vfind) d ON d.pr_id = a.pr_id GROUP BY a.pr_id"""


def reviewers(spark, sf):
    place = F.array_position(F.array(*[F.lit(c) for c in ("security", "performance", "quality")]), F.col("category"))
    runs = K.findings(spark, sf).groupBy("pr_id", "category").agg(F.max("ord").alias("_last"), F.count("*").alias("_n"))
    return runs.select(
        "pr_id", F.col("category").alias("agent"), place.alias("place"),
        F.when(F.col("_last") % 4 == 0, "timeout").when(F.col("_last") % 4 == 1, "format_error").otherwise("success").alias("status"),
        F.concat(F.col("_n").cast("string"), F.lit(" findings")).alias("error_message"))


@query("agents_failed", "SELECT pr_id, failed, aborted, CASE WHEN aborted THEN 'no reviewer succeeded: ' || notes END AS error FROM c_failures")
def _(spark, sf):
    found = CK.scan_findings(scan_hits(spark, sf), "security").select("pr_id").unionByName(check_findings(spark, sf).select("pr_id"))
    return R.reviewer_failures(reviewers(spark, sf), found)


@query("review_input", """SELECT source_no, pr_id, count(*) AS n FROM (
 SELECT 0 AS source_no, f.pr_id FROM c_find f JOIN c_agents a ON a.pr_id = f.pr_id AND a.agent = f.category AND a.status = 'success'
 UNION ALL SELECT 1, pr_id FROM c_shits UNION ALL SELECT 2, pr_id FROM c_vfind) GROUP BY 1, 2""")
def _(spark, sf):
    said = K.findings(spark, sf).withColumn("agent", F.col("category"))
    joined, _fails = R.review_input(said, reviewers(spark, sf), CK.scan_findings(scan_hits(spark, sf), "security"), check_findings(spark, sf))
    return joined.groupBy("source_no", "pr_id").agg(F.count("*").alias("n"))


CTES["c_asm"] = """SELECT p.pr_id, p.title AS summary, len(p.files) AS files_changed, coalesce(b.n, 0) AS before_gate, coalesce(a.n, 0) AS after_gate,
 coalesce(a.e, 0) AS n_error, coalesce(a.w, 0) AS n_warning, coalesce(a.i, 0) AS n_info
FROM c_prs p LEFT JOIN (SELECT pr_id, count(*) AS n FROM c_judged GROUP BY 1) b USING (pr_id)
LEFT JOIN (SELECT pr_id, count(*) AS n, count(*) FILTER (severity = 'ERROR') AS e, count(*) FILTER (severity = 'WARNING') AS w, count(*) FILTER (severity = 'INFO') AS i
 FROM (SELECT pr_id, severity FROM c_jgate UNION ALL SELECT pr_id, severity FROM c_jimpact) GROUP BY 1) a USING (pr_id)"""


@query("assemble_review", """SELECT *, before_gate - after_gate AS filtered, CASE WHEN n_error > 0 THEN 'HIGH' WHEN n_warning > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 CASE WHEN after_gate = 0 THEN 'APPROVE' WHEN n_error > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS merge_recommendation FROM c_asm""")
def _(spark, sf):
    lines = lines_of(spark, sf, True)
    return R.assemble(K.prs(spark, sf), lines, judged(spark, sf), lambda found: impacts(found, spark, sf))[1]


CTES["c_defs"] = r"""SELECT s.pr_id, s.symbol, s.ord, d.file, d.line, d.snippet, length(d.snippet) // 4 AS tokens, b.budget, row_number() OVER (PARTITION BY s.pr_id ORDER BY s.ord, s.symbol) AS seq
FROM (SELECT * FROM c_syms QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY ord, symbol) <= 10) s JOIN (SELECT pr_id, length(diff) // 4 // 2 AS budget FROM c_cprs) b USING (pr_id)
JOIN (SELECT pr_id, symbol, file, line, '// ' || symbol || ' defined in ' || file || ':' || line || chr(10) ||
  (SELECT string_agg((greatest(line - 3, 0) + i) || ':' || x, chr(10) ORDER BY i) FROM (SELECT unnest(rs[greatest(line - 3, 0) + 1 : least(len(rs), line + 5)]) AS x, unnest(range(1, least(len(rs), line + 5) - greatest(line - 3, 0) + 1)) AS i)) AS snippet
 FROM (SELECT pr_id, symbol, file, rs, list_position(list_transform(rs, lambda x: regexp_matches(x, '\b' || symbol || '\b')), true) AS line FROM (
  SELECT w.pr_id, w.symbol, f.file, string_split(f.content, chr(10)) AS rs FROM (SELECT pr_id, symbol, min(file) AS file FROM (
    SELECT f.pr_id, f.file, s.symbol FROM (SELECT pr_id, file, unnest(list_distinct(regexp_extract_all(content, '\w+'))) AS symbol FROM c_files) f JOIN c_syms s USING (pr_id, symbol)) GROUP BY 1, 2) w
  JOIN c_files f USING (pr_id, file)))) d ON d.pr_id = s.pr_id AND d.symbol = s.symbol"""
CTES["c_defs_taken"] = """SELECT pr_id, symbol, file, line, snippet, tokens FROM (
WITH RECURSIVE w AS (SELECT *, CASE WHEN tokens <= budget THEN tokens ELSE 0 END AS used, tokens <= budget AS took FROM c_defs WHERE seq = 1
 UNION ALL SELECT d.*, CASE WHEN w.used + d.tokens <= d.budget THEN w.used + d.tokens ELSE w.used END, w.used + d.tokens <= d.budget FROM w JOIN c_defs d ON d.pr_id = w.pr_id AND d.seq = w.seq + 1)
SELECT * FROM w WHERE took)"""


def definitions(spark, sf):
    prs = K.prs(spark, sf, True)
    syms = N.diff_symbols(D.diff_lines(prs.select("pr_id", "diff"))).withColumn("repo", F.concat(F.lit("r"), F.col("pr_id").cast("string")))
    budgets = prs.select("pr_id", F.floor(X.tokens(F.col("diff")) / 2).cast("bigint").alias("budget"))
    return CX.symbol_definitions(syms, K.source_files(spark, sf).select("repo", "file", "content"), budgets)


@query("join_symbol_defs", "SELECT pr_id, symbol, file, line::INT AS line, snippet FROM c_defs_taken")
def _(spark, sf):
    return definitions(spark, sf).select("pr_id", "symbol", "file", "line", "snippet")


@query("budget_skip", "SELECT pr_id, count(*) AS taken, sum(tokens)::BIGINT AS used FROM c_defs_taken GROUP BY 1")
def _(spark, sf):
    return definitions(spark, sf).groupBy("pr_id").agg(F.count("*").alias("taken"), F.sum("tokens").alias("used"))


# --- replies ------------------------------------------------------------------------------
_ITEM = """'{"file":"f' || conv_id || '.py","line":' || (turn + 1) || ',"title":"t' || turn || '","description":"d","severity":"' || (['ERROR','WARNING'])[turn % 2 + 1] || '","confidence":0.5,"category":"quality"}'"""
_PLAIN = "replace(replace(replace(text, '<', '&lt;'), '{', '&#123;'), '}', '&#125;')"
CTES["c_reply"] = f"""SELECT conv_id, turn, text, '<think>' || text || '</think> note ' || '{{"findings":[' || {_ITEM} || ',{{"file":"x"}}]' || CASE WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE '}}' END AS reply
FROM (SELECT conv_id, turn, {_PLAIN} AS text FROM conversations WHERE role = 'assistant')"""


def replies(spark, sf):
    t = F.col("turn")
    item = F.concat(F.lit('{"file":"f'), F.col("conv_id").cast("string"), F.lit('.py","line":'), (t + 1).cast("string"), F.lit(',"title":"t'), t.cast("string"),
                    F.lit('","description":"d","severity":"'), K.pick(["ERROR", "WARNING"], t), F.lit('","confidence":0.5,"category":"quality"}'))
    return K.table(spark, sf, "conversations").where("role = 'assistant'").withColumn("text", F.expr(_PLAIN)).select(
        "conv_id", "turn", F.concat(F.lit("<think>"), "text", F.lit("</think> note "), F.lit('{"findings":['), item, F.lit(',{"file":"x"}]'),
                                    F.when((F.col("conv_id") + t) % 7 == 0, "").otherwise("}")).alias("reply"))


@query("fn_parse_response", """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'format_error' ELSE 'success' END AS status, trim(text, e' \\t\\r\\n') AS thinking,
 CASE WHEN (conv_id + turn) % 7 = 0 THEN NULL ELSE 'f' || conv_id || '.py' END AS file, CASE WHEN (conv_id + turn) % 7 = 0 THEN NULL ELSE (['ERROR','WARNING'])[turn % 2 + 1] END AS severity FROM c_reply""")
def _(spark, sf):
    status, rows = RP.parse_reviews(replies(spark, sf))
    return status.join(rows.select("conv_id", "turn", "file", "severity"), ["conv_id", "turn"], "left")


@query("fn_split_stream_reply", """SELECT conv_id, turn, trim(text, e' \\t\\r\\n') AS thinking, trim(regexp_replace(reply, '(?s)^.*?</think>', '')) AS result FROM c_reply""")
def _(spark, sf):
    return replies(spark, sf).select("conv_id", "turn", RP.thinking(F.col("reply")).alias("thinking"), RP.result_part(F.col("reply")).alias("result"))


def fenced(spark, sf):
    t = F.col("turn")
    body = F.concat(F.lit('[{"line":'), t.cast("string"), F.lit(',"severity":"'), K.pick(["High", "info", "ERROR", "odd"], F.col("conv_id")), F.lit('","title":"T'), t.cast("string"),
                    F.lit('"},{"title":"x","description":"y"}]'))
    return K.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("ok ```json\n"), body, F.lit("\n``` bye"))).otherwise(body).alias("reply"))


_FENCED = """(SELECT conv_id, turn, '[{"line":' || turn || ',"severity":"' || (['High','info','ERROR','odd'])[conv_id % 4 + 1] || '","title":"T' || turn || '"},{"title":"x","description":"y"}]' AS body FROM conversations)"""


@query("fn_extract_json", f"SELECT conv_id, turn, body AS json FROM {_FENCED}")
def _(spark, sf):
    return fenced(spark, sf).select("conv_id", "turn", RP.extract_json(F.col("reply")).alias("json"))


@query("fn_parse_baseline", f"""SELECT conv_id, turn, 0 AS ord, turn::INT AS line, '[' || (['High','Low','High','Medium'])[conv_id % 4 + 1] || '] T' || turn || chr(10) || chr(10) AS body FROM {_FENCED}
UNION ALL SELECT conv_id, turn, 1, NULL, '[Medium] x' || chr(10) || chr(10) || 'y' FROM {_FENCED}""")
def _(spark, sf):
    return RP.parse_baseline(fenced(spark, sf))


@query("fn_first_array", "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE turn || ',7' END AS kept FROM conversations")
def _(spark, sf):
    t = F.col("turn").cast("string")
    reply = F.when(F.col("conv_id") % 3 == 0, "no array").otherwise(F.concat(
        F.lit('text [{"keep_index": '), t, F.lit(', "duplicate_indices": [3, 4]}, {"keep_index": 7}] end')))
    return K.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(RP.keep_indices(reply).cast("array<string>"), ",").alias("kept"))


@query("fn_verdict_filter", """SELECT pr_id, ord FROM (SELECT pr_id, ord, ord // (SELECT max(doc_id) // 4 + 1 FROM documents) + 1 AS idx FROM c_find)
WHERE pr_id % 3 <> 0 OR idx IN (1, 3, 8)""")
def _(spark, sf):
    n = K.table(spark, sf, "documents").select(F.floor(F.max("doc_id") / 4) + 1).scalar()
    issues = K.findings(spark, sf).select("pr_id", "ord", (F.floor(F.col("ord") / n) + 1).cast("int").alias("idx"))
    reply = F.when(F.col("pr_id") % 3 == 0, '```json\n[{"index":1,"verdict":"CONFIRM"},{"index":2,"verdict":"REJECT"},{"index":3,"verdict":"CONFIRM"},{"index":8,"verdict":"CONFIRM"}]\n```').when(
        F.col("pr_id") % 3 == 1, '[{"index":2,"verdict":"REJECT"}]').otherwise("not json")
    return RP.confirmed(issues, K.prs(spark, sf).select("pr_id", reply.alias("reply"))).select("pr_id", "ord")


@query("fn_prompt", f"""SELECT pr_id, '{RP.PERSPECTIVES['security']}' AS system, 'Title: ' || title || chr(10) || 'Description: ' || left(description, 500) || chr(10) || 'Files: ' || array_to_string(files[1:20], ', ')
 || chr(10) || 'Diff:' || chr(10) || left(diff, 40000) AS prompt FROM c_prs""")
def _(spark, sf):
    return RP.prompts(K.prs(spark, sf), RP.perspective(F.lit("security"), F.lit("default")))


@query("model_stage", "SELECT pr_id, CASE WHEN n <= 4000 THEN n ELSE 0 END AS tokens, CASE WHEN n > 4000 THEN 'Budget exceeded: ' || n || ' > 4000' END AS error, CASE WHEN n > 4000 THEN NULL ELSE '{\"findings\":[]}' END AS reply FROM (SELECT pr_id, length('Title: ' || title || chr(10) || 'Description: ' || left(description, 500) || chr(10) || 'Files: ' || array_to_string(files[1:20], ', ') || chr(10) || 'Diff:' || chr(10) || left(diff, 40000)) // 4 AS n FROM c_prs)")
def _(spark, sf):
    return RP.run_reviewers(RP.prompts(K.prs(spark, sf), F.lit("default")), max_tokens=4000)
