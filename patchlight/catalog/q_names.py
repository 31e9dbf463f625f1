"""Name, import and export extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.catalog import ctes as T
from patchlight.catalog.base import CTES, ORACLE, query
from patchlight.catalog.q_diff import lines_of
from patchlight.functions import columns as X
from patchlight.operators import code as CD
from patchlight.operators import names as N
from patchlight.sources import carriers as K


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def first(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{q(pattern)}', {group}), '')"


STRIP = r"' ' || chr(9) || chr(13)"
_DEFINED = f"""SELECT DISTINCT pr_id, name FROM (SELECT pr_id, unnest([{{p}}]) AS name FROM c_clines WHERE kind = 'add')
WHERE name IS NOT NULL AND name NOT IN {T.in_list(C.NOT_FUNCTIONS)} AND length(name) > 1"""
_P3 = ", ".join(first("text", p) for p in (N.PY_DEF, N.JS_FUNCTION, N.JS_ARROW))
CTES["c_newfns"] = _DEFINED.format(p=_P3)
CTES["c_chfns"] = _DEFINED.format(p=_P3 + ", " + first("text", N.JS_METHOD))


@query("fn_changed_functions", "SELECT pr_id, name FROM c_chfns")
def _(spark, sf):
    return N.changed_functions(lines_of(spark, sf, True))


@query("fn_new_functions", "SELECT pr_id, name FROM c_newfns")
def _(spark, sf):
    return N.new_functions(lines_of(spark, sf, True))


_SYM = ", ".join(f"{{'s': {first('text', p)}, 'c': false}}" for p in N.SYMBOL_IMPORTS) + f", {{'s': {first('text', N.SYMBOL_CALL)}, 'c': true}}"
CTES["c_syms"] = f"""SELECT pr_id, r.s AS symbol, min(pos) AS ord FROM (SELECT pr_id, pos, unnest([{_SYM}]) AS r FROM c_clines WHERE kind = 'add')
WHERE r.s IS NOT NULL AND r.s NOT IN {T.in_list(C.BUILTIN_SYMBOLS)} AND NOT (r.c AND r.s IN {T.in_list(C.NOT_CALLS)}) GROUP BY 1, 2"""


@query("fn_diff_symbols", "SELECT pr_id, symbol, ord FROM c_syms")
def _(spark, sf):
    return N.diff_symbols(lines_of(spark, sf, True)).withColumn("ord", F.col("ord").cast("bigint"))


CTES["c_imps"] = f"""SELECT pr_id, file, new_line AS line, coalesce({first('text', N.JS_IMPORT)}, {first('text', N.JS_REQUIRE)}, {first('text', N.JS_DYNAMIC)}) AS module,
 trim(text, {STRIP}) AS statement FROM c_clines WHERE kind = 'add' AND coalesce({first('text', N.JS_IMPORT)}, {first('text', N.JS_REQUIRE)}, {first('text', N.JS_DYNAMIC)}) IS NOT NULL"""
CTES["c_isyms"] = f"""SELECT pr_id, file, line, module, trim(regexp_replace(regexp_replace(trim(p), '(?s)\\s+as\\s+.*$', ''), '^type ', '')) AS symbol, statement FROM (
 SELECT pr_id, file, new_line AS line, {first('text', N.JS_NAMED, 2)} AS module, unnest(string_split({first('text', N.JS_NAMED, 1)}, ',')) AS p, trim(text) AS statement
 FROM c_clines WHERE kind = 'add') WHERE (starts_with(module, './') OR starts_with(module, '../') OR starts_with(module, '@/') OR starts_with(module, '~/') OR starts_with(module, '#/')) AND trim(p) <> ''"""


@query("fn_js_imports", "SELECT pr_id, file, line, module, statement FROM c_imps")
def _(spark, sf):
    return N.js_imports(lines_of(spark, sf, True))


@query("fn_js_symbols", "SELECT pr_id, file, line, module, symbol, 'named' AS import_kind, statement FROM c_isyms")
def _(spark, sf):
    return N.js_symbols(lines_of(spark, sf, True))


CTES["c_exports"] = f"""SELECT repo, file, regexp_matches(content, '{q(N.EXPORT_STAR)}') AS has_star, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS symbol
FROM (SELECT repo, file, content, list_distinct(list_concat(regexp_extract_all(content, '{q(N.EXPORT_DECLARED)}', 1),
 list_filter(list_transform(flatten(list_transform(regexp_extract_all(content, '{q(N.EXPORT_BRACES)}', 1), lambda b: string_split(b, ','))),
  lambda p: trim(regexp_replace(trim(p), '(?s)^.*?\\s+as\\s+', ''))), lambda s: s <> ''))) AS s FROM c_files)"""


@query("fn_js_exports", "SELECT repo, file, has_star, symbol FROM c_exports")
def _(spark, sf):
    return N.js_exports(K.source_files(spark, sf), ["repo", "file"])


@query("fn_py_imports", r"""SELECT repo, file, coalesce(nullif(regexp_extract(part, '^.+?\s+as\s+(\S+)', 1), ''), part) AS name, source_file FROM (
 SELECT repo, file, replace(m, '.', '/') || '.py' AS source_file, trim(regexp_replace(trim(unnest(string_split(n, ','))), '^\)+|\)+$', '', 'g')) AS part FROM (
  SELECT repo, file, regexp_extract(r, '^from\s+(\S+)\s+import\s+(.+)$', 1) AS m, trim(regexp_extract(r, '^from\s+(\S+)\s+import\s+(.+)$', 2)) AS n
  FROM (SELECT repo, file, unnest(string_split(content, chr(10))) AS r FROM c_files)) WHERE m <> '')
WHERE part <> '' UNION ALL
SELECT repo, file, coalesce(nullif(regexp_extract(part, '^.+?\s+as\s+(\S+)', 1), ''), part),
 replace(trim(coalesce(nullif(regexp_extract(part, '^(.+?)\s+as\s+\S+', 1), ''), part)), '.', '/') || '.py' FROM (
 SELECT repo, file, trim(unnest(string_split(regexp_extract(r, '^import\s+(.+)$', 1), ','))) AS part
 FROM (SELECT repo, file, unnest(string_split(content, chr(10))) AS r FROM c_files)) WHERE part <> ''""")
def _(spark, sf):
    return N.py_imports(K.source_files(spark, sf), ["repo", "file"])


_CAND = "[{b}, " + ", ".join("{b} || '" + e + "'" for e in C.INDEX_EXTENSIONS) + ", " + ", ".join("{b} || '/index" + e + "'" for e in C.INDEX_EXTENSIONS) + "]"


@query("fn_ts_imports", f"""SELECT repo, file, name, min_by(c, n) AS source_file FROM (
 SELECT i.repo, i.file, i.module, i.name, unnest({_CAND.replace('{b}', "regexp_extract(i.file, '^(.*/)', 1) || substr(i.module, 3)")}) AS c, unnest(range(9)) AS n FROM (
  SELECT repo, file, module, regexp_replace(trim(p), '^(\\w+)\\s+as\\s+(\\w+).*$', '\\2') AS name FROM (
   SELECT repo, file, unnest(string_split(m.spec, ',')) AS p, m.module AS module FROM (
    SELECT repo, file, unnest(list_transform(regexp_extract_all(content, '\\bimport\\s+\\{{[^}}]*\\}}\\s+from\\s+"\\./[^"]+"'),
     lambda x: {{'spec': regexp_extract(x, '\\{{([^}}]*)\\}}', 1), 'module': regexp_extract(x, '"([^"]+)"', 1)}})) AS m FROM c_files))) i)
JOIN (SELECT repo, file AS c FROM c_files) USING (repo, c) GROUP BY repo, file, module, name""")
def _(spark, sf):
    return N.ts_imports(K.source_files(spark, sf), ["repo", "file"])


@query("fn_deps", "SELECT repo, package, section FROM c_deps")
def _(spark, sf):
    return N.dependencies(K.manifests(spark, sf), ["repo"])


@query("fn_alias_rules", "SELECT repo, base_url, ord, prefix, suffix, targets FROM c_rules")
def _(spark, sf):
    return N.alias_rules(K.alias_configs(spark, sf), ["repo"]).withColumn("targets", F.array_join("targets", ","))


def code_nodes(spark, sf):
    return CD.functions(K.source_files(spark, sf).select("repo", "file", "content"))


@query("fn_functions", r"""SELECT repo, file, name, start_line, end_line FROM (
 SELECT f.repo, f.file, f.name, f.i AS start_line, max(g.i) AS end_line,
  row_number() OVER (PARTITION BY f.repo, f.file, f.name ORDER BY f.i DESC) AS rn
 FROM (SELECT repo, file, i, regexp_extract(r, '^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(', 2) AS name FROM c_rows WHERE ends_with(file, '.py')) f
 JOIN c_rows g ON g.repo = f.repo AND g.file = f.file AND g.i >= f.i AND g.i < coalesce((SELECT min(h.i) FROM c_rows h WHERE h.repo = f.repo AND h.file = f.file AND h.i > f.i
   AND NOT starts_with(h.r, ' ')), g.i + 1)
 WHERE f.name <> '' GROUP BY 1, 2, 3, 4) WHERE rn = 1
UNION ALL
SELECT repo, file, name, max(i) FILTER (name <> ''), max(max(i)) OVER (PARTITION BY repo, file)
FROM (SELECT repo, file, i, regexp_extract(r, '^export function (\w+)', 1) AS name FROM c_rows WHERE NOT ends_with(file, '.py')) GROUP BY 1, 2, 3 QUALIFY name <> ''""")
def _(spark, sf):
    return code_nodes(spark, sf).select("repo", "file", "name", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


CTES["c_rows"] = "SELECT repo, file, unnest(string_split(content, chr(10))) AS r, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM c_files"


#: Functions as fn_functions finds them, and calls outside strings and comments with the last of the functions around them.
CTES["c_fns"] = ORACLE["fn_functions"]
_NO_CALL = ", ".join(f"'{n}'" for n in [*C.NOT_FUNCTIONS, "function", "def"])


@query("fn_calls", rf"""SELECT c.repo, c.file, arg_max(f.name, (f.start_line, f.end_line)) AS caller_name, c.callee_name, string_split(c.callee_name, '.')[-1] AS callee_short_name, c.i AS line FROM (
 SELECT DISTINCT repo, file, i, unnest(regexp_extract_all(q, '([A-Za-z_][\w.]*)\s*\(', 1)) AS callee_name,
  list_concat(regexp_extract_all(q, '\bdef\s+(\w+)\s*\(', 1), regexp_extract_all(q, '\bfunction\b\s*\*?\s*(\w+)\s*\(', 1)) AS defined
 FROM (SELECT repo, file, i, regexp_replace(CASE WHEN ends_with(file, '.py') THEN regexp_replace(r, '#.*$', '') ELSE r END, '"[^"]*"', '""', 'g') AS q FROM c_rows)) c
JOIN c_fns f ON f.repo = c.repo AND f.file = c.file AND c.i BETWEEN f.start_line AND f.end_line
WHERE NOT list_contains(defined, c.callee_name) AND c.callee_name NOT IN ({_NO_CALL}) GROUP BY ALL""")
def _(spark, sf):
    files = K.source_files(spark, sf).select("repo", "file", "content")
    return CD.calls(files, CD.functions(files)).select("repo", "file", "caller_name", "callee_name", "callee_short_name", F.col("line").cast("bigint").alias("line"))


@query("fn_finding_text", f"SELECT ord, {T.FTEXT} AS text, (coalesce(title, '') || chr(10) || coalesce(description, '') || chr(10) || coalesce(impact_statement, 'None') || chr(10) || coalesce(array_to_string(evidence, chr(10)), '')) AS scored FROM c_find")
def _(spark, sf):
    return K.findings(spark, sf).select("ord", X.finding_text().alias("text"), X.issue_text().alias("scored"))


@query("fn_text_any", """SELECT pr_id, ord, len(title_keywords) = 0 OR len(list_filter(title_keywords, lambda k: contains(lower(description), lower(k)))) > 0 AS title_hit,
 len(evidence_keywords) = 0 OR len(list_filter(evidence_keywords, lambda k: contains(lower(description), lower(k)))) > 0 AS evidence_hit FROM
 (SELECT * EXCLUDE (evidence_keywords), coalesce(evidence_keywords, []) AS evidence_keywords FROM c_exp)""")
def _(spark, sf):
    return K.expected(spark, sf).select("pr_id", "ord", X.any_keyword(F.col("description"), F.col("title_keywords")).alias("title_hit"),
                                        X.any_keyword(F.col("description"), F.col("evidence_keywords")).alias("evidence_hit"))


@query("fn_keywords", r"""SELECT doc_id, array_to_string((CASE WHEN stem <> '' AND NOT list_contains(k, stem) THEN list_append(k, stem) ELSE k END)[1:4], ',') AS keywords FROM (
 SELECT d.doc_id, 'f' || d.doc_id AS stem, coalesce(list(w ORDER BY p) FILTER (w IS NOT NULL), []) AS k FROM documents d LEFT JOIN (
  SELECT doc_id, w, min(p) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY min(p)) AS rn FROM (
   SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{3,}') AS ws FROM documents))
  WHERE lower(w) NOT IN """ + T.in_list(C.QODO_STOP) + """ GROUP BY 1, 2 QUALIFY rn <= 3) x ON x.doc_id = d.doc_id GROUP BY 1, 2)""")
def _(spark, sf):
    path = F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".py"))
    return K.table(spark, sf, "documents").select(
        "doc_id", F.array_join(N.keywords(F.col("text"), path, C.QODO_STOP), ",").alias("keywords"))
