"""DuckDB twins of the carrier tables."""

from __future__ import annotations

from patchlight import constants as C
from patchlight.catalog.base import CTES
from patchlight.sources import carriers as K


def lit(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], index: str) -> str:
    return f"{lit(values)}[(({index}) % {len(values)}) + 1]"


def doc_file(doc: str = "doc_id", source: str = "source") -> str:
    return f"'src/' || {source} || '/f' || {doc} || {pick(K.EXTENSIONS, doc)}"


def any_word(text: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def ends_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({text}, '{w}')" for w in words) + ")"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


RANK = "(CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'INFO' THEN 2 ELSE 99 END)"

_HEAD = f"""'diff --git a/' || {doc_file()} || ' b/' || {doc_file()} || chr(10) || '--- a/' || {doc_file()}
 || chr(10) || '+++ b/' || {doc_file()} || chr(10)"""
_MARK = """(CASE WHEN (i-1) % 10 = 0 THEN '@@ -' || i || ',10 +' || (2*i-1) || ',10 @@' || chr(10) ELSE '' END)
 || (CASE WHEN (i-1) % 5 <= 1 THEN '+' WHEN (i-1) % 5 = 2 THEN '-' ELSE ' ' END)"""

CTES["c_docs"] = """SELECT doc_id, doc_id // 4 AS pr_id, source, lang, text, n_chars, string_split(text, chr(10)) AS rows_
FROM documents"""
CTES["c_sec"] = f"""SELECT doc_id, pr_id, {doc_file()} AS file,
 {_HEAD} || array_to_string(list_transform(rows_, lambda x, i: {_MARK} || x), chr(10)) AS section FROM c_docs"""
CTES["c_prs"] = """SELECT d.pr_id, min_by(d.lang, d.doc_id) AS lang, sum(d.n_chars)::BIGINT AS n_chars,
 min_by(d.text, d.doc_id) AS description, 'org/repo' || (d.pr_id % 8) AS repo,
 'https://github.com/org/repo' || (d.pr_id % 8) || '/pull/' || d.pr_id AS url, 'Change ' || d.pr_id AS title,
 string_agg(s.section, chr(10) ORDER BY d.doc_id) AS diff, list(s.file ORDER BY d.doc_id) AS files,
 CASE WHEN d.pr_id % 5 <> 0 THEN sha256(d.pr_id::VARCHAR) END AS head_sha, 'main' AS base_branch,
 'feature-' || d.pr_id AS head_branch,
 CASE WHEN d.pr_id % 3 <> 0 THEN 'dev' || (d.pr_id % 11) END AS author_name, d.pr_id % 7 AS commits
FROM c_docs d JOIN c_sec s USING (doc_id) GROUP BY d.pr_id"""


def _code() -> str:
    w = "coalesce(nullif(regexp_extract(x, '([a-z]{3,})', 1), ''), 'w')"
    near = "(doc_id + (i-1) % 2)"
    return f"""(CASE (i-1) % 9
 WHEN 0 THEN 'import {{ f' || {near} || '_fn, ' || {w} || '_x as y' || (i-1) || ' }} from "./f' || {near} || '"'
 WHEN 1 THEN 'export function f' || doc_id || '_fn(a) {{'
 WHEN 2 THEN '    return f' || doc_id || '_fn(a);'
 WHEN 3 THEN 'import ' || {w} || ' from "' || {w} || '/lib"'
 WHEN 4 THEN 'const ' || {w} || ' = require("@/' || source || '/f' || {near} || '")'
 WHEN 5 THEN '# ' || {w} || ' note'
 WHEN 6 THEN 'def ' || {w} || '_py(x):'
 WHEN 7 THEN '    ' || {w} || '_py(x, ' || {w} || '[x])'
 ELSE 'from ' || {w} || ' import ' || {w} || '_a, ' || {w} || '_b as z' END)"""


CTES["c_csec"] = f"""SELECT doc_id, pr_id, {doc_file()} AS file,
 {_HEAD} || array_to_string(list_transform(rows_, lambda x, i: {_MARK} || {_code()}), chr(10)) AS section FROM c_docs"""
CTES["c_cprs"] = """SELECT pr_id, string_agg(section, chr(10) ORDER BY doc_id) AS diff, list(file ORDER BY doc_id) AS files
FROM c_csec GROUP BY pr_id"""


def _raw(src: str) -> str:
    return f"""SELECT pr_id, unnest(string_split(diff, chr(10))) AS raw,
 unnest(range(len(string_split(diff, chr(10))))) AS pos FROM {src}"""


def _lines(raw: str) -> str:
    return f"""SELECT pr_id, file, hunk, pos, kind, new_line, position, text FROM (
 SELECT *, CASE WHEN kind IN ('add','ctx') THEN (hstart - 1 + count(*) FILTER (kind IN ('add','ctx'))
     OVER (PARTITION BY pr_id, sec, hunk ORDER BY pos))::INT END AS new_line,
   (count(*) OVER (PARTITION BY pr_id, sec ORDER BY pos))::INT AS position
 FROM (
  SELECT *, (first_value(CASE WHEN kind = 'hunk' THEN regexp_extract(raw, '\\+([0-9]+)', 1)::INT END)
     OVER (PARTITION BY pr_id, sec, hunk ORDER BY pos)) AS hstart,
   CASE WHEN kind = 'hunk' THEN raw ELSE substr(raw, 2) END AS text
  FROM (
   SELECT *, (sum(CASE WHEN kind = 'hunk' THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id, sec ORDER BY pos) - 1)::INT AS hunk
   FROM (
    SELECT pr_id, pos, raw,
     last_value(CASE WHEN starts_with(raw, '+++ b/') THEN substr(raw, 7) END IGNORE NULLS)
       OVER (PARTITION BY pr_id ORDER BY pos) AS file,
     sum(CASE WHEN starts_with(raw, '+++ b/src/') THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id ORDER BY pos) AS sec,
     CASE WHEN starts_with(raw, 'diff --git a/src/') OR starts_with(raw, '--- a/src/') OR starts_with(raw, '+++ b/src/')
       THEN 'head' WHEN starts_with(raw, '@@ -') THEN 'hunk' WHEN starts_with(raw, '+') THEN 'add'
       WHEN starts_with(raw, '-') THEN 'del' ELSE 'ctx' END AS kind
    FROM {raw}) WHERE kind <> 'head')))"""


CTES["c_raw"] = _raw("c_prs")
CTES["c_lines"] = _lines("c_raw")
CTES["c_craw"] = _raw("c_cprs")
CTES["c_clines"] = _lines("c_craw")

CTES["c_find"] = f"""SELECT e.pr_id, e.event_id AS ord, {doc_file('d.doc_id', 'd.source')} AS file,
 CASE WHEN e.event_id % 17 <> 0 THEN (e.event_id // 3 % 40 + 1)::INT END AS line,
 {pick(K.TITLES, 'k')} AS title, {pick(K.DETAILS, 'k')} AS description,
 CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type IN ('purchase','signup') THEN 'WARNING' ELSE 'INFO' END AS severity,
 ((e.event_id * 37) % 100)::DOUBLE / 100.0::DOUBLE AS confidence,
 {pick(['security', 'performance', 'quality'], 'user_id')} AS category,
 CASE WHEN e.event_id % 19 <> 0 THEN {pick(K.IMPACTS, 'k')} END AS impact_type,
 CASE WHEN e.event_id % 23 = 0 THEN ' ' WHEN e.event_id % 29 <> 0 THEN 'Breaks the ' || event_type || ' flow' END AS impact_statement,
 CASE WHEN e.event_id % 13 <> 0 THEN [w[(e.event_id % len(w)) + 1]] END AS evidence,
 CASE WHEN e.event_id % 11 = 0 THEN 'CONTEXT' ELSE 'DIFF' END AS evidence_source, value AS token_cost
FROM (SELECT *, pr_id * 4 + user_id % 4 AS doc_id FROM (SELECT event_id, user_id, event_type, value,
   json_extract_string(props, '$.k')::INT AS k,
   event_id % (SELECT max(doc_id) // 4 + 1 FROM documents) AS pr_id FROM events)) e
JOIN (SELECT doc_id, source, string_split_regex(text, '[\\n ]') AS w FROM documents) d ON d.doc_id = e.doc_id"""

CTES["c_exp"] = f"""SELECT l.doc_id // 4 AS pr_id, l.doc_id AS ord, 'g' || l.doc_id AS id, {doc_file('l.doc_id')} AS file,
 CASE WHEN l.doc_id % 10 <> 9 THEN (l.doc_id % 30 + 1)::INT END AS line_start,
 CASE WHEN l.doc_id % 10 <> 9 THEN (l.doc_id % 30 + 4)::INT END AS line_end,
 [string_split({pick(K.TITLES, 'l.doc_id')}, ' ')[2]] AS title_keywords,
 (SELECT list(w ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS p)
    GROUP BY w ORDER BY p LIMIT 2)) AS evidence_keywords,
 {pick(K.TITLES, 'l.doc_id + 1')} || ' ' || {pick(K.DETAILS, 'l.doc_id')} AS description,
 CASE WHEN toxic = 1 THEN 'ERROR' WHEN quality = 0 THEN 'WARNING' ELSE 'INFO' END AS severity
FROM labels l JOIN (SELECT doc_id, source, regexp_extract_all(text, '[a-z]{{4,}}') AS ws FROM documents) d USING (doc_id)"""

CTES["c_nodes"] = """SELECT 'org/repo' || (p_partkey // 20 % 3) AS repo, p_partkey AS id,
 'src/' || lower(replace(p_brand, '#', '_')) || '/m' || (p_partkey % 8) || '.py' AS file,
 string_split(p_name, ' ')[-1] || '_' || (p_partkey // 5 % 40) AS name,
 (p_partkey % 50 * 10 + 1)::INT AS start_line, (p_partkey % 50 * 10 + 1 + p_size)::INT AS end_line,
 repeat(p_name || '();' || chr(10), p_size) AS code FROM part"""
CTES["c_edges"] = "SELECT DISTINCT l_partkey AS caller_id, l_suppkey AS callee_id FROM lineitem WHERE l_partkey <> l_suppkey"
CTES["c_calls"] = """SELECT DISTINCT caller_id,
 CASE kind WHEN 0 THEN short WHEN 1 THEN 'mod' || (target % 3) || '.' || short WHEN 2 THEN 'self.' || short ELSE short || '_q' END AS callee_name,
 CASE kind WHEN 3 THEN short || '_q' ELSE short END AS callee_short_name
FROM (SELECT e.caller_id, e.target, n.name AS short, (e.caller_id + e.target) % 4 AS kind
 FROM (SELECT DISTINCT l_partkey AS caller_id, l_suppkey * 3 + l_linenumber AS target FROM lineitem WHERE l_partkey <> l_suppkey) e
 JOIN c_nodes n ON n.id = e.target)"""
CTES["c_imports"] = """SELECT DISTINCT * FROM (
 SELECT a.repo, a.file, b.name, b.file AS source_file FROM c_nodes a JOIN c_nodes b ON b.id = a.id + 1 AND b.repo = a.repo
 UNION ALL
 SELECT a.repo, a.file, 'mod' || (b.id % 3), b.file FROM c_nodes a JOIN c_nodes b ON b.id = a.id + 1 AND b.repo = a.repo)"""
CTES["c_changed"] = "SELECT s_nationkey::BIGINT AS pr_id, s_suppkey AS id FROM supplier"
CTES["c_fnodes"] = f"""SELECT pr_id, doc_id * 100000 + j + 1 AS id, file,
 CASE WHEN j < 0 THEN 'outer' ELSE 'f' || j END AS name, (CASE WHEN j < 0 THEN 1 ELSE j * 5 + 1 END)::INT AS start_line,
 (CASE WHEN j < 0 THEN 40 ELSE j * 5 + 5 END)::INT AS end_line
FROM (SELECT pr_id, doc_id, {doc_file()} AS file, unnest(range(-1, 2 * len(rows_) // 5 + 1)) AS j FROM c_docs)"""

_SKIP_NAME = "string_split(file, '/')[-1]"
SKIP_FILE = f"""(len(list_intersect(string_split(file, '/'), {lit(C.SKIP_PARTS)})) > 0
 OR {ends_any('file', C.SKIP_SUFFIXES)} OR {_SKIP_NAME} IN {in_list(C.SKIP_NAMES)}
 OR starts_with({_SKIP_NAME}, 'test_') OR {ends_any(_SKIP_NAME, C.SKIP_NAME_ENDS)})"""
SKIP_LARGE = f"""({_SKIP_NAME} IN {in_list(C.LARGE_PR_NAMES)}
 OR lower(regexp_extract({_SKIP_NAME}, '^.+(\\.[^.]+)$', 1)) IN {in_list(C.LARGE_PR_SUFFIXES)})"""

FTEXT = """lower(concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(impact_statement, ''),
 nullif(array_to_string(evidence, ' '), '')))"""
CTES["c_marks"] = r"""SELECT pr_id, file, new_line AS line, bool_or(kind = 'add') AS is_added,
 min_by((t = '*' OR starts_with(t, '# ') OR starts_with(t, '#!') OR starts_with(t, '//') OR starts_with(t, '* ') OR starts_with(t, '/*')), pos) AS is_comment
FROM (SELECT *, regexp_replace(text, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g') AS t FROM c_clines WHERE kind IN ('add','ctx'))
GROUP BY 1, 2, 3"""
CTES["c_gate"] = f"""SELECT f.* FROM c_find f LEFT JOIN c_marks m USING (pr_id, file, line)
WHERE severity <> 'INFO' AND ((evidence_source = 'CONTEXT' AND coalesce(len(evidence), 0) > 0)
 OR (evidence_source <> 'CONTEXT' AND (f.line IS NULL OR (m.is_comment IS NOT NULL AND NOT m.is_comment))))
QUALIFY row_number() OVER (PARTITION BY f.pr_id, f.file, f.line, title ORDER BY {RANK}, confidence DESC, ord) = 1"""

CTES["c_files"] = f"""SELECT 'r' || pr_id AS repo, pr_id, doc_id, {doc_file()} AS file,
 array_to_string(list_transform(rows_, lambda x, i: {_code()}), chr(10)) AS content FROM c_docs"""
CTES["c_deps"] = """SELECT 'r' || pr_id AS repo, package, max_by(section, i) AS section FROM (
 SELECT pr_id, unnest([min_by(w, doc_id), 'react', max_by(w, doc_id), 'react']) AS package,
  unnest(['dependencies', 'dependencies', 'devDependencies', 'devDependencies']) AS section, unnest([0, 0, 1, 1]) AS i
 FROM (SELECT pr_id, doc_id, coalesce(nullif(regexp_extract(text, '([a-z]{3,})', 1), ''), 'w') AS w FROM c_docs WHERE pr_id % 7 <> 0)
 GROUP BY pr_id) GROUP BY 1, 2"""
CTES["c_rules"] = """SELECT 'r' || pr_id AS repo, CASE WHEN pr_id % 5 = 2 THEN 'src' ELSE '.' END AS base_url, r.ord, r.prefix, r.suffix, r.targets
FROM (SELECT DISTINCT pr_id FROM c_docs WHERE pr_id % 5 <> 0), LATERAL (SELECT unnest(CASE pr_id % 5
 WHEN 1 THEN [{'ord': NULL::INT, 'prefix': NULL, 'suffix': NULL, 'targets': NULL}]
 WHEN 2 THEN [{'ord': 0, 'prefix': '@/', 'suffix': '', 'targets': 'lib/*,*'}, {'ord': 1, 'prefix': '~/x', 'suffix': '', 'targets': 'y'}]
 ELSE [{'ord': 0, 'prefix': '@/', 'suffix': '', 'targets': 'src/*'}] END) AS r)"""
