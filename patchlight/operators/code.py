"""Functions and calls of source files, from lines, indents and braces.

A source file is one cell of at most `MAX_SOURCE_BYTES` (readers leave out longer ones); the arrays built per file are bounded by that.
Rows are marked by column expressions. Where a function ends and which function holds a row comes from one pass over a file's rows each,
so no file is shuffled and no row meets every function of its file.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from patchlight import constants as C
from patchlight.functions import columns as X

PY_START = r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\("
JS_NAMED_START = r"\bfunction\b\s*\*?\s*(\w+)\s*\("
JS_METHOD_START = r"^\s+(?:(?:public|private|protected|static|override|abstract|async|get|set)\s+)*(\w+)\s*\([^;]*\)\s*(?::[^={]+)?\{\s*$"
JS_ANONYMOUS = r"=>|\bfunction\s*\("
CALL = r"([A-Za-z_][\w.]*)\s*\("


def reviewed_source(path: Column, length: Column) -> Column:
    """Source files worth indexing: known suffix, no skipped or hidden folder, no test, not too long."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bad_dir = F.exists(dirs, lambda d: d.isin(C.SOURCE_SKIP_DIRS) | d.startswith("."))
    return (
        X.path_suffix(path).isin(list(C.LANGUAGE_OF_SUFFIX)) & ~bad_dir
        & (length <= C.MAX_SOURCE_BYTES) & ~X.contains_any(X.path_name(path), C.SOURCE_SKIP_PATTERNS)
    )


def language(path: Column) -> Column:
    return X.lookup(X.path_suffix(path), C.LANGUAGE_OF_SUFFIX, F.lit(None).cast("string"))


_QUOTED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + "|" + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
#: Strings and comments of a language, longest opening first.
PY_QUIET = r'"""[\s\S]*?"""' + "|" + r"'''[\s\S]*?'''" + "|" + _QUOTED + r"|#[^\n]*"
JS_QUIET = _QUOTED + r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`|//[^\n]*|/\*[\s\S]*?\*/"


def quiet_rows(content: Column, lang: Column) -> Column:
    """The rows of a source with strings emptied and comments gone, row numbers unchanged.

    The last row of a string or comment of many rows keeps a closing bracket, so that it counts as a row of the code around it.
    """
    def cleaned(pattern: str) -> Column:
        pieces, quiet = F.split(content, pattern), F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
        empty = F.transform(quiet, lambda t: F.concat(
            F.when(t.rlike(r"^[\"'`]"), '""').otherwise(""), F.repeat(F.lit("\n"), F.regexp_count(t, F.lit("\n")).cast("int")),
            F.when(t.contains("\n"), ")").otherwise("")))
        return F.split(F.array_join(F.zip_with(pieces, empty, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), ""), "\n")

    return F.when(lang == "python", cleaned(PY_QUIET)).when(lang.isin("javascript", "typescript"), cleaned(JS_QUIET)).otherwise(F.split(content, "\n"))


#: Level of a row at which no function ends.
NEVER = 2**31 - 1
ROW_NUMBERS = ArrayType(IntegerType())


def next_at_most(levels: np.ndarray, rows: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each asked row (ascending), the first later row whose level is at most its limit; the number of rows where there is none.

    One pass from the last row back. It keeps the rows that are lower than all rows between them and here, nearest last, so their levels
    ascend and a limit is found by bisection.
    """
    out = np.full(len(rows), len(levels), np.int32)
    kept_level: list[int] = []
    kept_row: list[int] = []
    level, ask = levels.tolist(), len(rows) - 1
    for i in range(len(level) - 1, -1, -1):
        while ask >= 0 and rows[ask] == i:
            at = bisect_right(kept_level, limits[ask])
            if at:
                out[ask] = kept_row[at - 1]
            ask -= 1
        while kept_level and kept_level[-1] >= level[i]:
            kept_level.pop()
            kept_row.pop()
        kept_level.append(level[i])
        kept_row.append(i)
    return out


@F.pandas_udf(ROW_NUMBERS)
def indent_ends(levels: pd.Series, solid: pd.Series, starts: pd.Series) -> pd.Series:
    """Last row of each def: the last of the rows in solid before the next row indented no deeper."""
    def one(lv, so, at):
        if lv is None or at is None:
            return None
        stop = next_at_most(lv, at, lv[at])
        return so[np.searchsorted(so, stop) - 1]

    return pd.Series([one(*x) for x in zip(levels, solid, starts, strict=True)], dtype=object)


@F.pandas_udf(ROW_NUMBERS)
def brace_ends(deltas: pd.Series, starts: pd.Series) -> pd.Series:
    """Last row of each function: where the brace depth is back at what it was before; its own row where that opens nothing."""
    def one(d, at):
        if d is None or at is None:
            return None
        depth = np.cumsum(d, dtype=np.int64)
        end = np.minimum(next_at_most(depth, at, depth[at] - d[at]), len(d) - 1)
        return np.where(d[at] > 0, end, at).astype(np.int32)

    return pd.Series([one(*x) for x in zip(deltas, starts, strict=True)], dtype=object)


@F.pandas_udf(ROW_NUMBERS)
def innermost(starts: pd.Series, ends: pd.Series, n_rows: pd.Series) -> pd.Series:
    """For each row of a file, which span holds it, the last of them; spans (rows counted from 1) ascend. -1 where there is none."""
    def one(a, b, n):
        owner = np.full(int(n), -1, np.int32)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            owner[i - 1 : j] = k
        return owner

    return pd.Series([one(*x) for x in zip(starts, ends, n_rows, strict=True)], dtype=object)


def functions(files: DataFrame) -> DataFrame:
    """repo, file, name, start_line, end_line, code; files: repo, file, content.

    Python: a function ends before the next code line indented no deeper than its def. Brace
    languages: at the line where the brace depth falls back. Brackets, indents and names in strings and comments
    do not count. Same names in a file: the last wins. A file is one row; one without content has no functions.
    """
    rows = files.withColumn("lang", language(F.col("file"))).where("lang IS NOT NULL AND content IS NOT NULL").select(
        "repo", "file", "lang", F.split("content", "\n").alias("rows"), quiet_rows(F.col("content"), F.col("lang")).alias("quiet"))
    is_py = F.col("lang") == "python"

    def where_true(marks: Column) -> Column:
        return F.filter(F.transform(marks, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())

    py = rows.where(is_py).select(
        "repo", "file", "rows",
        F.transform("quiet", lambda x: F.when((F.trim(x) == "") | F.trim(x).rlike(r"^[)\]}]"), F.lit(NEVER)).otherwise(
            F.length(F.regexp_extract(x, r"^([ \t]*)", 1)))).alias("levels"),
        where_true(F.transform("quiet", lambda x: F.trim(x) != "")).alias("solid"),
        F.transform("quiet", lambda x: F.regexp_extract(x, PY_START, 2)).alias("names"),
    ).withColumn("starts", where_true(F.transform("names", lambda n: n != ""))).where(F.size("starts") > 0)
    py = py.withColumn("ends", indent_ends("levels", "solid", "starts"))

    def js_name(x: Column) -> Column:
        method = F.regexp_extract(x, JS_METHOD_START, 1)
        return F.coalesce(
            F.nullif(F.regexp_extract(x, JS_NAMED_START, 1), F.lit("")),
            F.nullif(F.when(~method.isin([*C.NOT_FUNCTIONS, "function"]), method), F.lit("")),
            F.when(x.rlike(JS_ANONYMOUS), F.lit("<anonymous>")))

    js = rows.where(~is_py).select(
        "repo", "file", "rows",
        F.transform("quiet", lambda x: F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}"))).alias("deltas"),
        F.transform("quiet", js_name).alias("names"),
    ).withColumn("starts", where_true(F.transform("names", lambda n: n.isNotNull()))).where(F.size("starts") > 0)
    js = js.withColumn("ends", brace_ends("deltas", "starts"))

    cols = ["repo", "file", "rows", "names", "starts", "ends"]
    spans = F.sort_array(F.zip_with("starts", "ends", lambda s, e: F.struct(F.get("names", s).alias("name"), s.alias("s"), e.alias("e"))))
    found = py.select(*cols).unionByName(js.select(*cols)).select("repo", "file", "rows", spans.alias("spans"))
    last = F.filter("spans", lambda d, i: F.coalesce(F.get("spans", i + 1)["name"] != d["name"], F.lit(True)))
    # CODE_CHARS + 1 rows hold at least CODE_CHARS characters.
    return found.select("repo", "file", F.inline(F.transform(last, lambda d: F.struct(
        d["name"].alias("name"), (d["s"] + 1).alias("start_line"), (d["e"] + 1).alias("end_line"),
        F.left(F.array_join(F.slice("rows", d["s"] + 1, F.least(d["e"] - d["s"], F.lit(C.CODE_CHARS)) + 1), "\n"), F.lit(C.CODE_CHARS)).alias("code"),
    )))).select(F.xxhash64("repo", "file", "name").alias("id"), "repo", "file", "name", "start_line", "end_line", "code")


def calls(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls outside strings and comments with their innermost enclosing function. Every function of a file is in one small array."""
    spans = nodes.groupBy("repo", "file").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "id", "name"))).alias("fs"))
    rows = files.where("content IS NOT NULL").join(spans, ["repo", "file"]).select(
        "repo", "file", "fs", quiet_rows(F.col("content"), language(F.col("file"))).alias("quiet"))
    owner = innermost(F.col("fs.start_line"), F.col("fs.end_line"), F.size("quiet"))
    rows = rows.withColumn("owner", owner).select("repo", "file", F.posexplode(F.zip_with(
        "quiet", "owner", lambda x, k: F.struct(x.alias("x"), F.when(k >= 0, F.get("fs", k)).alias("f")))).alias("i", "r"),
    ).select("repo", "file", "i", "r.*").where("f IS NOT NULL")
    defined = F.concat(
        F.regexp_extract_all("x", F.lit(r"\bdef\s+(\w+)\s*\("), F.lit(1)), F.regexp_extract_all("x", F.lit(JS_NAMED_START), F.lit(1)),
        F.regexp_extract_all("x", F.lit(JS_METHOD_START), F.lit(1)))
    return rows.select("repo", "file", "i", "f", F.explode(F.array_except(
        F.regexp_extract_all("x", F.lit(CALL), F.lit(1)), F.concat(defined, F.array(*[F.lit(n) for n in [*C.NOT_FUNCTIONS, "function", "def"]])))).alias("callee_name")
    ).select(
        "repo", "file", F.col("f.id").alias("caller_id"), F.col("f.name").alias("caller_name"), "callee_name",
        F.substring_index("callee_name", ".", -1).alias("callee_short_name"), (F.col("i") + 1).alias("line"))
