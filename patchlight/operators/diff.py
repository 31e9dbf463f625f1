"""Unified diffs as relations.

A diff is one cell, so its lines are produced inside the row with array functions: split into file
sections, sections into hunks, hunks into lines. No shuffle, window or Python is needed, and line
numbers are array positions of filtered lines, so the work is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import columns as X

HUNK_SPLIT = r"(?dm)^(?=@@)"
FILE_SPLIT = r"(?dm)^(?=diff --git)"
IMPORT_LINE = r"^\s*(import |from .+ import |require\(|const .+ = require)"


def _sql(text: str) -> Column:
    return F.expr(text)


def _running(sizes: Column) -> Column:
    """Offsets before each element; the array holds hunks, not lines, so it stays short."""
    return F.aggregate(
        sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )


def diff_sections(prs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """keys, section, file (null outside a new-side file), off (first row's number), head (header rows), rows.

    A section starts at a git header, at "--- x" directly followed by "+++ y", or at "+++ b/". Rows that a hunk still owes by the
    numbers of its @@ row are content, whatever they look like. The text is split once on newlines; sections are slices of that array.
    """
    rows = prs.select(*keys, F.split(F.col(diff), "\n").alias("_r")).select(
        *keys, _sql("if(element_at(_r, -1) = '', slice(_r, 1, size(_r) - 1), _r)").alias("_r"))
    # Where the rows before a possible file header start to count: the last @@ row, unless a git header came after it.
    rows = rows.withColumn("_g", _sql(
        """filter(transform(_r, (x, i) -> if(startswith(x, '@@') or startswith(x, 'diff --git '), i, null)), i -> i is not null)"""))
    owed = """coalesce(try_element_at(transform(filter(array(try_element_at(filter(_g, q -> q < i), -1)), q -> q is not null and get(_r, q) rlike '^@@ -[0-9]'),
                 q -> size(filter(slice(_r, q + 2, i - q - 1), y -> y = '' or substr(y, 1, 1) in ({side}, ' '))) < coalesce(try_cast(
                   nullif(regexp_extract(get(_r, q), {count}, 1), '') as int), 1)), 1), false)"""
    old = owed.format(side="'-'", count=r"r'^@@ -[0-9]+(?:,([0-9]+))?'")
    new = owed.format(side="'+'", count=r"r'^@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+(?:,([0-9]+))?'")
    marks = rows.withColumn(
        "_m",
        _sql(
            f"""filter(transform(_r, (x, i) -> named_struct('i', i, 'hd', case
                 when startswith(x, 'diff --git ') then 1
                 when startswith(x, '+++ b/') and not {new} then 1
                 when startswith(x, '--- ') and startswith(get(_r, i + 1), '+++ b/') and not {old} then 1
                 when startswith(x, '--- ') and startswith(get(_r, i + 1), '+++ ') and not {old} then 2
                 when i = 0 then 0 end)), m -> m.hd is not null)"""
        ),
    )
    return marks.select(
        *keys,
        _sql(
            """posexplode(transform(_m, (m, k) -> named_struct('off', m.i, 'head', m.hd,
                 'rows', slice(_r, m.i + 1, coalesce(get(_m, k + 1).i, size(_r)) - m.i)))) as (section, s)"""
        ),
    ).select(
        *keys, "section",
        _sql("if(startswith(get(s.rows, 0), '+++ b/'), substr(get(s.rows, 0), 7), null)").alias("file"),
        F.col("s.off").alias("off"), F.col("s.head").alias("head"), F.col("s.rows").alias("rows"),
    )


def diff_lines(prs: DataFrame, keys: list[str] | None = None, diff: str = "diff") -> DataFrame:
    """keys, file, section, hunk, pos, kind, new_line, new_line_lenient, position, text.

    kind is add, del, ctx, hunk (the @@ row) or meta (any other row inside a file). new_line counts
    added and blank-led rows; new_line_lenient counts every row that is not removed. position counts
    @@, added, removed and context rows of the file section from 1.
    """
    keys = keys or ["pr_id"]
    hunks = (
        diff_sections(prs, keys, diff)
        .withColumn(
            "_h",
            _sql(
                """filter(transform(rows, (x, i) -> if(i >= head and (startswith(x, '@@') or i = head), i, null)),
                     i -> i is not null)"""
            ),
        )
        .withColumn(
            "hs",
            _sql(
                """transform(transform(_h, (h, k) -> named_struct('at', h,
                     'head', if(startswith(get(rows, h), '@@'), get(rows, h), null),
                     'stop', coalesce(get(_h, k + 1), size(rows)))),
                   h -> named_struct('head', h.head, 'loff', off + h.at,
                     'rows', if(h.head is null, slice(rows, h.at + 1, h.stop - h.at),
                                slice(rows, h.at + 2, h.stop - h.at - 1))))"""
            ),
        )
        .withColumn(
            "poffs",
            _running(F.transform("hs", lambda h: F.when(h["head"].isNull(), 0).otherwise(1) + F.size(
                F.filter(h["rows"], lambda x: x.substr(1, 1).isin("+", "-", " "))))),
        )
        .select(
            *keys, "section", "file",
            _sql(
                """posexplode(transform(hs, (h, k) -> named_struct('head', h.head, 'rows', h.rows,
                     'loff', h.loff, 'poff', get(poffs, k)))) as (hunk, h)"""
            ),
        )
        .select(
            *keys, "section", "file", "hunk", F.col("h.head").alias("head"), F.col("h.rows").alias("rows"),
            F.when(F.col("h.head").isNull(), F.lit(1))
            .otherwise(_sql(r"try_cast(regexp_extract(h.head, '\\+([0-9]+)', 1) as int)")).alias("start"),
            F.when(F.col("h.head").isNull(), 0).otherwise(1).alias("hd"),
            F.col("h.loff").alias("loff"), F.col("h.poff").alias("poff"),
        )
    )
    marked = hunks.withColumn(
        "base",
        _sql("transform(rows, (x, i) -> named_struct('i', i, 'c', substr(x, 1, 1), 'x', x))"),
    ).withColumn(
        "kept",
        _sql(
            "transform(filter(base, s -> s.c <> '-'),"
            " (s, n) -> named_struct('i', s.i, 'c', s.c, 'x', s.x, 'n', n))"
        ),
    )
    return marked.select(
        *keys, "section", "file", "hunk",
        _sql(
            """inline(concat(
              if(head is null, array(), array(named_struct(
                 'pos', loff, 'kind', 'hunk', 'new_line', cast(null as int), 'new_line_lenient',
                 cast(null as int), 'position', poff + 1, 'text', head))),
              transform(filter(kept, s -> s.c in ('+', ' ')), (s, j) -> named_struct(
                 'pos', loff + hd + s.i, 'kind', if(s.c = '+', 'add', 'ctx'), 'new_line', start + j,
                 'new_line_lenient', start + s.n, 'position', poff + hd + 1 + s.i - (s.n - j),
                 'text', substr(s.x, 2))),
              transform(filter(transform(filter(base, s -> s.c in ('+', '-', ' ')),
                   (s, p) -> named_struct('i', s.i, 'c', s.c, 'x', s.x, 'p', p)), s -> s.c = '-'),
                 s -> named_struct('pos', loff + hd + s.i, 'kind', 'del', 'new_line', cast(null as int),
                 'new_line_lenient', cast(null as int), 'position', poff + hd + 1 + s.p,
                 'text', substr(s.x, 2))),
              transform(filter(kept, s -> s.c not in ('+', ' ')), s -> named_struct(
                 'pos', loff + hd + s.i, 'kind', 'meta', 'new_line', cast(null as int),
                 'new_line_lenient', start + s.n, 'position', cast(null as int), 'text', s.x))))"""
        ),
    )


def position_map(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["pr_id"]
    return lines.where((F.col("kind") == "add") & F.col("file").isNotNull()).select(
        *keys, "file", "new_line", "position"
    )


def added_lines(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Added lines; for a change without any file header, all its added lines."""
    keys = keys or ["pr_id"]
    add = lines.where(F.col("kind") == "add")
    with_file = lines.where(F.col("file").isNotNull()).select(*keys).distinct()
    loose = add.where(F.col("file").isNull()).join(with_file, keys, "left_anti")
    return add.where(F.col("file").isNotNull()).unionByName(loose)


def visible_lines(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["pr_id"]
    return (
        lines.where(F.col("kind").isin("add", "ctx") & F.col("file").isNotNull())
        .select(*keys, "file", "new_line")
        .distinct()
    )


def hunk_ranges(prs: DataFrame, keys: list[str] | None = None, diff: str = "diff") -> DataFrame:
    """keys, file, hunk (from 0 in the file), start_line, end_line, read from the headers only."""
    keys = keys or ["pr_id"]
    sections = diff_sections(prs, keys, diff).where(F.col("file").isNotNull())
    heads = sections.select(
        *keys, "file", "section",
        _sql(r"posexplode(filter(rows, x -> startswith(x, '@@ ') and x rlike '\\+[0-9]')) as (hunk, head)"),
    )
    start = _sql(r"cast(regexp_extract(head, '\\+([0-9]+)', 1) as int)")
    count = _sql(r"coalesce(try_cast(nullif(regexp_extract(head, '\\+[0-9]+,([0-9]+)', 1), '') as int), 1)")
    return heads.select(
        *keys, "file", "hunk", start.alias("start_line"),
        (start + F.greatest(count - 1, F.lit(0))).alias("end_line"),
    )


def split_files(prs: DataFrame, keys: list[str] | None = None, diff: str = "diff") -> DataFrame:
    """keys, file, part, chunk: one chunk per file, cut at git headers; of equal names the last chunk
    counts, at the place of the first. All inside the row: texts are not shuffled."""
    keys = keys or ["pr_id"]
    parts = prs.select(
        *keys,
        F.filter(
            F.transform(
                F.split(F.col(diff), FILE_SPLIT),
                lambda t: F.struct(
                    F.try_element_at(
                        F.regexp_extract_all(t, F.lit(r"(?dm)^\+\+\+ b/([^\n]*)"), F.lit(1)), F.lit(-1)
                    ).alias("file"),
                    F.when(t.endswith("\n"), F.left(t, F.length(t) - 1)).otherwise(t).alias("chunk"),
                ),
            ),
            lambda c: c["file"].isNotNull(),
        ).alias("_c"),
    ).withColumn("_n", F.transform("_c", lambda c: c["file"]))
    return parts.select(
        *keys,
        _sql(
            """inline(transform(filter(transform(_c, (c, k) -> named_struct('file', c.file,
                 'part', cast(array_position(_n, c.file) - 1 as int), 'chunk', c.chunk, 'k', k)),
                 c -> not array_contains(slice(_n, c.k + 2, size(_n)), c.file)),
               c -> named_struct('file', c.file, 'part', c.part, 'chunk', c.chunk)))"""
        ),
    )


def _hunk_parts(df: DataFrame, text: str) -> DataFrame:
    """Adds header (text before the first @@) and hunk texts without their final newline."""
    return df.withColumn("_p", F.split(F.col(text), HUNK_SPLIT)).withColumn(
        "header", F.when(F.col("_p")[0].startswith("@@"), F.lit("")).otherwise(
            F.regexp_replace(F.col("_p")[0], r"\n\z", ""))
    ).withColumn(
        "hunks",
        F.transform(
            F.filter("_p", lambda h: h.startswith("@@")), lambda h: F.regexp_replace(h, r"\n\z", "")
        ),
    ).drop("_p")


def chunk_files(files: DataFrame, limit: int = C.CHUNK_CHARS, text: str = "chunk") -> DataFrame:
    """Long file diffs packed greedily into chunks of whole hunks, the header on each.

    The fold keeps only hunk counts per chunk; texts are cut once at the end.
    """
    parts = _hunk_parts(files, text)
    packed = parts.withColumn(
        "cuts",
        F.when(F.length(text) <= limit, F.array().cast("array<int>")).otherwise(
            F.aggregate(
                F.transform("hunks", lambda h: F.length(h)),
                F.struct(
                    F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("i"),
                    F.length("header").alias("len"), F.lit(0).alias("n"),
                ),
                lambda a, n: F.when(
                    (a["n"] > 0) & (a["len"] + n > limit),
                    F.struct(
                        F.concat(a["cuts"], F.array(a["i"])).alias("cuts"), (a["i"] + 1).alias("i"),
                        (F.length("header") + n).alias("len"), F.lit(1).alias("n"),
                    ),
                ).otherwise(
                    F.struct(
                        a["cuts"].alias("cuts"), (a["i"] + 1).alias("i"),
                        (a["len"] + n).alias("len"), (a["n"] + 1).alias("n"),
                    )
                ),
                lambda a: a["cuts"],
            )
        ),
    ).withColumn(
        "bounds",
        F.when(
            F.length(text) > limit,
            F.concat(F.array(F.lit(0)), "cuts", F.array(F.size("hunks"))),
        ),
    )
    keep = [c for c in files.columns if c != text]
    return packed.select(
        *keep,
        F.posexplode(
            F.when(F.col("bounds").isNull(), F.array(F.col(text))).otherwise(
                F.filter(
                    F.transform(
                        F.slice("bounds", F.lit(1), F.size("bounds") - 1),
                        lambda b, i: F.when(
                            F.col("bounds")[i + 1] > b,
                            F.concat(
                                "header", F.lit("\n"),
                                F.array_join(
                                    F.slice("hunks", b + 1, F.col("bounds")[i + 1] - b), "\n"
                                ),
                            ),
                        ),
                    ),
                    lambda c: c.isNotNull(),
                )
            )
        ).alias("chunk_no", text),
    )


def classify_hunk(rows: Column) -> Column:
    """mechanical or logical, for an array of raw hunk rows."""
    added = F.transform(
        F.filter(rows, lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substring(x, 2, 2**31 - 1)
    )
    removed = F.transform(
        F.filter(rows, lambda x: x.startswith("-") & ~x.startswith("---")), lambda x: F.substring(x, 2, 2**31 - 1)
    )

    def imports_only(a: Column) -> Column:
        return F.forall(a, lambda x: x.rlike(IMPORT_LINE))

    def skeleton(a: Column) -> Column:
        return F.transform(a, lambda x: F.regexp_replace(X.python_strip(x), r"[a-zA-Z_]\w*", "_"))

    both = (F.size(added) > 0) & (F.size(removed) > 0)
    return (
        F.when((F.size(added) == 0) & (F.size(removed) == 0), "mechanical")
        .when(both & (F.transform(added, X.python_strip) == F.transform(removed, X.python_strip)), "mechanical")
        .when((F.size(added) > 0) & imports_only(added) & imports_only(removed), "mechanical")
        .when(both & (skeleton(added) == skeleton(removed)), "mechanical")
        .otherwise("logical")
    )


def hunk_kinds(files: DataFrame, text: str = "chunk") -> DataFrame:
    keep = [c for c in files.columns if c != text]
    rows = _hunk_parts(files, text).select(*keep, F.posexplode("hunks").alias("hunk", "body"))
    return rows.select(*keep, "hunk", "body", classify_hunk(F.split("body", "\n")).alias("hunk_kind"))


def filter_mechanical(files: DataFrame, text: str = "chunk") -> DataFrame:
    """Each file with its logical hunks only; skipped is true when every hunk was mechanical."""
    keep = [c for c in files.columns if c != text]
    parts = _hunk_parts(files, text).withColumn(
        "logical", F.filter("hunks", lambda h: classify_hunk(F.split(h, "\n")) == "logical")
    )
    none = F.size("hunks") == 0
    return parts.select(
        *keep,
        F.when(none, F.col(text))
        .when(F.size("logical") > 0, F.concat("header", F.lit("\n"), F.array_join("logical", "\n")))
        .alias(text),
        (~none & (F.size("logical") == 0)).alias("skipped"),
    )


def patch_convert(patch: Column) -> Column:
    """Benchmark patch text to unified diff: numbered code rows, '## file:' headers, no hunk marks."""
    rows = F.split(F.regexp_replace(patch, r"\n\z", ""), "\n")
    kept = F.filter(rows, lambda x: X.python_strip(x) != "__new hunk__")

    def convert(x: Column) -> Column:
        path = F.regexp_replace(F.substring(x, 11, 2**31 - 1), r"'+$", "")
        return (
            F.when(x.startswith("## file: '"), F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path))
            .when(x.startswith("@@"), x)
            .when(x.rlike(r"^\d+ "), F.regexp_replace(x, r"^\d+ ", ""))
            .otherwise(x)
        )

    return F.concat(F.array_join(F.transform(kept, convert), "\n"), F.lit("\n"))


def diff_stats(diff: Column) -> tuple[Column, Column]:
    """Added and removed rows by plain count of the marker after a newline, headers included."""
    return F.regexp_count(diff, F.lit(r"\n\+")), F.regexp_count(diff, F.lit(r"\n-"))


def truncate_file(chunk: Column, limit: int = C.BASELINE_FILE_CHARS) -> Column:
    return F.when(
        F.length(chunk) > limit, F.concat(F.left(chunk, F.lit(limit)), F.lit("\n... [truncated]"))
    ).otherwise(chunk)


def route(diff: Column, files: Column, max_tokens: int = C.MAX_TOKENS_PER_CALL) -> Column:
    n = X.tokens(diff)
    return (
        F.when(n > C.PER_FILE_TOKENS, "per_file")
        .when((F.size(files) > C.BATCH_FILES) | (n > max_tokens), "multi")
        .otherwise("single")
    )


def token_split(df: DataFrame, text: str = "diff", max_tokens: int = C.MAX_TOKENS_PER_CALL) -> DataFrame:
    """Lines packed to max_tokens * 4 characters; the header rows in force lead each later piece.

    The fold carries cut positions and header ranges as integers, so its state stays small.
    """
    limit = max_tokens * C.CHARS_PER_TOKEN
    keep = [c for c in df.columns if c != text]
    rows = df.withColumn("rows", F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n"))
    heads = rows.withColumn(
        "heads",
        _sql(
            "filter(transform(rows, (x, i) -> named_struct('i', i, 'x', x)), s -> s.x like 'diff --git%'"
            " or s.x like '+++%' or s.x like '---%' or s.x like '@@%')"
        ),
    )
    folded = heads.withColumn(
        "cuts",
        _sql(
            f"""aggregate(transform(rows, (x, i) -> named_struct('n', length(x) + 1, 'i', i,
                   'git', x like 'diff --git%', 'hd', x like '+++%' or x like '---%' or x like '@@%')),
              named_struct('cuts', cast(array() as array<struct<i:int,from:int>>), 'used', 0, 'rows', 0,
                           'from', 0, 'hlen', 0),
              (a, r) -> if(
                 a.rows > 0 and a.used + r.n > {limit},
                 named_struct(
                   'cuts', concat(a.cuts, array(named_struct('i', r.i, 'from', if(r.git, r.i, a.from)))),
                   'used', if(r.git, r.n, if(r.hd, a.hlen + r.n, a.hlen)) + r.n, 'rows', 1,
                   'from', if(r.git, r.i, a.from),
                   'hlen', if(r.git, r.n, if(r.hd, a.hlen + r.n, a.hlen))),
                 named_struct('cuts', a.cuts, 'used', a.used + r.n, 'rows', a.rows + 1,
                   'from', if(r.git, r.i, a.from),
                   'hlen', if(r.git, r.n, if(r.hd, a.hlen + r.n, a.hlen)))),
              a -> a.cuts)"""
        ),
    )
    pieces = folded.withColumn(
        "starts", _sql("concat(array(named_struct('i', 0, 'from', 0)), cuts)")
    ).select(
        *keep,
        F.posexplode(
            F.when(F.length(text) <= limit, F.array(F.col(text))).otherwise(
                _sql(
                    """transform(starts, (s, k) -> array_join(concat(
                         if(k = 0, cast(array() as array<string>),
                            transform(filter(heads, h -> h.i >= s.from and h.i <= s.i), h -> h.x)),
                         slice(rows, s.i + 1, coalesce(try_element_at(starts, k + 2).i, size(rows)) - s.i)),
                         '\n'))"""
                )
            )
        ).alias("piece", text),
    )
    return pieces


def read_order(diff_rows: Column) -> Column:
    """1-based line numbers, changed rows first, first fifteen."""
    return _sql(
        f"""slice(concat(
           transform(filter(transform(split({diff_rows}, '\\n'), (x, i) -> named_struct('i', i + 1, 'x', x)),
             s -> not (ltrim(s.x) like '--- %' or ltrim(s.x) like '+++ %' or ltrim(s.x) like '@@%')
                  and (s.x like '+%' or s.x like '-%')), s -> s.i),
           transform(filter(transform(split({diff_rows}, '\\n'), (x, i) -> named_struct('i', i + 1, 'x', x)),
             s -> ltrim(s.x) like '--- %' or ltrim(s.x) like '+++ %' or ltrim(s.x) like '@@%'
                  or not (s.x like '+%' or s.x like '-%')), s -> s.i)), 1, 15)"""
    )


def snippets(findings: DataFrame, lines: DataFrame, context: int = C.SNIPPET_CONTEXT) -> DataFrame:
    """Finding keys with the rows around its line. The window is a bounded equi-join on row numbers."""
    rows = lines.where((F.col("kind") != "meta") & F.col("file").isNotNull()).select(
        "pr_id", "file", F.col("position").alias("idx"), "new_line",
        F.concat(
            F.when(F.col("kind") == "add", "+").when(F.col("kind") == "del", "-")
            .when(F.col("kind") == "ctx", " ").otherwise(""), "text",
        ).alias("raw"),
    )
    target = (
        findings.where(F.col("line").isNotNull())
        .select("pr_id", "file", F.col("line").alias("new_line"), "ord")
        .join(rows.select("pr_id", "file", "new_line", "idx"), ["pr_id", "file", "new_line"])
        .groupBy("pr_id", "file", "ord").agg(F.min("idx").alias("t"))
        .select("pr_id", "file", "ord", "t",
                F.explode(F.sequence(F.col("t") - context, F.col("t") + context)).alias("idx"))
    )
    return (
        target.join(rows.select("pr_id", "file", "idx", "raw"), ["pr_id", "file", "idx"])
        .groupBy("pr_id", "file", "ord")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "raw"))),
                                      lambda s: s["raw"]), "\n").alias("snippet"))
    )


def skip_file(path: Column) -> Column:
    name = X.path_name(path)
    starts = F.lit(False)
    for s in C.SKIP_NAME_STARTS:
        starts = starts | name.startswith(s)
    return (
        F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in C.SKIP_PARTS]))
        | X.ends_with_any(path, C.SKIP_SUFFIXES)
        | name.isin(C.SKIP_NAMES)
        | starts
        | X.ends_with_any(name, C.SKIP_NAME_ENDS)
    )


def skip_large_pr_file(path: Column) -> Column:
    return X.path_name(path).isin(C.LARGE_PR_NAMES) | F.lower(X.path_suffix(path)).isin(C.LARGE_PR_SUFFIXES)


def large_pr_files(files: DataFrame, key: str = "pr_id", threshold: int = C.LARGE_PR_FILES) -> DataFrame:
    """Reviewed files with is_large; the file count is a small pre-aggregated join, not a window."""
    kept = files.where(~skip_file(F.col("file")))
    sizes = kept.groupBy(key).agg(F.count("*").alias("n_files"))
    joined = kept.join(sizes, key)
    return joined.where(
        ~((F.col("n_files") > threshold) & skip_large_pr_file(F.col("file")))
    ).withColumn("is_large", F.col("n_files") > threshold)


def file_batches(files: DataFrame, size: int = C.BATCH_FILES) -> DataFrame:
    """Batch number per file from its place in the change's file list."""
    return files.select(
        "pr_id", F.posexplode("files").alias("ord", "file")
    ).withColumn("batch", F.floor(F.col("ord") / size).cast("int"))


def coverage(files: DataFrame, threshold: int = C.LARGE_PR_FILES) -> DataFrame:
    """Per change: files in total, reviewed, mechanical, large; input has file and chunk."""
    base = files.where(~skip_file(F.col("file")))
    sizes = files.groupBy("pr_id").agg(
        F.count("*").alias("total"),
        F.count_if(~skip_file(F.col("file"))).alias("basic"),
    )
    kept = base.join(sizes, "pr_id").where(
        ~((F.col("basic") > threshold) & skip_large_pr_file(F.col("file")))
    )
    marked = filter_mechanical(kept.select("pr_id", "file", "chunk"))
    per_pr = marked.groupBy("pr_id").agg(
        F.count_if(~F.col("skipped")).alias("reviewed"),
        F.count_if(F.col("skipped")).alias("skipped_mechanical"),
    )
    return sizes.join(per_pr, "pr_id", "left").select(
        "pr_id", "total", F.coalesce("reviewed", F.lit(0)).alias("reviewed"),
        F.coalesce("skipped_mechanical", F.lit(0)).alias("skipped_mechanical"),
        ((F.col("basic") > threshold) | (F.col("total") > threshold)).alias("is_large_pr"),
    )


def batch_diffs(prs: DataFrame, size: int = C.BATCH_FILES, max_tokens: int = C.MAX_TOKENS_PER_CALL) -> DataFrame:
    """Diff text per batch of files, then split by tokens. A batch holds at most size chunks."""
    chunks = split_files(prs.select("pr_id", "diff"))
    batches = file_batches(prs.select("pr_id", "files"), size).select("pr_id", "file", "batch")
    text = (
        batches.join(chunks, ["pr_id", "file"], "left")
        .groupBy("pr_id", "batch")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.when(
                    F.col("chunk").isNotNull(), F.struct("part", "chunk")))), lambda s: s["chunk"]), "\n"
            ).alias("diff")
        )
    )
    return token_split(text, "diff", max_tokens)


def added_numbered(prs: DataFrame, keys: list[str] | None = None, diff: str = "diff") -> DataFrame:
    """Added rows as the scanner reads them: leading blanks of every row dropped, lenient numbers."""
    keys = keys or ["pr_id"]
    trimmed = prs.select(*keys, F.regexp_replace(diff, r"(?dm)^[ \t]+", "").alias("_d"))
    lines = diff_lines(trimmed, keys, "_d")
    return lines.where(
        (F.col("kind") == "add") & F.col("file").isNotNull() & ~F.col("text").startswith("++")
        & F.col("new_line_lenient").isNotNull()
    ).select(*keys, "file", F.col("new_line_lenient").alias("line"), F.concat(F.lit("+"), "text").alias("text"))


def token_usage(calls: DataFrame, limit: int = C.MAX_TOTAL_TOKENS) -> DataFrame:
    return calls.groupBy("pr_id").agg(
        F.sum("tokens").alias("total_tokens"), F.count("*").alias("call_count"),
        (F.sum("tokens") >= limit).alias("exceeded"),
    )
