"""Benchmark rows to samples and expected findings. Nested lists are turned inside the row, so no
importer groups or numbers rows of a whole change in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import columns as X
from patchlight.operators import diff as D
from patchlight.operators import findings as O
from patchlight.operators import names as N
from patchlight.operators.budget import running_total


def codereviewbench(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw: ord, testDescription, patch, referenceBugs, category, lang, prSummary. First row per test counts."""
    first = O.best_by(raw, ["testDescription"], F.col("ord"))
    sid = F.concat(F.lit("codereviewbench__"), X.slug(F.col("testDescription")))
    samples = first.select(
        sid.alias("id"), F.concat(F.lit("synthetic://codereviewbench/"), sid).alias("url"),
        F.concat(F.lit("codereviewbench-"), "category").alias("kind"), "lang", D.patch_convert(F.col("patch")).alias("synthetic_diff"),
        F.regexp_extract_all("patch", F.lit(r"(?dm)^## file: '([^']+)'"), F.lit(1)).alias("synthetic_files"),
        F.left(F.coalesce("prSummary", "testDescription"), F.lit(120)).alias("synthetic_pr_title"),
        F.coalesce("prSummary", F.lit("")).alias("synthetic_pr_description"), "referenceBugs",
    )
    bugs = samples.select("id", F.posexplode("referenceBugs").alias("i", "b"))
    start, end = F.col("b.relevantLinesStart"), F.col("b.relevantLinesEnd")
    expected = bugs.select(
        F.col("id").alias("sample_id"), F.concat("id", F.lit("-b"), (F.col("i") + 1).cast("string")).alias("id"),
        F.col("b.relevantFile").alias("file"), start.alias("line_start"), end.alias("line_end"), F.lit("ERROR").alias("severity"),
        F.concat(F.lit("Bug at lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" per CodeReviewBench ground truth")).alias("reason"),
    )
    return samples.drop("referenceBugs"), expected


def withmartian(items: DataFrame, skip_mirrors: bool = False) -> tuple[DataFrame, DataFrame]:
    """items: repo, idx, url, original_url, pr_title, comments[{comment, severity}]."""
    mirror = F.col("url").contains(C.MIRROR_MARK)
    original = F.coalesce("original_url", F.lit(""))
    use_original = mirror & (original != "") & ~original.contains("/commit/")
    sid = F.concat(F.lit("withmartian_"), "repo", F.lit("_"), (F.col("idx") + 1).cast("string"))
    kept = F.filter(
        F.transform("comments", lambda c, j: F.struct(
            j.alias("j"), X.python_strip(F.coalesce(c["comment"], F.lit(""))).alias("d"), F.coalesce(c["severity"], F.lit("Medium")).alias("s"))),
        lambda c: c["d"] != "",
    )
    samples = items.select(
        sid.alias("id"), F.when(use_original, original).otherwise(F.col("url")).alias("url"), F.col("repo").alias("repo_group"),
        (mirror & ~use_original).alias("is_mirror"), F.col("pr_title"), kept.alias("_c"),
    ).where((F.col("url") != "") & (F.size("_c") > 0))
    if skip_mirrors:
        samples = samples.where(~F.col("is_mirror"))
    expected = samples.select("id", F.explode("_c").alias("c")).select(
        F.col("id").alias("sample_id"), F.concat("id", F.lit("-g"), (F.col("c.j") + 1).cast("string")).alias("id"),
        F.col("c.d").alias("description"), X.lookup(F.col("c.s"), C.WITHMARTIAN_SEVERITY, "WARNING").alias("severity"),
        F.col("c.s").alias("severity_original"),
    )
    return samples.drop("_c"), expected


def functional_issue(title: Column, description: Column, rule: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(rule, F.lit(""))))
    return X.holds(text, lambda t: ~X.contains_any(t, C.QODO_STYLE) & X.contains_any(t, C.QODO_RISK))


def qodo(rows: DataFrame, max_findings: int = 2) -> tuple[DataFrame, DataFrame]:
    """rows: repo, pr_url_to_review, issues[{title, description, rule_name, file_path, start_line, end_line, problematic_code_snippet}]."""
    fit = F.filter("issues", lambda i: functional_issue(i["title"], i["description"], i["rule_name"]) & (F.length(i["file_path"]) > 0))
    sid = F.concat(
        F.lit("qodo-"), F.replace(F.replace(F.lower("repo"), F.lit("."), F.lit("-")), F.lit("/"), F.lit("-")), F.lit("-"),
        F.substring_index(F.regexp_replace("pr_url_to_review", "/+$", ""), "/", -1))
    base = rows.withColumn("_f", fit).where(F.size("_f") > 0).withColumn("id", sid)
    samples = base.select("id", F.concat(F.lit("agentic-review-benchmarks/"), "repo").alias("repo"), F.col("pr_url_to_review").alias("url"),
                          F.lit("qodo-pr-review-bench").alias("kind"))
    e = base.select("id", F.posexplode(F.slice("_f", 1, max_findings)).alias("k", "i"))
    start = F.coalesce(F.nullif("i.start_line", F.lit(0)), F.nullif("i.end_line", F.lit(0)), F.lit(1))
    expected = e.select(
        F.col("id").alias("sample_id"), F.concat("id", F.lit("-i"), (F.col("k") + 1).cast("string")).alias("id"), F.col("i.file_path").alias("file"),
        start.alias("line_start"), F.coalesce(F.nullif("i.end_line", F.lit(0)), start).alias("line_end"),
        N.keywords(F.coalesce("i.title", F.lit("")), F.col("i.file_path"), C.QODO_STOP).alias("title_keywords"),
        N.keywords(F.coalesce("i.problematic_code_snippet", F.lit("")), F.col("i.file_path"), C.QODO_STOP).alias("evidence_keywords"),
        F.lit("WARNING").alias("severity"), X.python_strip(F.coalesce(F.nullif("i.description", F.lit("")), F.col("i.title"), F.lit(""))).alias("reason"),
    )
    return samples, expected


def human_comment(author: Column, body: Column, path: Column, line: Column) -> Column:
    return (
        X.holds(F.lower(F.coalesce(author, F.lit(""))), lambda a: ~X.contains_any(a, C.SWE_BOTS))
        & X.holds(F.lower(F.coalesce(body, F.lit(""))), lambda b: (F.length(b) >= 30) & ~X.contains_any(b, C.SWE_LOW_SIGNAL) & X.contains_any(b, C.SWE_RISK))
        & (F.coalesce(F.length(path), F.lit(0)) > 0) & line.isNotNull()
    )


def swe_prbench(rows: DataFrame, max_findings: int = 3) -> tuple[DataFrame, DataFrame]:
    """rows: task_id, repo, pr_url, language, difficulty, human_review_comments[{author, body, path, line, diffHunk}]."""
    base = rows.where("language = 'Python'").withColumn(
        "_c", F.filter("human_review_comments", lambda c: human_comment(c["author"], c["body"], c["path"], c["line"]))
    ).where(F.size("_c") > 0)
    samples = base.select(F.col("task_id").alias("id"), "repo", F.col("pr_url").alias("url"),
                          F.concat(F.lit("swe-prbench-"), F.coalesce("difficulty", F.lit("unknown"))).alias("kind"))
    e = base.select("task_id", F.posexplode(F.slice("_c", 1, max_findings)).alias("k", "c"))
    expected = e.select(
        F.col("task_id").alias("sample_id"), F.concat("task_id", F.lit("-c"), (F.col("k") + 1).cast("string")).alias("id"), F.col("c.path").alias("file"),
        F.col("c.line").alias("line_start"), F.col("c.line").alias("line_end"),
        N.keywords(F.coalesce("c.body", F.lit("")), F.col("c.path"), C.SWE_STOP).alias("title_keywords"),
        N.keywords(F.coalesce("c.diffHunk", F.lit("")), F.col("c.path"), []).alias("evidence_keywords"),
        F.lit("WARNING").alias("severity"), X.python_strip(F.coalesce("c.body", F.lit(""))).alias("reason"),
    )
    return samples, expected


def aacr(rows: DataFrame, lang: str | None = None, context: str | None = None, limit: int | None = None) -> DataFrame:
    """Expected findings of positive rows, numbered per change in row order.

    rows: ord, pr_url, label, path, from_line, to_line, note, category, context, project_main_language.
    Numbers come from the slice-wise running total, so a change with most rows is not one task.
    """
    kept = rows.where("label = 1")
    if lang:
        kept = kept.where(F.lower("project_main_language") == lang.lower())
    if context:
        kept = kept.where(F.col("context") == C.AACR_CONTEXT[context])
    if limit:
        first = kept.select("pr_url").distinct().orderBy("pr_url").limit(limit)
        kept = kept.join(first, "pr_url", "left_semi")
    parts = F.split(F.regexp_replace("pr_url", "/+$", ""), "/")
    sid = F.concat_ws("_", F.lit("aacr"), F.try_element_at(parts, F.lit(-4)), F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-1)))
    numbered = running_total(kept.withColumn("_one", F.lit(1)), ["pr_url"], ["ord"], "_one", "n")
    both = (F.coalesce("from_line", F.lit(0)) > 0) & (F.coalesce("to_line", F.lit(0)) > 0)
    return numbered.select(
        sid.alias("sample_id"), F.concat(sid, F.lit("-g"), F.col("n").cast("string")).alias("id"), "pr_url",
        F.coalesce("path", F.lit("")).alias("file"), F.when(both, F.col("from_line")).alias("line_start"), F.when(both, F.col("to_line")).alias("line_end"),
        X.python_strip(F.coalesce("note", F.lit(""))).alias("description"), X.lookup(F.col("category"), C.AACR_SEVERITY, "WARNING").alias("severity"),
        F.coalesce("project_main_language", F.lit("")).alias("language"),
    )


def language_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def import_totals(samples: DataFrame, expected: DataFrame) -> DataFrame:
    n = samples.agg(F.count("*").alias("samples"))
    per = expected.join(samples.select(F.col("id").alias("sample_id")), "sample_id", "left_semi").agg(F.count("*").alias("expected"))
    return n.withColumn("expected", per.scalar())


def pick_samples(samples: DataFrame, order: str, lang: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Importer options: language, category, then the first limit in order."""
    out = samples
    if lang:
        out = out.where(F.col("lang") == lang)
    if category:
        out = out.where(F.col("kind").endswith("-" + category))
    return out.orderBy(order).limit(limit) if limit else out


def benchmark_prs(entries: DataFrame, urls: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """entries: ord, url, original_url, pr_title, source_file."""
    out = entries.select("ord", "url", F.coalesce(F.nullif("original_url", F.lit("")), F.col("url")).alias("original_url"),
                         F.coalesce("pr_title", F.lit("")).alias("pr_title"), "source_file")
    if urls:
        return out.where(F.col("url").isin(urls))
    return out.orderBy("ord").limit(limit) if limit else out


def golden_join(runs: DataFrame, goldens: DataFrame) -> DataFrame:
    """Runs with the goldens of their URL; a run without any keeps an empty array. A later entry of a URL wins."""
    last = goldens.groupBy("url").agg(F.max_by("golden_comments", "ord").alias("golden_comments"))
    empty = F.array().cast(goldens.schema["golden_comments"].dataType)
    return runs.join(last, "url", "left").withColumn("golden_comments", F.coalesce("golden_comments", empty))
