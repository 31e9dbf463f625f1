"""Markdown reports as ordered blocks.

A report is rows (key, block, text) to be written sorted by key and block. A change with very many
findings thus never becomes one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import columns as X

HEAD, ITEM = 0, 1
#: Parts of a review body that has a walkthrough.
WALK, OPEN = 1, 2


def _s(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def review_markdown(samples: DataFrame, results: DataFrame, issues: DataFrame) -> DataFrame:
    """samples: id, url. results: id, summary, risk_level, merge_recommendation, n_issues. issues: id, ord, idx and finding columns."""
    head = samples.join(results, "id").select(
        "id", F.lit(HEAD).alias("part"), F.lit(0).cast("bigint").alias("idx"),
        F.concat_ws("\n", F.concat(F.lit("# "), "id"), F.lit(""), F.concat(F.lit("PR: "), "url"), F.concat(F.lit("Summary: "), _s("summary")),
                    F.concat(F.lit("Risk: "), _s("risk_level")), F.concat(F.lit("Recommendation: "), _s("merge_recommendation")),
                    F.concat(F.lit("Issues: "), _s("n_issues")), F.lit(""), F.lit("## Findings"),
                    F.when(F.col("n_issues") == 0, "\nNo findings.")).alias("text"))
    body = issues.select(
        "id", F.lit(ITEM).alias("part"), F.col("idx").cast("bigint").alias("idx"),
        F.concat_ws("\n", F.concat(F.lit("### "), _s("idx"), F.lit(". "), _s("title")), F.concat(F.lit("- severity: "), _s("severity")),
                    F.concat(F.lit("- file: "), _s("file"), F.lit(":"), _s("line")), F.concat(F.lit("- confidence: "), _s("confidence")),
                    F.concat(F.lit("- description: "), _s("description")), F.concat(F.lit("- evidence: "), F.coalesce(F.array_join("evidence", ", "), F.lit(""))),
                    F.lit("- human_label: TODO"), F.lit("- label_reason: TODO"), F.lit("")).alias("text"))
    return head.unionByName(body)


def score_markdown(scores: DataFrame, totals: DataFrame) -> DataFrame:
    """Blocks of a score table: totals, then one row per sample."""
    names = ["samples", "expected_total", "hit_count", "miss_count", "review_count", "noise_count", "duplicate_count", "clean_false_positives", "error_count"]
    head = totals.select(
        F.lit(HEAD).alias("part"), F.lit("").alias("id"),
        F.concat_ws("\n", F.lit("# Eval Score\n\n| metric | value |\n|---|---:|"),
                    *[F.concat(F.lit(f"| {n} | "), F.col(n).cast("string"), F.lit(" |")) for n in names],
                    F.lit("\n## Miss Reason Breakdown\n\n| reason | count |\n|---|---:|"),
                    *[F.concat(F.lit(f"| {n} | "), F.col(n).cast("string"), F.lit(" |")) for n in ("not_detected", "line_offset", "severity_miss")],
                    F.lit("\n## Samples\n\n| sample | expected | hits | misses | review | noise | dup | not_det | line_off | sev_miss |\n|---|---:|---:|---:|---:|---:|---:|---:|---:|---:|")).alias("text"))
    cols = ["expected_total", "hit_count", "miss_count", "review_count", "noise_count", "duplicate_count", "not_detected", "line_offset", "severity_miss"]
    rows = scores.select(
        F.lit(ITEM).alias("part"), F.col("pr_id").cast("string").alias("id"),
        F.concat(F.lit("| "), F.col("pr_id").cast("string"), F.lit(" | "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in cols]), F.lit(" |")).alias("text"))
    return head.unionByName(rows)


def _coverage_note(first: int = 5) -> Column:
    """What a reader of a large change's review must know: how much of it was read, and what was left out."""
    n = lambda c: F.col(c).cast("string")
    more = F.when(F.col("skipped_mechanical") > first, F.concat(F.lit(" and "), (F.col("skipped_mechanical") - first).cast("string"), F.lit(" more"))).otherwise("")
    paths = F.array_join(F.transform("skipped_first", lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ")
    left_out = F.when(F.col("skipped_mechanical") > 0, F.concat(F.lit("\n> Left out as mechanical edits: "), paths, more)).otherwise("")
    read = F.concat(F.lit("\n> Large change: "), n("reviewed"), F.lit(" of "), n("total"), F.lit(" files were read ("), n("changed_lines"), F.lit(" changed lines). Smaller changes get a full review."))
    return F.when(F.col("is_large_pr"), F.concat(read, left_out)).otherwise("")


def review_body(summary: DataFrame, coverage: DataFrame, fallback: DataFrame, walkthrough: DataFrame | None = None) -> DataFrame:
    """Blocks of a posted review: header, coverage note of large changes, walkthrough, rows of unplaced findings.

    summary: pr_id, risk_level, summary, changed_lines. coverage: pr_id, total, reviewed, is_large_pr,
    skipped_first (at most five paths), skipped_mechanical (count). fallback: pr_id, ord, severity, file, title. walkthrough: pr_id, ord, file, note; its
    rows stand in part WALK, and the heading of unplaced findings is a block of its own after them.
    """
    any_open = fallback.select("pr_id").distinct().withColumn("_open", F.lit(True))
    unplaced = F.lit("\n" + C.REVIEW_UNPLACED)
    below = F.when(F.col("_open"), unplaced).otherwise("") if walkthrough is None else F.lit("")
    head = summary.join(coverage, "pr_id", "left").join(any_open, "pr_id", "left").select(
        "pr_id", F.lit(HEAD).alias("part"), F.lit(0).cast("bigint").alias("ord"),
        F.concat(F.lit("## Review\n\n" + C.REVIEW_RISK), "risk_level", F.lit("\n\n" + C.REVIEW_SUMMARY), "summary", F.lit("\n"), F.coalesce(_coverage_note(), F.lit("")), below).alias("text"))
    first = ITEM if walkthrough is None else OPEN
    rows = fallback.select(
        "pr_id", F.lit(first).alias("part"), "ord",
        F.concat(F.lit("| "), X.inline_label(F.col("severity")), F.lit(" | `"), "file", F.lit("` | "), "title", F.lit(" |")).alias("text"))
    if walkthrough is None:
        return head.unionByName(rows)
    block = lambda df, part, text: df.select("pr_id").distinct().select("pr_id", F.lit(part).alias("part"), F.lit(-1).cast("bigint").alias("ord"), text.alias("text"))
    walk = walkthrough.select("pr_id", F.lit(WALK).alias("part"), "ord", F.concat(F.lit("| `"), "file", F.lit("` | "), "note", F.lit(" |")).alias("text"))
    return head.unionByName(block(walkthrough, WALK, F.lit("\n" + C.REVIEW_WALKTHROUGH))).unionByName(walk).unionByName(block(fallback, OPEN, unplaced)).unionByName(rows)
