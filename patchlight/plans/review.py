"""Review plans: compositions of the operators, one lazy plan for all changes at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import columns as X
from patchlight.operators import findings as O
from patchlight.operators import graph as G
from patchlight.session import cut_lineage


def union_sources(*parts: DataFrame) -> DataFrame:
    """Reviewer, scanner and check findings as one relation; missing columns are null."""
    out = None
    for i, p in enumerate(parts):
        tagged = p.withColumn("source_no", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def blast_stage(prs: DataFrame, seeds: DataFrame, new_functions: DataFrame, blast: DataFrame,
                from_diff: DataFrame, enabled: bool = True) -> DataFrame:
    """Per change: why the graph stage was skipped, or its groups and callers."""
    graph = blast.groupBy("pr_id").agg(F.countDistinct("changed_fn").alias("g1"), F.count("*").alias("c1"))
    both = G.supplement(blast.select("pr_id", "changed_fn", "caller_file", "caller_start"),
                        from_diff.select("pr_id", "changed_fn", "caller_file", "caller_start"))
    extra = both.where("from_diff").groupBy("pr_id").agg(
        F.countDistinct("changed_fn").alias("g2"), F.count("*").alias("c2"))
    any_fn = seeds.select("pr_id").unionByName(new_functions.select("pr_id")).distinct().withColumn("_fn", F.lit(True))
    joined = prs.select("pr_id", "head_sha").join(any_fn, "pr_id", "left").join(graph, "pr_id", "left").join(extra, "pr_id", "left")
    reason = (
        F.when(F.lit(not enabled), "disabled").when(F.coalesce(F.length("head_sha"), F.lit(0)) == 0, "no_head_sha")
        .when(F.col("_fn").isNull(), "no_changed_functions"))
    total = lambda a, b: F.when(reason.isNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).otherwise(F.lit(0))
    return joined.select("pr_id", reason.alias("skip_reason"), total("g1", "g2").alias("groups"), total("c1", "c2").alias("callers"))


def judge(findings: DataFrame, import_checks: DataFrame | None = None, export_checks: DataFrame | None = None,
          min_confidence: float = C.MIN_CONFIDENCE, threshold: float = 0.8, severity: str = "WARNING") -> DataFrame:
    """Exact, then semantic de-duplication, contradicted claims, category, noise, severity."""
    kept = O.semantic_dedup(O.dedup_exact(findings).drop("first_ord"), threshold)
    if import_checks is not None:
        kept = O.drop_import_claims(kept, import_checks)
    if export_checks is not None:
        kept = O.drop_export_claims(kept, export_checks)
    return O.keep_severity(O.reduce_noise(O.recategorize(kept), min_confidence), severity)


def reviewer_failures(outcomes: DataFrame, deterministic: DataFrame) -> DataFrame:
    """pr_id, failed, aborted, error for changes that a reviewer ran on; outcomes: pr_id, place, agent, status, error_message.

    A change is aborted when none of its reviewers succeeded and neither scanner nor checks found anything (deterministic: pr_id); with such findings the
    review goes on with them alone. Reviewers of a change are a handful, and their notes stand in the order of their places.
    """
    bad = F.col("status") != "success"
    note = F.concat("agent", F.lit("("), "status", F.lit(": "), F.coalesce("error_message", F.lit("")), F.lit(")"))
    per = outcomes.groupBy("pr_id").agg(
        F.count_if(bad).alias("failed"), F.count_if(~bad).alias("_ok"), F.sort_array(F.collect_list(F.when(bad, F.struct("place", note.alias("note"))))).alias("_notes"))
    found = deterministic.select("pr_id").distinct().withColumn("_found", F.lit(True))
    joined = per.join(found, "pr_id", "left").withColumn("aborted", (F.col("_ok") == 0) & F.col("_found").isNull())
    notes = F.array_join(F.transform("_notes", lambda n: n["note"]), "; ")
    return joined.select("pr_id", "failed", "aborted", F.when(F.col("aborted"), F.concat(F.lit("no reviewer succeeded: "), notes)).alias("error"))


def review_input(findings: DataFrame, outcomes: DataFrame, scanner: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the judge gets, and reviewer_failures. findings: with pr_id and agent, from reviewers; only those of reviewers that succeeded count."""
    fails = reviewer_failures(outcomes, scanner.select("pr_id").unionByName(checks.select("pr_id")))
    good = findings.join(outcomes.where("status = 'success'").select("pr_id", "agent").distinct(), ["pr_id", "agent"], "left_semi")
    return union_sources(good, scanner, checks), fails


def impact_findings(pairs: DataFrame, reason: Column) -> DataFrame:
    """(finding, caller) pairs with a reason become findings at the caller, one step less severe."""
    return pairs.where(reason.isNotNull() & (reason != "")).select(
        "pr_id", F.col("caller_file").alias("file"), F.col("caller_start").alias("line"),
        F.concat(F.lit("Cross-file impact: "), "title").alias("title"),
        F.concat(F.lit("The issue in `"), "changed_fn", F.lit("` propagates to caller `"), "caller_name", F.lit("`: "), reason).alias("description"),
        X.downgrade(F.col("severity")).alias("severity"), X.impact_confidence(F.col("confidence")).alias("confidence"),
        "category", "impact_type", "impact_statement", F.array(reason).alias("evidence"),
        F.lit("CONTEXT").alias("evidence_source"),
    )


def caller_findings(callers: DataFrame, reason: Column, arg: Column | None = None) -> DataFrame:
    """Callers that pass a bad argument as findings."""
    fn = G.fn_short(F.col("changed_fn"))
    label = F.lit("") if arg is None else F.when(F.length(arg) > 0, F.concat(F.lit(" (arg: `"), arg, F.lit("`)"))).otherwise("")
    return callers.where((F.length("caller_file") > 0) & (F.length(reason) > 0)).select(
        "pr_id", F.col("caller_file").alias("file"), F.col("caller_start").alias("line"),
        F.concat(F.lit("Caller passes invalid argument to `"), fn, F.lit("`"), label).alias("title"),
        F.concat(F.lit("`"), "caller_name", F.lit("` in `"), "caller_file", F.lit("` calls `"), fn,
                 F.lit("` with a value the function does not handle: "), reason).alias("description"),
        F.lit("WARNING").alias("severity"), F.lit(0.75).alias("confidence"), F.lit("quality").alias("category"),
        F.lit("runtime_error").alias("impact_type"),
        F.concat(F.lit("Calling `"), fn, F.lit("` with this argument may cause a runtime error.")).alias("impact_statement"),
        F.array(reason).alias("evidence"), F.lit("CONTEXT").alias("evidence_source"),
    )


def assemble(prs: DataFrame, lines: DataFrame, judged: DataFrame,
             cross_file: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Published issues and one summary row per change. Issues stay rows; no per-change array is built.

    cross_file turns published findings into further findings at callers. Judged and published
    findings are each read more than once, so each is written once.
    """
    judged = cut_lineage(judged)
    gated = cut_lineage(O.publication_gate(judged, lines))
    issues = gated if cross_file is None else gated.unionByName(cross_file(gated), allowMissingColumns=True)
    before = judged.groupBy("pr_id").agg(F.count("*").alias("before_gate"))
    decided = O.decisions(prs, issues)
    merged = prs.select("pr_id", "title", F.size("files").cast("bigint").alias("files_changed")).join(decided, "pr_id").join(before, "pr_id", "left")
    summary = merged.select(
        "pr_id", F.col("title").alias("summary"), "files_changed", "risk_level", F.col("final_decision").alias("merge_recommendation"),
        "n_error", "n_warning", "n_info", F.coalesce("before_gate", F.lit(0)).alias("before_gate"),
        F.col("n").alias("after_gate"), (F.coalesce("before_gate", F.lit(0)) - F.col("n")).alias("filtered"),
    )
    return issues, summary
