"""Scoring of findings against golden findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.functions import columns as X
from patchlight.operators.matching import first_free
from patchlight.operators.similar import contained, occupied_buckets, salted_first, similar_sets
from patchlight.session import cut_lineage

HUNK_BUCKET = 64
#: Pairs of issues and goldens in one file up to which all of them are tested.
DIRECT_PAIRS = 10_000
#: Rows of a table up to which every task may hold it, so that issues are joined with it where they lie.
HELD_ROWS = 50_000


def severity_ok(issue: Column, expected: Column) -> Column:
    return (F.coalesce(F.length(expected), F.lit(0)) == 0) | (
        X.scoring_rank(F.coalesce(issue, F.lit("INFO"))) >= X.scoring_rank(expected) - 1)


def hunk_index(points: DataFrame, hunks: DataFrame) -> DataFrame:
    """First hunk holding a line, with one line of slack: points (pr_id, file, line) -> hunk.

    Equi-join on 64-line buckets with the range as residual. Points are compared once; two joins read them.
    """
    asked = cut_lineage(points.select("pr_id", "file", "line").where("line is not null").distinct()).withColumn(
        "_b", F.floor(F.col("line") / HUNK_BUCKET))
    spans = hunks.select("pr_id", "file", "hunk", (F.col("start_line") - 1).alias("lo"), (F.col("end_line") + 1).alias("hi"))
    spans = occupied_buckets(spans, asked, ["pr_id", "file"], "lo", "hi", HUNK_BUCKET)
    return (
        asked.join(spans, ["pr_id", "file", "_b"]).where(F.col("line").between(F.col("lo"), F.col("hi")))
        .groupBy("pr_id", "file", "line").agg(F.min("hunk").alias("hunk"))
    )


def _held(df: DataFrame) -> DataFrame:
    """A table by a checkpoint, to be joined with issues: handed to every task if it has few rows. Their number is counted, since a checkpoint keeps the
    sizes that were guessed for its plan."""
    return F.broadcast(df) if df.count() <= HELD_ROWS else df


def counted_lines(issues: DataFrame) -> DataFrame:
    """pr_id, file, line, n: how many issues a line has. Who asks for places or numbers of issues reads this and not all issues again."""
    return cut_lineage(issues.groupBy("pr_id", "file", "line").agg(F.count("*").alias("n")))


def with_hunks(issues: DataFrame, expected: DataFrame, hunks: DataFrame, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """issue_hunk on issues; golden_hunk and has_hunks on expected. lines: pr_id, file and line of the issues, where they are known.

    A golden range whose first line lies in hunk 0 takes the hunk of its last line; scores compare
    with published ones only under this rule.
    """
    points = (issues if lines is None else lines).select("pr_id", "file", "line").unionByName(
        expected.select("pr_id", "file", F.col("line_start").alias("line"))
    ).unionByName(expected.select("pr_id", "file", F.col("line_end").alias("line")))
    at = cut_lineage(hunk_index(points, hunks))
    files = hunks.select("pr_id", "file", F.lit(True).alias("_h")).distinct()
    left = issues.join(_held(at.withColumnRenamed("hunk", "issue_hunk")), ["pr_id", "file", "line"], "left")
    s = at.select("pr_id", "file", F.col("line").alias("line_start"), F.col("hunk").alias("_hs"))
    e = at.select("pr_id", "file", F.col("line").alias("line_end"), F.col("hunk").alias("_he"))
    right = (
        expected.join(s, ["pr_id", "file", "line_start"], "left").join(e, ["pr_id", "file", "line_end"], "left")
        .join(files, ["pr_id", "file"], "left")
        .withColumn("golden_hunk", F.when(F.col("_hs").isNull() | (F.col("_hs") == 0), F.col("_he")).otherwise(F.col("_hs")))
        .withColumn("has_hunks", F.coalesce("_h", F.lit(False))).drop("_hs", "_he", "_h")
    )
    return left, right


def _near_pairs(issues: DataFrame, goldens: DataFrame, hunk_gap: int = 2, lines: int = 50) -> DataFrame:
    """pr_id, file, issue_ord, expected_ord of pairs near one another: by hunk number where the file has hunks, else by line."""
    known = goldens.where("line_start IS NOT NULL AND line_end IS NOT NULL")
    steps = F.explode(F.sequence(F.col("golden_hunk") - hunk_gap, F.col("golden_hunk") + hunk_gap))
    by_hunk = known.where("has_hunks AND golden_hunk IS NOT NULL").select("pr_id", "file", "expected_ord", steps.alias("issue_hunk"))
    asked = issues.where("line IS NOT NULL")
    pairs = asked.where("issue_hunk IS NOT NULL").select("pr_id", "file", "issue_ord", "issue_hunk").join(by_hunk, ["pr_id", "file", "issue_hunk"]).drop("issue_hunk")
    points = asked.select("pr_id", "file", "issue_ord", "line", F.floor(F.col("line") / HUNK_BUCKET).alias("_b"))
    spans = known.where("NOT has_hunks").select("pr_id", "file", "expected_ord", (F.col("line_start") - lines).alias("_lo"), (F.col("line_end") + lines).alias("_hi"))
    spans = occupied_buckets(spans, points, ["pr_id", "file"], "_lo", "_hi", HUNK_BUCKET)
    by_line = points.join(spans, ["pr_id", "file", "_b"]).where(F.col("line").between(F.col("_lo"), F.col("_hi")))
    return pairs.unionByName(by_line.select("pr_id", "file", "issue_ord", "expected_ord"))


def _said_pairs(issues: DataFrame, goldens: DataFrame) -> DataFrame:
    """pr_id, file, issue_ord, expected_ord of pairs where a keyword of the golden stands in the issue's text, or a list of keywords asks for nothing."""
    file = ["pr_id", "file"]
    lists = goldens.select(*file, "expected_ord", F.explode(F.array("title_keywords", "evidence_keywords")).alias("_k"))
    lists = lists.withColumn("_k", F.transform(F.filter("_k", lambda k: k.isNotNull()), F.lower))
    words = lists.select(*file, "expected_ord", F.explode("_k").alias("word")).distinct()
    any_text = lists.where((F.coalesce(F.size("_k"), F.lit(0)) <= 0) | F.array_contains("_k", "")).select(*file, "expected_ord").distinct()
    texts = issues.withColumn("tid", F.sha2("_text", 256))
    distinct = texts.groupBy(*file, "tid").agg(F.first("_text").alias("text"))
    hits = contained(distinct, words.select(*file, "word"), file).join(words, [*file, "word"]).select(*file, "tid", "expected_ord").distinct()
    said = texts.select(*file, "tid", "issue_ord").join(hits, [*file, "tid"]).select(*file, "issue_ord", "expected_ord")
    return said.unionByName(issues.select(*file, "issue_ord").join(any_text, file).select(*file, "issue_ord", "expected_ord"))


def _says(keywords: str) -> Column:
    """A list of lower-cased keywords asks for nothing, or one of them stands in _text, which is lower-cased too."""
    return (F.coalesce(F.size(keywords), F.lit(0)) <= 0) | F.exists(keywords, lambda k: F.col("_text").contains(k))


def issue_pairs(issues: DataFrame, expected: DataFrame, hunks: DataFrame, direct: int = DIRECT_PAIRS, lines: DataFrame | None = None) -> DataFrame:
    """Flagged (issue, golden) pairs of the same file: is_match, is_review, reason. lines: counted_lines of the issues, where they are known.

    Issues in files without a golden have no pair and go before their hunks are looked up. A pair is flagged for its place or for its text. In a file with at most `direct` pairs all are tested; in a larger one the pairs come from two
    searches, by place (hunks or line buckets) and by an index of the keywords, so nothing but what they find is built.
    """
    file = ["pr_id", "file"]
    goldens = cut_lineage(expected.groupBy(*file).agg(F.count("*").alias("_g")))
    lines = (counted_lines(issues) if lines is None else lines).join(goldens, file)
    left, right = with_hunks(issues.join(_held(goldens.select(*file)), file, "left_semi"), expected, hunks, lines)
    i = left.select("pr_id", "file", F.col("ord").alias("issue_ord"), "line", F.col("severity").alias("issue_severity"),
                    F.lower(X.issue_text()).alias("_text"), "issue_hunk")
    lowered = [F.transform(k, F.lower).alias(k) for k in ("title_keywords", "evidence_keywords")]
    g = cut_lineage(right.select("pr_id", "file", F.col("ord").alias("expected_ord"), F.col("id").alias("expected_id"), "line_start", "line_end",
                                 *lowered, F.col("severity").alias("expected_severity"), "golden_hunk", "has_hunks"))
    large = cut_lineage(lines.groupBy(*file, "_g").agg(F.sum("n").alias("_i")).where(F.col("_i") * F.col("_g") > direct).select(*file))
    text_ok = _says("title_keywords") | _says("evidence_keywords")
    if large.isEmpty():
        return _flags(i.join(_held(g), file).withColumn("_t", text_ok))
    few = i.join(large, file, "left_anti").join(g, file).withColumn("_t", text_ok).drop("_text", "title_keywords", "evidence_keywords")
    i, g = cut_lineage(i.join(large, file, "left_semi")), cut_lineage(g.join(large, file, "left_semi"))
    found = _near_pairs(i, g).withColumn("_t", F.lit(False)).unionByName(_said_pairs(i, g).withColumn("_t", F.lit(True)))
    found = found.groupBy(*file, "issue_ord", "expected_ord").agg(F.max("_t").alias("_t"))
    found = found.join(i.drop("_text"), [*file, "issue_ord"]).join(g.drop("title_keywords", "evidence_keywords"), [*file, "expected_ord"])
    return _flags(few.unionByName(found))


def _flags(pairs: DataFrame) -> DataFrame:
    """The rules for a pair whose texts agree or not (_t); only pairs with a flag stay."""
    known = F.col("line").isNotNull() & F.col("line_start").isNotNull() & F.col("line_end").isNotNull()
    both = F.col("issue_hunk").isNotNull() & F.col("golden_hunk").isNotNull()
    gap = F.abs(F.col("issue_hunk") - F.col("golden_hunk"))

    def within(hunk_gap: int, lines: int) -> Column:
        return F.when(F.col("has_hunks"), both & (gap <= hunk_gap)).otherwise(
            F.col("line").between(F.col("line_start") - lines, F.col("line_end") + lines))

    false = F.lit(False)
    line_ok = F.when(known, F.coalesce(within(0, 5), false)).otherwise(True)
    near = F.when(known, F.coalesce(within(1, 20), false)).otherwise(False)
    broad = F.when(known, F.coalesce(within(2, 50), false)).otherwise(False)
    sev = severity_ok(F.col("issue_severity"), F.col("expected_severity"))
    flags = (
        pairs.withColumn("_n", near).withColumn("_b", broad)
        .where(F.col("_n") | F.col("_b") | F.col("_t"))
        .withColumn("is_match", line_ok & F.col("_t") & sev)
        .withColumn("is_review", F.col("_n") | F.col("_t"))
    )
    reason = F.when(F.col("_b") & F.col("_t") & ~sev, "severity_miss").when(~F.col("is_match"), "line_offset")
    return flags.select("pr_id", "file", "issue_ord", "expected_ord", "expected_id", "is_match", "is_review", reason.alias("reason"))


def match_constrained(pairs: DataFrame) -> DataFrame:
    """pr_id, matched (expected ords), duplicates: tightest issues take the first free golden; issues left without one are only counted."""
    lists = pairs.where("is_match").groupBy("pr_id", F.col("issue_ord").alias("chooser")).agg(F.array_sort(F.collect_list("expected_ord")).alias("items"))
    lists = cut_lineage(lists.withColumn("turn", F.struct(F.size("items").alias("n"), F.col("chooser").alias("ord"))))
    total = lists.groupBy("pr_id").agg(F.count("*").alias("all_issues"))
    taken = first_free(lists, ["pr_id"]).groupBy("pr_id").agg(F.array_sort(F.collect_list("item")).alias("matched"))
    return total.join(taken, "pr_id").select("pr_id", "matched", (F.col("all_issues") - F.size("matched")).alias("duplicates"))


def score_samples(samples: DataFrame, issues: DataFrame, expected: DataFrame, hunks: DataFrame) -> DataFrame:
    """Counts per sample: hits, misses by reason, review, noise, duplicates, clean false positives.

    samples has pr_id and may have error.
    """
    lines = counted_lines(issues)
    pairs = issue_pairs(issues, expected, hunks, lines=lines)
    pairs = cut_lineage(pairs.select("pr_id", "issue_ord", "expected_ord", "is_match", "is_review", "reason"))
    match = cut_lineage(match_constrained(pairs))
    taken = match.select("pr_id", F.explode("matched").alias("expected_ord"))
    matched_issues = pairs.where("is_match").select("pr_id", "issue_ord").distinct()
    loose = pairs.where("is_review").join(matched_issues, ["pr_id", "issue_ord"], "left_anti").join(
        taken, ["pr_id", "expected_ord"], "left_anti")
    first = loose.groupBy("pr_id", "issue_ord").agg(F.min("expected_ord").alias("expected_ord"))
    review = first.groupBy("pr_id").agg(F.countDistinct("expected_ord").alias("review_count"), F.count("*").alias("reviewed_issues"))
    hit_issues = matched_issues.groupBy("pr_id").agg(F.count("*").alias("matched_issue_count"))
    n_issues = lines.groupBy("pr_id").agg(F.sum("n").alias("issue_total"))
    n_expected = expected.groupBy("pr_id").agg(F.count("*").alias("expected_total"))
    reasons = pairs.where("reason is not null").groupBy("pr_id", "expected_ord").agg(F.min_by("reason", "issue_ord").alias("reason"))
    misses = expected.select("pr_id", F.col("ord").alias("expected_ord")).join(taken, ["pr_id", "expected_ord"], "left_anti").join(
        reasons, ["pr_id", "expected_ord"], "left")
    by_reason = misses.groupBy("pr_id").agg(
        F.count("*").alias("miss_count"),
        F.count_if(F.col("reason").isNull()).alias("not_detected"),
        F.count_if(F.col("reason") == "line_offset").alias("line_offset"),
        F.count_if(F.col("reason") == "severity_miss").alias("severity_miss"),
    )
    hits = match.select("pr_id", F.size("matched").cast("bigint").alias("hit_count"), F.col("duplicates").alias("duplicate_count"))
    out = samples
    for part in (n_expected, n_issues, hits, by_reason, review, hit_issues):
        out = out.join(part, "pr_id", "left")
    zero = ["expected_total", "issue_total", "hit_count", "miss_count", "review_count", "duplicate_count",
            "not_detected", "line_offset", "severity_miss", "reviewed_issues", "matched_issue_count"]
    out = out.select(*samples.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])
    noise = F.col("issue_total") - F.col("matched_issue_count") - F.col("reviewed_issues")
    return out.withColumn("noise_count", noise).withColumn(
        "clean_false_positives", F.when(F.col("expected_total") == 0, noise).otherwise(0)
    ).drop("reviewed_issues", "matched_issue_count")


def miss_reasons(issues: DataFrame, expected: DataFrame, hunks: DataFrame) -> DataFrame:
    """Reason per golden as if it were missed: that of the first issue that decides."""
    pairs = issue_pairs(issues, expected, hunks)
    reasons = pairs.where("reason is not null").groupBy("pr_id", "expected_ord").agg(F.min_by("reason", "issue_ord").alias("reason"))
    return expected.select("pr_id", F.col("ord").alias("expected_ord"), "id").join(reasons, ["pr_id", "expected_ord"], "left").withColumn(
        "reason", F.coalesce("reason", F.lit("not_detected")))


def totals(scores: DataFrame) -> DataFrame:
    cols = ["expected_total", "hit_count", "miss_count", "review_count", "noise_count", "duplicate_count",
            "clean_false_positives", "not_detected", "line_offset", "severity_miss"]
    error = F.count_if(F.length("error") > 0) if "error" in scores.columns else F.lit(0)
    return scores.agg(F.count("*").alias("samples"), *[F.sum(c).alias(c) for c in cols], error.alias("error_count"))


Judge = Callable[[DataFrame, DataFrame], DataFrame]


def word_judge(threshold: float = 0.3) -> Judge:
    """Default offline judge: word Jaccard. Takes goldens and findings (pr_id, words), returns matching
    (pr_id, lw, rw, sim). A model judge has the same form and may use mapInPandas on candidates."""
    return lambda goldens, findings: similar_sets(goldens, findings, ["pr_id"], threshold)


def _words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("words", F.array_sort(X.word_set(F.col(text))))


def score_prs(prs: DataFrame, goldens: DataFrame, findings: DataFrame, judge: Judge | None = None) -> DataFrame:
    """Per change: goldens hit by any finding and findings that hit any golden.

    goldens and findings: pr_id, text. Equal texts are judged once; the pair count is the product
    of two counts, so no golden-by-finding product is ever built.
    """
    g, f = _words(goldens, "text"), _words(findings, "text")
    hits = (judge or word_judge())(g.select("pr_id", "words"), f.select("pr_id", "words"))
    hit_g = g.join(hits.select("pr_id", F.col("lw").alias("words")).distinct(), ["pr_id", "words"], "left_semi")
    hit_f = f.join(hits.select("pr_id", F.col("rw").alias("words")).distinct(), ["pr_id", "words"], "left_semi")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("pr_id").agg(F.count("*").alias(name))

    out = prs.select("pr_id")
    for df, name in ((goldens, "golden_count"), (findings, "finding_count"), (hit_g, "tp_recall"), (hit_f, "tp_precision")):
        out = out.join(count(df, name), "pr_id", "left")
    out = out.select("pr_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("golden_count", "finding_count", "tp_recall", "tp_precision")])
    has_g, has_f = F.col("golden_count") > 0, F.col("finding_count") > 0
    return out.select(
        "*",
        F.when(has_f & has_g, F.round(F.col("tp_precision") / F.col("finding_count"), 3)).when(has_f, 0.0).alias("precision"),
        F.when(has_g & has_f, F.round(F.col("tp_recall") / F.col("golden_count"), 3)).when(has_g, 0.0).alias("recall"),
        (F.col("finding_count") - F.col("tp_precision")).alias("fp"), (F.col("golden_count") - F.col("tp_recall")).alias("fn"),
        (F.col("golden_count") * F.col("finding_count")).alias("pairs_judged"),
        F.when(~has_g & ~has_f, "no goldens and no findings").when(~has_f, "nothing reported")
        .when(~has_g, "no golden comments available").alias("note"),
    )


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision.isNull() | recall.isNull(), F.lit(None).cast("double")).when(precision + recall == 0, 0.0).otherwise(
        F.round(2 * precision * recall / (precision + recall), 3))


def micro(scores: DataFrame) -> DataFrame:
    """Micro average over changes with goldens."""
    agg = scores.where("golden_count > 0").agg(
        F.count("*").alias("total_prs"), F.sum("finding_count").alias("total_findings"), F.sum("golden_count").alias("total_goldens"),
        F.sum("tp_precision").alias("total_tp_precision"), F.sum("tp_recall").alias("total_tp_recall"),
        F.sum("fp").alias("total_fp"), F.sum("fn").alias("total_fn"))
    p = F.round(F.when(F.col("total_findings") > 0, F.col("total_tp_precision") / F.col("total_findings")), 3)
    r = F.round(F.when(F.col("total_goldens") > 0, F.col("total_tp_recall") / F.col("total_goldens")), 3)
    exact_p, exact_r = F.col("total_tp_precision") / F.nullif(F.col("total_findings"), F.lit(0)), F.col("total_tp_recall") / F.nullif(F.col("total_goldens"), F.lit(0))
    return agg.select("*", p.alias("precision"), r.alias("recall"), f1(exact_p, exact_r).alias("f1"))


def match_best_confidence(candidates: DataFrame, goldens: DataFrame) -> DataFrame:
    """pr_id, golden_ord, finding_ord, conf: each golden in order takes its best free finding above 0.5.

    At most (goldens - 1) findings can be taken before a golden's turn, so its best (goldens)
    candidates decide; longer candidate lists are cut to that, which changes no result.
    """
    n = goldens.groupBy("pr_id").agg(F.count("*").alias("_g"))
    able = candidates.where("conf > 0.5").join(n, "pr_id")
    few = cut_lineage(salted_first(able, ["pr_id", "golden_ord"], [F.col("conf").desc(), F.col("finding_ord")], F.col("finding_ord"), F.col("_g")).drop("_g"))
    liked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), F.col("finding_ord").alias("f")))), lambda x: x["f"])
    lists = few.groupBy("pr_id", F.col("golden_ord").alias("chooser")).agg(liked.alias("items")).withColumn("turn", F.col("chooser"))
    taken = first_free(lists, ["pr_id"]).select("pr_id", F.col("chooser").alias("golden_ord"), F.col("item").alias("finding_ord"))
    return taken.join(few, ["pr_id", "golden_ord", "finding_ord"]).select("pr_id", "golden_ord", "finding_ord", "conf")


def confidence_candidates(goldens: DataFrame, findings: DataFrame, threshold: float = 0.5) -> DataFrame:
    """pr_id, golden_ord, finding_ord, conf by word Jaccard; goldens and findings: pr_id, ord, text."""
    g, f = _words(goldens, "text"), _words(findings, "text")
    hits = similar_sets(g.select("pr_id", "words"), f.select("pr_id", "words"), ["pr_id"], threshold)
    # Of equal texts only the first ones can be taken by goldens, so each text offers as many as there are goldens.
    n = goldens.groupBy("pr_id").agg(F.count("*").alias("_g"))
    offer = salted_first(f.join(n, "pr_id"), ["pr_id", "words"], [F.col("ord")], F.col("ord"), F.col("_g"))
    return (
        hits.join(g.select("pr_id", F.col("words").alias("lw"), F.col("ord").alias("golden_ord")), ["pr_id", "lw"])
        .join(offer.select("pr_id", F.col("words").alias("rw"), F.col("ord").alias("finding_ord")), ["pr_id", "rw"])
        .select("pr_id", "golden_ord", "finding_ord", F.col("sim").alias("conf"))
    )


def score_semantic(samples: DataFrame, goldens: DataFrame, findings: DataFrame, matches: DataFrame) -> DataFrame:
    """tp, fp, fn per sample with goldens."""
    out = samples.join(goldens.groupBy("pr_id").agg(F.count("*").alias("g")), "pr_id")
    out = out.join(findings.groupBy("pr_id").agg(F.count("*").alias("f")), "pr_id", "left")
    out = out.join(matches.groupBy("pr_id").agg(F.count("*").alias("tp")), "pr_id", "left")
    tp, f = F.coalesce("tp", F.lit(0)), F.coalesce("f", F.lit(0))
    return out.select(*samples.columns, tp.alias("tp"), (f - tp).alias("fp"), (F.col("g") - tp).alias("fn"))


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Zero-safe precision, recall and F1."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def by_repo(scores: DataFrame) -> DataFrame:
    agg = scores.groupBy("repo").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r, f = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select("*", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def run_summary(runs: DataFrame) -> DataFrame:
    """runs: error, issue_count, elapsed."""
    ok = F.col("error").isNull()
    return runs.agg(
        F.count("*").alias("total"), F.count_if(~ok).alias("errors"),
        F.coalesce(F.sum(F.when(ok, F.col("issue_count"))), F.lit(0)).alias("total_issues"),
        (F.coalesce(F.sum(F.when(ok, F.col("elapsed"))), F.lit(0.0)) / F.greatest(F.count_if(ok), F.lit(1))).alias("avg_elapsed"))


def label_metrics(labels: DataFrame) -> DataFrame:
    """labels: pr_id, severity, has_evidence, label (TP, FP, PARTIAL), severity_wrong."""
    used = labels.where((F.col("severity") != "INFO") & F.col("has_evidence"))
    tp, fp = F.count_if(F.col("label") == "TP"), F.count_if(F.col("label") == "FP")
    return used.agg(
        tp.alias("tp"), fp.alias("fp"), F.count_if(F.col("label") == "PARTIAL").alias("partial"),
        F.when(tp + fp > 0, tp / (tp + fp)).alias("precision"), F.when(fp > 0, tp / fp).alias("snr"),
        (F.count_if("severity_wrong") / F.greatest(F.count("*"), F.lit(1))).alias("severity_error_rate"),
        (F.count("*") / F.greatest(F.countDistinct("pr_id"), F.lit(1))).alias("avg_comments"))


def compare_runs(a: DataFrame, b: DataFrame, tolerance: int = 1) -> DataFrame:
    """Finding counts of two runs per sample; ok when they differ by at most the tolerance."""
    left = a.groupBy("pr_id").agg(F.count("*").alias("n_a"))
    right = b.groupBy("pr_id").agg(F.count("*").alias("n_b"))
    j = left.join(right, "pr_id", "full_outer").select("pr_id", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return j.withColumn("ok", F.abs(F.col("n_a") - F.col("n_b")) <= tolerance)


def sample_pairs(goldens: DataFrame, findings: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random (golden, finding) pairs of the same change, each pair equally likely, without the product.

    A pair has a number: changes in a running total of golden x finding counts, then golden and
    finding numbers inside the change. n numbers are drawn and only they are decoded.
    """
    from pyspark.sql import Window as W

    from patchlight.operators.budget import running_total

    spark = goldens.sparkSession
    size = (
        goldens.groupBy("pr_id").agg(F.count("*").alias("ng"))
        .join(findings.groupBy("pr_id").agg(F.count("*").alias("nf")), "pr_id")
        .withColumn("size", F.col("ng") * F.col("nf")).withColumn("_one", F.lit(1))
    )
    cum = running_total(size, ["_one"], ["pr_id"], "size", "hi").withColumn("lo", F.col("hi") - F.col("size"))
    total = cum.agg(F.max("hi")).scalar()
    width = F.greatest(F.lit(1).cast("bigint"), F.floor(total / n).cast("bigint"))
    draws = spark.range(n * 2).select(F.pmod(F.xxhash64("id", F.lit(seed)), total).alias("x")).distinct().orderBy(
        F.xxhash64("x")).limit(n).withColumn("_b", F.floor(F.col("x") / width))
    # A change spans few cells of the number line, n of them in all beyond one per change.
    cells = cum.withColumn("_w", width).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("lo") / F.col("_w")), F.floor((F.col("hi") - 1) / F.col("_w")))))
    chosen = cells.join(draws, "_b").where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select(
        "pr_id", (F.col("x") - F.col("lo")).alias("off"), "nf"
    ).select("pr_id", F.floor(F.col("off") / F.col("nf")).alias("gi"), (F.col("off") % F.col("nf")).alias("fi"))
    # Only changes that were drawn are numbered.
    g = goldens.join(chosen.select("pr_id").distinct(), "pr_id", "left_semi").withColumn("gi", F.row_number().over(W.partitionBy("pr_id").orderBy("ord")) - 1)
    f = findings.join(chosen.select("pr_id").distinct(), "pr_id", "left_semi").withColumn("fi", F.row_number().over(W.partitionBy("pr_id").orderBy("ord")) - 1)
    return chosen.join(g.select("pr_id", "gi", F.col("ord").alias("golden_ord"), F.col("text").alias("golden")), ["pr_id", "gi"]).join(
        f.select("pr_id", "fi", F.col("ord").alias("finding_ord"), F.col("text").alias("finding")), ["pr_id", "fi"])
