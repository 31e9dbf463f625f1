"""Filters, de-duplication and publication rules over candidate findings.

De-duplication is always an aggregation (min_by), never a window: partial aggregation runs before
the shuffle, so a key that holds a large share of the rows reaches the reducer as a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import columns as X
from patchlight.session import cut_lineage

FINDING_KEY = ["pr_id", "file", "line", "title"]


def best_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the least by order."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return picked.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*df.columns)


def dedup_exact(findings: DataFrame) -> DataFrame:
    """Best severity per (file, line, title); the earliest wins a tie. The place of the first stays."""
    rank = X.severity_rank(F.col("severity"))
    rest = [c for c in findings.columns if c not in FINDING_KEY]
    picked = findings.groupBy(*FINDING_KEY).agg(
        F.min_by(F.struct(*rest), F.struct(rank, F.col("ord"))).alias("_b"),
        F.min("ord").alias("first_ord"),
    )
    return picked.select(
        *[F.col(c) if c in FINDING_KEY else F.col(f"_b.{c}").alias(c) for c in findings.columns],
        "first_ord",
    )


def is_comment(text: Column) -> Column:
    t = X.python_strip(text)
    cond = (t == "*")
    for start in ("# ", "#!", "//", "* ", "/*"):
        cond = cond | t.startswith(start)
    return cond


def line_marks(lines: DataFrame) -> DataFrame:
    """Visible new-side lines with a comment mark: the narrow side of every finding join."""
    return (
        lines.where(F.col("kind").isin("add", "ctx") & F.col("file").isNotNull())
        .groupBy("pr_id", "file", F.col("new_line").alias("line"))
        .agg(
            F.max(F.col("kind") == "add").alias("is_added"),
            F.min_by(is_comment(F.col("text")), "pos").alias("is_comment"),
        )
    )


def comment_findings(findings: DataFrame, lines: DataFrame) -> DataFrame:
    marks = line_marks(lines).where("is_comment").select("pr_id", "file", "line")
    return findings.join(marks, ["pr_id", "file", "line"], "left_semi")


def in_diff(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings without a line, or on a visible line."""
    marks = line_marks(lines).select("pr_id", "file", "line", F.lit(True).alias("_hit"))
    return (
        findings.join(marks, ["pr_id", "file", "line"], "left")
        .where(F.col("line").isNull() | F.col("_hit"))
        .select(*findings.columns)
    )


def evidence_matches(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings with an evidence text inside an added line of their file.

    Equal evidence texts of a file are tested once; the file's added text is at most one diff cell.
    """
    texts = (
        lines.where((F.col("kind") == "add") & F.col("file").isNotNull())
        .groupBy("pr_id", "file").agg(F.concat_ws("\n", F.collect_set("text")).alias("_added"))
    )
    evidence = findings.select("pr_id", "file", F.explode("evidence").alias("e")).distinct()
    plain = F.regexp_replace("e", r"^\++", "")
    proven = (
        evidence.join(texts, ["pr_id", "file"])
        .where(~plain.contains("\n") & F.col("_added").contains(plain))
        .select("pr_id", "file", "e")
    )
    hits = (
        findings.select("pr_id", "file", "ord", F.explode("evidence").alias("e"))
        .join(proven, ["pr_id", "file", "e"], "left_semi").select("pr_id", "ord").distinct()
    )
    return findings.join(hits, ["pr_id", "ord"], "left_semi").select(*findings.columns)


def publication_gate(findings: DataFrame, lines: DataFrame, strict: bool = False) -> DataFrame:
    """Findings that may be published, best per (file, line, title).

    strict adds the documented checks: the line must be an added line and evidence must match one.
    """
    marks = line_marks(lines)
    joined = findings.where(F.col("severity") != "INFO").join(marks, ["pr_id", "file", "line"], "left")
    context = F.col("evidence_source") == "CONTEXT"
    on_line = F.col("line").isNull() | (
        F.col("is_comment").isNotNull() & ~F.coalesce("is_comment", F.lit(False))
    )
    if strict:
        on_line = on_line & F.coalesce("is_added", F.col("line").isNull())
    passed = joined.where(
        (context & (F.coalesce(F.size("evidence"), F.lit(0)) > 0)) | (~context & on_line)
    ).select(*findings.columns)
    if strict:
        proven = evidence_matches(passed.where(~context), lines)
        passed = passed.where(context).unionByName(proven)
    order = F.struct(X.severity_rank(F.col("severity")), -F.col("confidence"), F.col("ord"))
    return best_by(passed, FINDING_KEY, order)


def frontend_guess() -> Column:
    path = F.concat(F.lit("/"), F.lower("file"))
    return (
        (F.col("category") == "security")
        & X.holds(path, lambda p: X.ends_with_any(p, C.FRONTEND_SUFFIXES) | X.contains_any(p, C.FRONTEND_PATHS))
        & X.holds(
            X.finding_text(),
            lambda t: X.contains_any(t, C.GUESS_WORDS) & X.contains_any(t, C.CLIENT_WORDS)
            & ~X.contains_any(t, C.SERVER_WORDS),
        )
    )


def weak_performance() -> Column:
    return (
        (F.col("category") == "performance") & (F.col("severity") == "WARNING")
        & X.holds(X.finding_text(), lambda t: X.contains_any(t, C.MICRO_WORDS) & ~X.contains_any(t, C.HARD_WORDS))
    )


def actionable() -> Column:
    return (
        ~frontend_guess() & ~weak_performance()
        & F.coalesce(F.lower(X.python_strip(F.col("impact_type"))).isin(C.IMPACT_TYPES), F.lit(False))
        & (X.python_strip(F.coalesce("impact_statement", F.lit(""))) != "")
    )


def reduce_noise(findings: DataFrame, min_confidence: float = C.MIN_CONFIDENCE_CALL) -> DataFrame:
    return findings.where((F.col("confidence") >= min_confidence) & actionable())


def keep_severity(findings: DataFrame, threshold: str = "WARNING") -> DataFrame:
    return findings.where(X.severity_rank(F.col("severity")) <= C.SEVERITY_RANK.get(threshold, 1))


def min_confidence(findings: DataFrame, value: float = C.MIN_CONFIDENCE) -> DataFrame:
    return findings.where((F.col("severity") != "INFO") & (F.col("confidence") >= value))


def guessed_category() -> Column:
    """Category with most keyword hits if it differs from the present one; ties keep the fixed order."""
    def scores(text: Column) -> Column:
        def hits(words: list[str]) -> Column:
            total = F.lit(0)
            for w in words:
                total = total + text.contains(w).cast("int")
            return total

        # The larger count wins; of equal counts the earlier category, hence the negated place.
        return F.array(*[
            F.struct(hits(words).alias("n"), F.lit(-i).alias("i"), F.lit(cat).alias("cat"))
            for i, (cat, words) in enumerate(C.CATEGORY_WORDS.items())
        ])

    text = F.lower(F.concat(F.col("title"), F.lit(" "), F.col("description")))
    return X.let(X.let(text, lambda t: F.array_max(scores(t))), lambda best: F.when(
        (best["n"] > 0) & (best["cat"] != F.col("category")), best["cat"]))


def recategorize(findings: DataFrame) -> DataFrame:
    return findings.withColumn("category", F.coalesce(guessed_category(), F.col("category")))


#: Lines in a bucket of findings that are compared; those near a border stand in two.
NEAR = 16


def semantic_dedup(findings: DataFrame, threshold: float = 0.8, reach: int = 3) -> DataFrame:
    """Drop a finding when a better one in the same file tells the same within three lines.

    Same means word Jaccard >= threshold on title and description. Equal word sets on one line
    collapse by aggregation first. The rest meet on (file, line bucket, prefix word): two sets
    reach the threshold only if their sorted prefixes share a word, so candidates stay few and none
    is lost. Rows of the join hold 64-bit hashes for sets and words; the sets that meet are compared by their words.
    Findings without line or words are kept.
    """
    order = F.struct(
        X.severity_rank(F.col("severity")).alias("r"), (-F.col("confidence")).alias("c"), F.col("ord").alias("o")
    )
    words = F.array_sort(X.word_set(F.concat_ws(" ", "title", "description")))
    ready = findings.withColumn("_w", words).withColumn("_o", order)
    alone = F.when(F.col("line").isNull() | (F.size("_w") == 0), F.col("ord"))
    reps = cut_lineage(
        ready.withColumn("_a", alone).groupBy("pr_id", "file", "line", "_w", "_a").agg(
            F.min_by(F.struct(*findings.columns), "_o").alias("_f"), F.min("_o").alias("_o")
        )
    )
    n = F.size("_w")
    prefix = F.slice("_w", F.lit(1), (n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1))
    some = reps.where("_a is null").select("pr_id", "file", "line", "_w", F.xxhash64("_w").alias("_h"), "_o")
    keyed = some.select("pr_id", "file", "line", "_h", F.col("_o.r").alias("r"), F.col("_o.c").alias("c"), F.col("_o.o").alias("o"),
                        F.explode(F.transform(prefix, lambda w: F.xxhash64(w))).alias("k"))
    near = F.sequence(F.floor((F.col("line") - reach) / NEAR), F.floor((F.col("line") + reach) / NEAR))
    left = keyed.withColumn("b", F.floor(F.col("line") / NEAR))
    right = keyed.select("pr_id", "file", "k", *[F.col(c).alias(f"{c}2") for c in ("line", "_h", "r", "c", "o")], F.explode(near).alias("b"))
    better = F.struct("r2", "c2", "o2") < F.struct("r", "c", "o")
    # Sets of words meet once for each two that stand near each other somewhere, and not in each row of the join.
    pairs = left.join(right, ["pr_id", "file", "k", "b"]).where(better & (F.abs(F.col("line") - F.col("line2")) <= reach))
    pairs = cut_lineage(pairs.select("pr_id", F.col("o").alias("ord"), "_h", "_h2").distinct())
    sets = some.groupBy("_h").agg(F.first("_w").alias("_w"))
    same = (
        pairs.select("_h", "_h2").distinct().join(sets, "_h")
        .join(sets.select(F.col("_h").alias("_h2"), F.col("_w").alias("_w2")), "_h2")
        .where(X.jaccard(F.col("_w"), F.col("_w2")) >= threshold).select("_h", "_h2")
    )
    beaten = pairs.join(same, ["_h", "_h2"], "left_semi").select("pr_id", "ord").distinct()
    return reps.select(*[F.col(f"_f.{c}").alias(c) for c in findings.columns]).join(
        beaten, ["pr_id", "ord"], "left_anti"
    ).select(*findings.columns)


def _drop_claims(findings: DataFrame, checks: DataFrame, name: str, claims: list[str]) -> DataFrame:
    """Drop findings that claim something a passed check of the same file disproves.

    Passed names of a file are distinct words of its import lines; they travel as one array per
    file, so a hot file's findings are not multiplied.
    """
    passed = checks.where(F.col("status") == "pass").groupBy("pr_id", "file").agg(
        F.collect_set(F.col(name)).alias("_passed")
    )
    joined = findings.join(passed, ["pr_id", "file"], "left")
    disproved = F.col("_passed").isNotNull() & X.holds(
        X.finding_text(), lambda t: X.contains_any(t, claims) & F.exists("_passed", lambda m: t.contains(m)))
    return joined.where(~disproved).select(*findings.columns)


def drop_import_claims(findings: DataFrame, import_checks: DataFrame) -> DataFrame:
    return _drop_claims(findings, import_checks, "module", C.IMPORT_CLAIMS)


def drop_export_claims(findings: DataFrame, export_checks: DataFrame) -> DataFrame:
    low = export_checks.withColumn("symbol", F.lower("symbol"))
    return _drop_claims(findings, low, "symbol", C.EXPORT_CLAIMS)


def decisions(prs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per change: merge decision of the judge, final decision, risk level, severity counts."""
    agg = findings.groupBy("pr_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("severity") == "ERROR").alias("n_error"),
        F.count_if(F.col("severity") == "WARNING").alias("n_warning"),
        F.count_if(F.col("severity") == "INFO").alias("n_info"),
    )
    z = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_error", "n_warning", "n_info")}
    base = prs.select("pr_id").join(agg, "pr_id", "left").select("pr_id", *z.values())
    return base.select(
        "*",
        F.when(F.col("n_error") > 0, "REQUEST_CHANGES").when(F.col("n_warning") > 0, "COMMENT")
        .otherwise("APPROVE").alias("merge_decision"),
        F.when(F.col("n") == 0, "APPROVE").when(F.col("n_error") > 0, "REQUEST_CHANGES")
        .otherwise("COMMENT").alias("final_decision"),
        F.when(F.col("n_error") > 0, "HIGH").when(F.col("n_warning") > 0, "MEDIUM")
        .otherwise("LOW").alias("risk_level"),
    )


def file_groups(findings: DataFrame) -> DataFrame:
    """Findings with their file group's size and first place; groups stay rows, never one array."""
    sizes = findings.groupBy("pr_id", "file").agg(
        F.count("*").alias("group_size"), F.min("ord").alias("group_ord")
    )
    return findings.join(sizes, ["pr_id", "file"])


def inline_split(findings: DataFrame, positions: DataFrame) -> DataFrame:
    """Diff position per finding; those without go to the fallback list."""
    pos = positions.groupBy("pr_id", "file", F.col("new_line").alias("line")).agg(
        F.max("position").alias("map_position"))
    joined = findings.join(pos, ["pr_id", "file", "line"], "left")
    own = F.col("position") if "position" in findings.columns else F.lit(None).cast("int")
    return joined.withColumn("inline_position", F.coalesce(own, F.col("map_position"))).withColumn(
        "is_fallback", F.col("inline_position").isNull()
    ).drop("map_position")


def inline_body(suggestion: Column | None = None) -> Column:
    """Text of a comment at a line; lines for what a finding does not have are left out."""
    def line(label: str, value: Column, mark: str = "") -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit("\n\n" + label + mark), value, F.lit(mark))).otherwise("")

    return F.concat(
        X.inline_label(F.col("severity")), F.lit(" **"), F.col("title"), F.lit("**\n\n"), F.col("description"),
        line(C.INLINE_IMPACT, F.col("impact_type"), "`"), line(C.INLINE_CONSEQUENCE, F.col("impact_statement")),
        F.lit("") if suggestion is None else line(C.INLINE_SUGGESTION, suggestion),
    )


def review_comments(findings: DataFrame) -> DataFrame:
    """path, line, body for a benchmark; a body seen before in the change is dropped."""
    body = F.concat(
        F.lit("["), X.lookup(F.col("severity"), C.COMMENT_LEVEL, "Medium"), F.lit("] "), F.col("title"),
        F.lit("\n\n"), F.col("description"),
    )
    rows = findings.select("pr_id", "ord", F.nullif(F.col("file"), F.lit("")).alias("path"), "line", body.alias("body"))
    return best_by(rows, ["pr_id", "body"], F.col("ord"))


def review_comments_raw(findings: DataFrame) -> DataFrame:
    return findings.select(
        "pr_id", "ord", F.col("file").alias("path"), "line",
        F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("title"), F.lit("\n\n"), F.col("description"))
        .alias("body"),
    )


def finding_row() -> list[str]:
    return ["file", "line", "title", "description", "severity", "confidence", "category", "impact_type",
            "impact_statement", "diff_snippet", "evidence", "token_cost"]
