"""Column functions shared by the operators. Everything stays on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlight import constants as C


def lookup(col: Column, mapping: dict, default) -> Column:
    """Constant map lookup written as one CASE, which codegen inlines."""
    out = None
    for key, value in mapping.items():
        hit = col == F.lit(key)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def severity_rank(severity: Column) -> Column:
    return lookup(severity, C.SEVERITY_RANK, C.UNKNOWN_RANK)


def scoring_rank(severity: Column) -> Column:
    return lookup(F.upper(severity), C.SCORING_RANK, 0)


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(C.CHARS_PER_TOKEN)).cast("bigint")


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any of a fixed word list occurs; short-circuits inside one expression."""
    cond = F.lit(False)
    for word in words:
        cond = cond | text.contains(word)
    return cond


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row; a plain alias would be inlined at every use."""
    return F.transform(F.array(value), body)[0]


def holds(value: Column, predicate) -> Column:
    """let for a predicate."""
    return F.exists(F.array(value), predicate)


def ends_with_any(text: Column, suffixes: list[str]) -> Column:
    cond = F.lit(False)
    for suffix in suffixes:
        cond = cond | text.endswith(suffix)
    return cond


def any_keyword(text: Column, keywords: Column) -> Column:
    """Case-insensitive; an empty or missing keyword list matches everything."""
    return (F.coalesce(F.size(keywords), F.lit(0)) <= 0) | holds(
        F.lower(text), lambda low: F.exists(keywords, lambda k: low.contains(F.lower(k))))


def finding_text(prefix: str = "") -> Column:
    """Lower-cased text of a finding, empty parts left out."""
    def part(name: str) -> Column:
        return F.when(F.length(F.col(prefix + name)) > 0, F.col(prefix + name))

    evidence = F.array_join(F.col(prefix + "evidence"), " ")
    return F.lower(
        F.concat_ws(
            " ", part("title"), part("description"), part("impact_statement"), part("diff_snippet"),
            F.when(F.length(evidence) > 0, evidence),
        )
    )


def issue_text(prefix: str = "") -> Column:
    """Text the scorer matches keywords against: one part per line, nothing left out."""
    return F.concat(
        F.coalesce(F.col(prefix + "title"), F.lit("")), F.lit("\n"),
        F.coalesce(F.col(prefix + "description"), F.lit("")), F.lit("\n"),
        F.coalesce(F.col(prefix + "impact_statement"), F.lit("None")), F.lit("\n"),
        F.coalesce(F.array_join(F.col(prefix + "evidence"), "\n"), F.lit("")),
    )


def judged_text(prefix: str = "") -> Column:
    return F.concat_ws(
        " — ",
        F.when(F.length(F.col(prefix + "title")) > 0, F.col(prefix + "title")),
        F.when(F.length(F.col(prefix + "description")) > 0, F.col(prefix + "description")),
    )


def word_set(text: Column) -> Column:
    """Distinct ASCII words of a text, the unit of the default similarity predicate."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return inter / (F.size(a) + F.size(b) - inter)


def downgrade(severity: Column) -> Column:
    return lookup(F.upper(severity), {"ERROR": "WARNING", "WARNING": "INFO", "INFO": "INFO"}, "WARNING")


def impact_confidence(confidence: Column) -> Column:
    return F.least(confidence * F.lit(0.85), F.lit(0.9))


def file_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def inline_label(severity: Column) -> Column:
    return lookup(F.upper(severity), C.INLINE_LABEL, F.concat(F.lit("**["), severity, F.lit("]**")))


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_suffix(path: Column) -> Column:
    """Text from the last dot of the name, when the dot is neither first nor last."""
    return F.regexp_extract(path_name(path), r"^.+(\.[^.]+)$", 1)


def path_stem(path: Column) -> Column:
    name = path_name(path)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def normal_path(path: Column) -> Column:
    """Fold '.' and '..' away; null when the path climbs out of the repository."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(acc.isNull(), acc)
        .when((p == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(p == "..", F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(folded, "/")


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def python_strip(text: Column) -> Column:
    """Strip blanks of the ASCII kind on both sides."""
    return F.btrim(text, F.lit(" \t\r\n\f\u000b"))
