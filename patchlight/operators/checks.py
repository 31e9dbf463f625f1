"""Import and export checks of changed lines against repository tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import columns as X
from patchlight.operators.similar import occupied_buckets
from patchlight.operators import names as N
from patchlight.session import cut_lineage


def package_checks(refs: DataFrame, deps: DataFrame, manifests: DataFrame) -> DataFrame:
    """refs: repo + reference columns with module. Declared packages pass; no manifest is unknown."""
    named = refs.withColumn("_package", N.package_name(F.col("module")))
    declared = deps.select("repo", F.col("package").alias("_package"), "section")
    has = manifests.select("repo", F.lit(True).alias("_has")).distinct()
    joined = named.join(declared, ["repo", "_package"], "left").join(has, "repo", "left")
    status = F.when(F.col("_has").isNull(), "unknown").when(F.col("section").isNotNull(), "pass").otherwise("fail")
    detail = (
        F.when(F.col("_has").isNull(), "package.json not found").when(F.col("section").isNotNull(), F.col("section"))
        .otherwise(F.concat("_package", F.lit(C.CHECK_UNDECLARED)))
    )
    return joined.withColumn("status", status).withColumn("detail", detail).withColumn(
        "target_file", F.lit(None).cast("string")).drop("_package", "section", "_has")


def _first_existing(tried: DataFrame, repo_files: DataFrame, keys: list[str], kept: list[Column]) -> DataFrame:
    """First candidate path that exists per key: one outer equi-join on (repo, path) and one aggregation."""
    there = repo_files.select("repo", F.col("file").alias("_cand"), F.lit(True).alias("_hit"))
    return tried.join(there, ["repo", "_cand"], "left").groupBy(*keys).agg(
        F.min_by("_cand", F.when(F.col("_hit"), F.col("_n"))).alias("target_file"), *kept)


def relative_targets(pairs: DataFrame, repo_files: DataFrame) -> DataFrame:
    """pairs: distinct repo, file, module. Adds target_file, status and detail."""
    based = pairs.withColumn("_base", X.normal_path(F.concat(X.parent_path(F.col("file")), "module")))
    tried = based.select(
        "repo", "file", "module", F.col("_base").isNull().alias("_out"),
        F.posexplode_outer(F.when(F.col("_base").isNotNull(), N.candidate_paths(F.col("_base"), C.CHECK_EXTENSIONS))).alias("_n", "_cand"))
    found = _first_existing(tried, repo_files, ["repo", "file", "module"], [F.max("_out").alias("_out")])
    hit = F.col("target_file").isNotNull()
    return found.select(
        "repo", "file", "module", "target_file",
        F.when(F.col("_out"), "unknown").when(hit, "pass").otherwise("fail").alias("status"),
        F.when(F.col("_out"), "relative import resolves outside repository").when(hit, F.col("target_file"))
        .otherwise(F.concat("module", F.lit(C.CHECK_NOT_FOUND), "file")).alias("detail"))


def alias_targets(pairs: DataFrame, rules: DataFrame, repo_files: DataFrame) -> DataFrame:
    """Path-alias modules through the repository's rules.

    rules is repo-scoped configuration; it travels as one array per repository inside an equi-join,
    so no broadcast of unknown size is needed.
    """
    per_repo = rules.groupBy("repo").agg(
        F.first("base_url").alias("base_url"),
        F.sort_array(F.collect_list(F.when(F.col("prefix").isNotNull(), F.struct("ord", "prefix", "suffix", "targets")))).alias("rules"),
    ).withColumn("_base", X.normal_path(F.col("base_url")))
    joined = pairs.join(per_repo, "repo", "left")
    hits = F.filter("rules", lambda r: F.col("module").startswith(r["prefix"]) & F.col("module").endswith(r["suffix"]))

    def paths(r: Column) -> Column:
        rest = F.substring(
            F.col("module"), F.length(r["prefix"]) + 1,
            F.greatest(F.length("module") - F.length(r["prefix"]) - F.length(r["suffix"]), F.lit(0)))
        lead = F.when(F.col("_base") == "", F.lit("")).otherwise(F.concat("_base", F.lit("/")))
        return F.transform(r["targets"], lambda t: X.normal_path(F.concat(lead, F.replace(t, F.lit("*"), rest))))

    bases = F.filter(F.flatten(F.transform(hits, paths)), lambda b: b.isNotNull())
    tried = joined.select(
        "repo", "file", "module", (F.coalesce(F.size("rules"), F.lit(0)) <= 0).alias("_unset"),
        F.col("_base").isNull().alias("_out"),
        F.posexplode_outer(F.flatten(F.transform(bases, lambda b: N.candidate_paths(b, C.CHECK_EXTENSIONS)))).alias("_n", "_cand"))
    found = _first_existing(tried, repo_files, ["repo", "file", "module"],
                            [F.max("_unset").alias("_unset"), F.max("_out").alias("_out")])
    hit = F.col("target_file").isNotNull()
    status = F.when(F.col("_unset") | F.col("_out"), "unknown").when(hit, "pass").otherwise("fail")
    detail = (
        F.when(F.col("_unset"), F.concat(F.lit(C.CHECK_ALIAS), "module", F.lit(C.CHECK_UNSET)))
        .when(F.col("_out"), "path alias baseUrl resolves outside repository").when(hit, F.col("target_file"))
        .otherwise(F.concat("module", F.lit(C.CHECK_NOT_FOUND), "file"))
    )
    return found.select("repo", "file", "module", F.when(status == "pass", F.col("target_file")).alias("target_file"),
                        status.alias("status"), detail.alias("detail"))


def module_targets(refs: DataFrame, rules: DataFrame, repo_files: DataFrame) -> DataFrame:
    """Resolution of each distinct relative or alias (repo, file, module)."""
    pairs = refs.select("repo", "file", "module").distinct()
    rel = relative_targets(pairs.where(N.is_relative(F.col("module"))), repo_files)
    ali = alias_targets(pairs.where(N.is_alias(F.col("module")) & ~N.is_relative(F.col("module"))), rules, repo_files)
    return rel.unionByName(ali)


def import_checks(imports: DataFrame, deps: DataFrame, manifests: DataFrame, rules: DataFrame,
                  repo_files: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """imports: repo, pr_id, file, line, module, statement. targets: module_targets, if already at hand."""
    local = N.is_relative(F.col("module")) | N.is_alias(F.col("module"))
    if targets is None:
        targets = module_targets(imports.where(local), rules, repo_files)
    by_path = imports.where(local).join(targets, ["repo", "file", "module"])
    by_package = package_checks(imports.where(~local), deps, manifests)
    return by_path.unionByName(by_package)


def export_checks(symbols: DataFrame, exports: DataFrame, rules: DataFrame, repo_files: DataFrame,
                  targets: DataFrame | None = None) -> DataFrame:
    """symbols: repo, pr_id, file, line, module, symbol, import_kind, statement."""
    if targets is None:
        targets = module_targets(symbols, rules, repo_files)
    stars = exports.groupBy("repo", F.col("file").alias("target_file")).agg(F.max("has_star").alias("_star"))
    names = exports.where("symbol is not null").select(
        "repo", F.col("file").alias("target_file"), "symbol", F.lit(True).alias("_named")).distinct()
    joined = (
        symbols.join(targets, ["repo", "file", "module"])
        .join(stars, ["repo", "target_file"], "left")
        .join(names, ["repo", "target_file", "symbol"], "left")
    )
    resolved = F.col("status") == "pass"
    status = (
        F.when(~resolved, F.col("status")).when(F.col("_named"), "pass").when(F.col("_star"), "unknown").otherwise("fail"))
    detail = (
        F.when(~resolved, F.col("detail")).when(F.col("_named"), "named export found")
        .when(F.col("_star"), "export * re-export requires recursive resolution")
        .otherwise(F.concat("symbol", F.lit(C.CHECK_NOT_EXPORTED), "target_file"))
    )
    return joined.select(
        *symbols.columns, F.when(status == "pass", F.col("target_file")).alias("target_file"),
        status.alias("status"), detail.alias("detail"))


def verify_changes(imports: DataFrame, symbols: DataFrame, deps: DataFrame, manifests: DataFrame, rules: DataFrame,
                   exports: DataFrame, repo_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import and export checks of the same changes. References and resolved modules are read by
    several joins, so each is written once; every distinct module is resolved once for both."""
    imports, symbols = cut_lineage(imports), cut_lineage(symbols)
    asked = imports.select("repo", "file", "module").unionByName(symbols.select("repo", "file", "module"))
    targets = cut_lineage(module_targets(asked, rules, repo_files))
    return (
        import_checks(imports, deps, manifests, rules, repo_files, targets),
        export_checks(symbols, exports, rules, repo_files, targets),
    )


def check_findings(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Failed checks as findings."""
    tick = F.lit("`")

    def build(df: DataFrame, title: str, description: Column, impact: Column) -> DataFrame:
        return df.where("status = 'fail'").select(
            "pr_id", "file", "line", F.lit(title).alias("title"), F.trim(description).alias("description"),
            F.lit("ERROR").alias("severity"), F.lit(1.0).alias("confidence"), F.lit("quality").alias("category"),
            F.lit("runtime_error").alias("impact_type"), impact.alias("impact_statement"),
            F.when(F.length("statement") > 0, F.array("statement")).alias("evidence"), F.lit("DIFF").alias("evidence_source"))

    imp = build(
        imports, "Unresolved import",
        F.concat(F.lit("The import "), tick, "module", tick, F.lit(" cannot be resolved. "), "detail"),
        F.concat(F.lit("Importing "), "module", F.lit(" fails at build time.")))
    exp = build(
        exports, "Missing named export",
        F.concat(F.lit("The symbol "), tick, "symbol", tick, F.lit(" is not exported by "), tick, "module", tick, F.lit(". "), "detail"),
        F.concat(F.lit("Importing "), "symbol", F.lit(" from "), "module", F.lit(" fails at build time.")))
    return imp.unionByName(exp)


def scan_paths(results: DataFrame, root: Column | None = None) -> DataFrame:
    """Scanner paths made relative to the checkout; absolute paths outside it are dropped."""
    if root is None:
        return results.where(F.length("path") > 0)
    clean = F.regexp_replace(root, "/+$", "")
    absolute = F.col("path").startswith("/")
    inside = F.col("path").startswith(F.concat(clean, F.lit("/")))
    return results.where((F.length("path") > 0) & (~absolute | inside)).withColumn(
        "path", F.when(absolute, F.substring(F.col("path"), F.length(clean) + 2, F.length("path"))).otherwise(F.col("path")))


SCAN_BUCKET = 64


def scan_hits(results: DataFrame, added: DataFrame) -> DataFrame:
    """Scanner rows whose range touches an added line; line and evidence are the first such line.

    results: pr_id, ord, check_id, path, start_line, end_line, message, severity. The range test is
    a residual of an equi-join on 64-line buckets. Added lines are read twice, so they are written once.
    """
    end = F.when(F.col("end_line") >= F.col("start_line"), F.col("end_line")).otherwise(F.col("start_line"))
    clean = results.where("start_line > 0").withColumn("end_line", end)
    uniq = clean.groupBy("pr_id", "path", "start_line", "end_line", "check_id").agg(
        F.min_by(F.struct("ord", "message", "severity"), "ord").alias("r")
    ).select("pr_id", F.col("path").alias("file"), "start_line", "end_line", "check_id", "r.ord", "r.message", "r.severity")
    points = cut_lineage(added.select("pr_id", "file", "line", "text", F.floor(F.col("line") / SCAN_BUCKET).alias("_b")))
    spans = occupied_buckets(uniq, points, ["pr_id", "file"], "start_line", "end_line", SCAN_BUCKET)
    first = (
        spans.join(points, ["pr_id", "file", "_b"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
        .groupBy("pr_id", "file", "start_line", "end_line", "check_id")
        .agg(F.min_by(F.struct("line", "text"), "line").alias("h"), F.first("ord").alias("ord"),
             F.first("message").alias("message"), F.first("severity").alias("severity"))
    )
    return first.select("pr_id", "file", "ord", "check_id", "start_line", "end_line", "message", "severity",
                        F.col("h.line").alias("line"), F.col("h.text").alias("text"))


def scan_findings(hits: DataFrame, category: str) -> DataFrame:
    return hits.select(
        "pr_id", "file", "line", F.substring_index("check_id", ".", -1).alias("title"), F.col("message").alias("description"),
        F.when(F.col("severity").isin("ERROR", "WARNING", "INFO"), F.col("severity")).otherwise("WARNING").alias("severity"),
        F.lit(0.95).alias("confidence"), F.lit(category).alias("category"),
        F.lit("security_risk" if category == "security" else "runtime_error").alias("impact_type"),
        F.col("message").alias("impact_statement"), F.array("text").alias("evidence"), F.lit("DIFF").alias("evidence_source"))
