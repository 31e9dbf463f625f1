"""Names, imports and exports read from changed lines and source files with built-in regex functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import columns as X

# --- fixed values: patterns of definitions, imports and exports --------------------------
PY_DEF = r"^\s*(?:async\s+)?def\s+(\w+)\s*\("
JS_FUNCTION = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*\("
JS_ARROW = r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s+)?\("
JS_METHOD = r"^\s{2,}(?:(?:public|private|protected|static|override|abstract)\s+)*(?:async\s+)?(\w+)\s*\("
SYMBOL_IMPORTS = [
    r"^.*?\bimport\s+(?:\w+\s*,\s*)?\{?\s*(\w+)\s*\}?\s+from\s+['\"]",
    r"^.*?\bfrom\s+['\"]\S+['\"]\s+import\s+\{?\s*(\w+)",
    r"^.*?\bimport\s+(\w+)",
    r"^.*?\buse\s+(?:\w+::)*(\w+)",
]
SYMBOL_CALL = r"^.*?\b(\w+)\s*\("
JS_IMPORT = r"^\s*import\s+(?:type\s+)?(?:.+?\s+from\s+)?[\"']([^\"']+)[\"']\s*;?\s*$"
JS_REQUIRE = r"^\s*(?:const|let|var)\s+.+?=\s*require\([\"']([^\"']+)[\"']\)\s*;?\s*$"
JS_DYNAMIC = r"\bimport\([\"']([^\"']+)[\"']\)"
JS_NAMED = r"^\s*import\s+(?:type\s+)?\{(.+)\}\s+from\s+[\"']([^\"']+)[\"']\s*;?\s*$"
EXPORT_DECLARED = (
    r"(?m)^\s*export\s+(?:declare\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+(\w+)"
)
EXPORT_BRACES = r"(?m)^\s*export\s+\{([^}]+)\}"
EXPORT_STAR = r"(?m)^\s*export\s+\*\s+from\s+[\"']"
TS_IMPORT_FROM = (
    r"\bimport\s+(?:type\s+)?((?:\{[^}]*\}|\*\s+as\s+\w+|\w+)(?:\s*,\s*(?:\{[^}]*\}|\w+))*)\s+from\s+['\"]([^'\"]+)['\"]"
)
TS_EXPORT_FROM = r"\bexport\s+(?:type\s+)?\{([^}]*)\}\s*from\s+['\"]([^'\"]+)['\"]"


def _first(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def defined_names(lines: DataFrame, methods: bool) -> DataFrame:
    """(key, name) defined on added lines; methods adds the indented class-method form."""
    patterns = [PY_DEF, JS_FUNCTION, JS_ARROW] + ([JS_METHOD] if methods else [])
    names = F.array(*[_first("text", p) for p in patterns])
    return (
        lines.where("kind = 'add'")
        .select("pr_id", F.explode(names).alias("name"))
        .where(F.col("name").isNotNull() & ~F.col("name").isin(C.NOT_FUNCTIONS) & (F.length("name") > 1))
        .distinct()
    )


def changed_functions(lines: DataFrame) -> DataFrame:
    return defined_names(lines, methods=True)


def new_functions(lines: DataFrame) -> DataFrame:
    return defined_names(lines, methods=False)


def diff_symbols(lines: DataFrame) -> DataFrame:
    """Symbols imported or called on added lines, first match per line and pattern, builtins left out.

    ord is the place of the first occurrence, so that "the first ten" is well defined.
    """
    found = F.array(
        *[F.struct(_first("text", p).alias("name"), F.lit(False).alias("call")) for p in SYMBOL_IMPORTS],
        F.struct(_first("text", SYMBOL_CALL).alias("name"), F.lit(True).alias("call")),
    )
    rows = lines.where("kind = 'add'").select("pr_id", "pos", F.explode(found).alias("s")).select(
        "pr_id", "pos", F.col("s.name").alias("symbol"), F.col("s.call").alias("call"))
    return (
        rows.where(
            F.col("symbol").isNotNull() & ~F.col("symbol").isin(C.BUILTIN_SYMBOLS)
            & ~(F.col("call") & F.col("symbol").isin(C.NOT_CALLS))
        )
        .groupBy("pr_id", "symbol").agg(F.min("pos").alias("ord"))
    )


def import_lines(lines: DataFrame) -> DataFrame:
    """Added lines that can hold an import: all that `js_imports` and `js_symbols` look at."""
    some = F.col("text").contains("import") | F.col("text").contains("require")
    return lines.where((F.col("kind") == "add") & F.col("file").isNotNull() & some).select("pr_id", "file", "new_line_lenient", "kind", "text")


def js_imports(lines: DataFrame) -> DataFrame:
    """Imports on added lines, numbered the lenient way."""
    module = F.coalesce(_first("text", JS_IMPORT), _first("text", JS_REQUIRE), _first("text", JS_DYNAMIC))
    return (
        lines.where((F.col("kind") == "add") & F.col("file").isNotNull())
        .select("pr_id", "file", F.col("new_line_lenient").alias("line"), module.alias("module"),
                X.python_strip(F.col("text")).alias("statement"))
        .where("module is not null")
    )


def is_relative(module: Column) -> Column:
    return module.startswith("./") | module.startswith("../")


def is_alias(module: Column) -> Column:
    return module.startswith("@/") | module.startswith("~/") | module.startswith("#/")


def import_kind(module: Column) -> Column:
    return F.when(is_relative(module), "relative").when(is_alias(module), "alias").otherwise("package")


def package_name(module: Column) -> Column:
    return F.when(
        module.startswith("@") & module.contains("/"), F.substring_index(module, "/", 2)
    ).otherwise(F.substring_index(module, "/", 1))


def js_symbols(lines: DataFrame) -> DataFrame:
    """Named imports of relative or alias modules, one row per original name."""
    code = lines.where((F.col("kind") == "add") & F.col("file").isNotNull()).select(
        "pr_id", "file", F.col("new_line_lenient").alias("line"), X.python_strip(F.col("text")).alias("statement"))
    hit = code.select(
        "*", _first("statement", JS_NAMED, 1).alias("_names"), _first("statement", JS_NAMED, 2).alias("module")
    ).where("_names is not null")
    named = hit.where(is_relative(F.col("module")) | is_alias(F.col("module")))
    base = F.transform(
        F.transform(F.split("_names", ","), X.python_strip),
        lambda p: X.python_strip(F.regexp_replace(F.regexp_replace(p, r"(?s)\s+as\s+.*$", ""), "^type ", "")),
    )
    return named.select(
        "pr_id", "file", "line", "module", F.explode(base).alias("symbol"), F.lit("named").alias("import_kind"), "statement"
    ).where((F.col("symbol") != "") & (F.col("symbol") != "type"))


def js_exports(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbol, has_star for each source file; a file without exports keeps one null row."""
    part = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(EXPORT_BRACES), F.lit(1)), lambda b: F.split(b, ",")))
    named = F.filter(
        F.transform(
            F.transform(part, X.python_strip),
            lambda p: X.python_strip(F.regexp_replace(p, r"(?s)^.*?\s+as\s+", "")),
        ),
        lambda s: s != "",
    )
    declared = F.regexp_extract_all("content", F.lit(EXPORT_DECLARED), F.lit(1))
    return files.select(
        *keys, F.col("content").rlike(EXPORT_STAR).alias("has_star"),
        F.explode_outer(F.array_union(declared, named)).alias("symbol"),
    )


def py_imports(files: DataFrame, keys: list[str]) -> DataFrame:
    """Python import bindings with the source path they point at; keys end with the file path column."""
    path = keys[-1]
    rows = files.select(*keys, F.explode(F.split("content", "\n")).alias("row"))
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rest = F.regexp_replace("module", r"^\.+", "")
    dirs = F.filter(F.split(X.parent_path(F.col(path)), "/"), lambda p: p != "")
    up = dots - 1
    base_dir = F.when(up <= F.size(dirs), F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - up, F.lit(0))))
    relative = F.when(
        (rest != "") & (up <= F.size(dirs)),
        F.concat(F.array_join(F.concat(base_dir, F.split(rest, r"\.")), "/"), F.lit(".py")),
    )
    froms = rows.select(
        *keys, _first("row", r"^from\s+(\S+)\s+import\s+(.+)$", 1).alias("module"),
        _first("row", r"^from\s+(\S+)\s+import\s+(.+)$", 2).alias("names"),
    ).where("module is not null").select(
        *keys,
        F.when(F.col("module").startswith("."), relative).otherwise(
            F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit(".py"))).alias("source_file"),
        F.explode(F.split(F.regexp_replace(X.python_strip(F.col("names")), r"^\(", ""), ",")).alias("part"),
    ).select(*keys, "source_file", X.python_strip(F.regexp_replace(X.python_strip(F.col("part")), r"^\)+|\)+$", "")).alias("part"))
    from_rows = froms.where("part <> '' and source_file is not null").select(
        *keys, F.coalesce(_first("part", r"^.+?\s+as\s+(\S+)"), F.col("part")).alias("name"), "source_file")
    plain = rows.select(*keys, _first("row", r"^import\s+(.+)$").alias("names")).where("names is not null").select(
        *keys, F.explode(F.split("names", ",")).alias("part")
    ).withColumn("part", X.python_strip(F.col("part"))).where("part <> ''")
    target = X.python_strip(F.coalesce(_first("part", r"^(.+?)\s+as\s+\S+"), F.col("part")))
    plain_rows = plain.select(
        *keys, F.coalesce(_first("part", r"^.+?\s+as\s+(\S+)"), F.col("part")).alias("name"),
        F.concat(F.replace(target, F.lit("."), F.lit("/")), F.lit(".py")).alias("source_file"))
    return from_rows.unionByName(plain_rows)


def candidate_paths(base: Column, extensions: list[str]) -> Column:
    """Paths tried for a module, in order: as is, with each extension, then each index file."""
    return F.array(
        base, *[F.concat(base, F.lit(e)) for e in extensions],
        *[F.concat(base, F.lit("/index" + e)) for e in extensions],
    )


def ts_imports(files: DataFrame, keys: list[str], extensions: list[str] = C.INDEX_EXTENSIONS, all_files: DataFrame | None = None) -> DataFrame:
    """TS/JS local bindings of relative imports and re-exports, resolved to files that exist (all_files, where files are some of them)."""
    path = keys[-1]
    def pairs(pattern: str) -> Column:
        return F.arrays_zip(
            F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("spec"),
            F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("module"),
        )
    found = files.select(*keys, F.explode(pairs(TS_IMPORT_FROM)).alias("p"), F.lit(True).alias("is_import")).unionByName(
        files.select(*keys, F.explode(pairs(TS_EXPORT_FROM)).alias("p"), F.lit(False).alias("is_import"))
    ).select(*keys, F.col("p.spec").alias("spec"), F.col("p.module").alias("module"), "is_import").where(
        F.col("module").startswith("."))
    braces = F.when(F.col("is_import"), F.regexp_extract("spec", r"(?s)\{([^}]*)\}", 1)).otherwise(F.col("spec"))
    inner = F.transform(
        F.split(braces, ","),
        lambda p: F.regexp_replace(X.python_strip(F.regexp_replace(X.python_strip(p), r"^type\s+", "")), r"(?s)^(\w+)\s+as\s+(\w+).*$", "$2"),
    )
    remainder = F.regexp_replace("spec", r"(?s)\{[^}]*\}", "")
    space = F.regexp_extract(remainder, r"\*\s+as\s+(\w+)", 1)
    bare = F.regexp_replace(F.regexp_replace(remainder, r"\*\s+as\s+\w+", ""), r"^[\s,]+|[\s,]+$", "")
    names = F.filter(
        F.when(F.col("is_import"), F.concat(inner, F.array(space, bare))).otherwise(inner), lambda n: n.rlike(r"^\w+$"))
    named = found.select(*keys, "module", F.explode(names).alias("name"))
    based = named.withColumn("_base", X.normal_path(F.concat(X.parent_path(F.col(path)), "module")))
    tried = based.where("_base is not null").select(
        *keys, "module", "name", F.posexplode(candidate_paths(F.col("_base"), extensions)).alias("_n", "_cand"))
    scope = [k for k in keys if k != path]
    existing = (files if all_files is None else all_files).select(*scope, F.col(path).alias("_cand"))
    return (
        tried.join(existing, [*scope, "_cand"])
        .groupBy(*keys, "module", "name").agg(F.min_by("_cand", "_n").alias("source_file"))
        .select(*keys, "name", "source_file")
    )


def _packages(section: str, place: int) -> Column:
    names = F.coalesce(F.map_keys(f"j.{section}"), F.array().cast("array<string>"))
    return F.transform(
        names, lambda p: F.struct(p.alias("package"), F.lit(section).alias("section"), F.lit(place).alias("i")))


def dependencies(manifests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, package, section) of a manifest; a later section wins. Bad JSON gives no rows."""
    schema = "struct<" + ",".join(f"{s}:map<string,string>" for s in C.DEPENDENCY_SECTIONS) + ">"
    parsed = manifests.select(*keys, F.from_json("content", schema).alias("j"))
    rows = parsed.select(
        *keys,
        F.explode(F.flatten(F.array(*[
            _packages(s, i) for i, s in enumerate(C.DEPENDENCY_SECTIONS)
        ]))).alias("d"),
    ).select(*keys, "d.package", "d.section", "d.i")
    return rows.groupBy(*keys, "package").agg(F.max_by("section", "i").alias("section"))


def alias_rules(configs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, base_url, ord, prefix, suffix, targets) from path-alias configs.

    configs: keys, path, content. The first config file found counts, even if it cannot be parsed.
    """
    place = X.lookup(X.path_name(F.col("path")), {n: i for i, n in enumerate(C.ALIAS_CONFIG_FILES)}, 99)
    first = configs.where(place < 99).groupBy(*keys).agg(F.min_by("content", place).alias("content"))
    schema = "struct<compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>"
    parsed = first.select(*keys, F.from_json("content", schema).alias("j"))
    rules = parsed.select(
        *keys, F.coalesce("j.compilerOptions.baseUrl", F.lit(".")).alias("base_url"),
        F.posexplode_outer(F.map_entries("j.compilerOptions.paths")).alias("ord", "e"),
    )
    star = F.col("e.key").contains("*")
    return rules.where(
        F.col("e").isNull() | ((F.regexp_count("e.key", F.lit(r"\*")) <= 1) & (F.size("e.value") > 0))
    ).select(
        *keys, "base_url", "ord",
        F.when(star, F.substring_index("e.key", "*", 1)).otherwise(F.col("e.key")).alias("prefix"),
        F.when(star, F.substring_index("e.key", "*", -1)).otherwise(F.when(F.col("e").isNotNull(), "")).alias("suffix"),
        F.col("e.value").alias("targets"),
    )


def keywords(text: Column, path: Column, stop: list[str]) -> Column:
    """First three distinct long words outside the stop list, then the file stem."""
    words = F.array_distinct(F.filter(
        F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0)),
        lambda w: ~F.lower(w).isin(stop) if stop else F.lit(True)))
    three = F.slice(words, 1, 3)
    stem = X.path_stem(path)
    return F.slice(
        F.when((stem != "") & ~F.array_contains(three, stem), F.concat(three, F.array(stem))).otherwise(three), 1, 4)
