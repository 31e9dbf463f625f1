"""Review-shaped tables derived from the given tables, so every operator has real input.

Nothing is invented apart from the shape: texts, keys, counts and times come from the tables.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = [
    "Null dereference in handler", "SQL injection through query param", "Slow loop over cache",
    "Missing import of module", "Symbol not exported by module", "Style naming issue",
    "Idor in client router", "Could avoid allocation with usememo", "Timeout leak in async call",
    "Wrong error handling",
]
DETAILS = [
    "The value may be null and crash at runtime.", "An auth bypass is possible when the id in the url changes.",
    "The dependency cannot resolve and is not declared.", "memoize to avoid an extra render.",
    "The symbol has no exported member in the target.", "A naming rule is broken, wrong and undefined.",
    "The database query runs in a loop; p95 latency grows.", "Unauthorized access via localstorage in the frontend.",
    "A race condition may leak memory.", "Indentation and double quotes.", "Data is lost on timeout.",
    "The server middleware has an auth check missing.",
]
IMPACTS = [
    "runtime_error", "security_risk", "performance_regression", "injection", "data_loss",
    "api_breakage", "n_plus_one", "behavior_regression", "resource_leak", " Type_Check_Failure ",
]
EXTENSIONS = [".py", ".ts", ".tsx", ".js"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, read as it lies; the session's split size decides the tasks."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def doc_file(doc_id: str = "doc_id", source: str = "source") -> Column:
    return F.concat(F.lit("src/"), F.col(source), F.lit("/f"), F.col(doc_id).cast("string"),
                    pick(EXTENSIONS, F.col(doc_id)))


def code_line(x: Column, i: Column, doc: Column, source: Column) -> Column:
    """A source-like row built around the first plain word of a text row."""
    w = F.coalesce(F.nullif(F.regexp_extract(x, "([a-z]{3,})", 1), F.lit("")), F.lit("w"))
    n, own, near = i.cast("string"), doc.cast("string"), (doc + i % 2).cast("string")
    kind = i % 9
    return (
        F.when(kind == 0, F.concat(F.lit("import { f"), near, F.lit("_fn, "), w, F.lit("_x as y"), n,
                                   F.lit(' } from "./f'), near, F.lit('"')))
        .when(kind == 1, F.concat(F.lit("export function f"), own, F.lit("_fn(a) {")))
        .when(kind == 2, F.concat(F.lit("    return f"), own, F.lit("_fn(a);")))
        .when(kind == 3, F.concat(F.lit("import "), w, F.lit(' from "'), w, F.lit('/lib"')))
        .when(kind == 4, F.concat(F.lit("const "), w, F.lit(' = require("@/'), source, F.lit("/f"), near, F.lit('")')))
        .when(kind == 5, F.concat(F.lit("# "), w, F.lit(" note")))
        .when(kind == 6, F.concat(F.lit("def "), w, F.lit("_py(x):")))
        .when(kind == 7, F.concat(F.lit("    "), w, F.lit("_py(x, "), w, F.lit("[x])")))
        .otherwise(F.concat(F.lit("from "), w, F.lit(" import "), w, F.lit("_a, "), w, F.lit("_b as z")))
    )


def _sections(docs: DataFrame, code: bool) -> DataFrame:
    f = doc_file()
    def row(x: Column, i: Column) -> Column:
        k = i % 5
        text = code_line(x, i, F.col("doc_id"), F.col("source")) if code else x
        return F.concat(
            F.when(i % 10 == 0, F.concat(F.lit("@@ -"), (i + 1).cast("string"), F.lit(",10 +"),
                                         (2 * i + 1).cast("string"), F.lit(",10 @@\n"))).otherwise(""),
            F.when(k <= 1, "+").when(k == 2, "-").otherwise(" "), text,
        )
    return docs.select(
        "doc_id", F.floor(F.col("doc_id") / 4).alias("pr_id"), f.alias("file"),
        F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\n--- a/"), f, F.lit("\n+++ b/"), f,
                 F.lit("\n"), F.array_join(F.transform(F.split("text", "\n"), row), "\n")).alias("section"),
        "text", "lang", "n_chars",
    )


def prs(spark: SparkSession, sf: str, code: bool = False) -> DataFrame:
    """One change per four documents (a fixed, small group)."""
    sec = _sections(table(spark, sf, "documents"), code)
    grouped = sec.groupBy("pr_id").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "file", "section"))).alias("s"),
        # By themselves, so that who asks for files only moves no texts.
        F.sort_array(F.collect_list(F.struct("doc_id", "file"))).alias("fs"),
        F.min_by("text", "doc_id").alias("description"),
        F.min_by("lang", "doc_id").alias("lang"),
        F.sum("n_chars").alias("n_chars"),
    )
    return grouped.select(
        "pr_id", "lang", "n_chars", "description",
        F.concat(F.lit("org/repo"), (F.col("pr_id") % 8).cast("string")).alias("repo"),
        F.concat(F.lit("https://github.com/org/repo"), (F.col("pr_id") % 8).cast("string"), F.lit("/pull/"),
                 F.col("pr_id").cast("string")).alias("url"),
        F.concat(F.lit("Change "), F.col("pr_id").cast("string")).alias("title"),
        F.array_join(F.transform("s", lambda x: x["section"]), "\n").alias("diff"),
        F.transform("fs", lambda x: x["file"]).alias("files"),
        F.when(F.col("pr_id") % 5 != 0, F.sha2(F.col("pr_id").cast("string"), 256)).alias("head_sha"),
        F.lit("main").alias("base_branch"),
        F.concat(F.lit("feature-"), F.col("pr_id").cast("string")).alias("head_branch"),
        F.when(F.col("pr_id") % 3 != 0, F.concat(F.lit("dev"), (F.col("pr_id") % 11).cast("string"))).alias("author_name"),
        (F.col("pr_id") % 7).alias("commits"),
    )


def diff_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """pr_id, n: characters of each change's diff, from the sizes of its sections; no text is shuffled."""
    sec = _sections(table(spark, sf, "documents"), False).select("pr_id", F.length("section").alias("n"))
    return sec.groupBy("pr_id").agg(F.greatest(F.sum("n") + F.count("n") - 1, F.lit(0)).alias("n"))


def findings(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    n = docs.select(F.floor(F.max("doc_id") / 4) + 1).scalar()
    ev = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.expr("cast(get_json_object(props, '$.k') as int)").alias("k"),
        (F.col("event_id") % n).alias("pr_id"),
    ).withColumn("doc_id", F.col("pr_id") * 4 + F.col("user_id") % 4)
    # Texts are dealt before they are split: an array of words is several times its text.
    words = docs.select("doc_id", "source", "text").repartition("doc_id").select("doc_id", "source", F.split("text", "[\n ]").alias("words"))
    # Where events are few, Spark would broadcast them and split a text once for each of its events instead of once.
    j = ev.join(words.hint("merge"), "doc_id")
    word = F.element_at("words", (F.col("event_id") % F.size("words")).cast("int") + 1)
    return j.select(
        "pr_id", F.col("event_id").alias("ord"), doc_file().alias("file"),
        F.when(F.col("event_id") % 17 != 0, (F.floor(F.col("event_id") / 3) % 40 + 1).cast("int")).alias("line"),
        pick(TITLES, F.col("k")).alias("title"),
        pick(DETAILS, F.col("k")).alias("description"),
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type").isin("purchase", "signup"), "WARNING").otherwise("INFO").alias("severity"),
        ((F.col("event_id") * 37 % 100) / 100.0).alias("confidence"),
        pick(["security", "performance", "quality"], F.col("user_id")).alias("category"),
        F.when(F.col("event_id") % 19 != 0, pick(IMPACTS, F.col("k"))).alias("impact_type"),
        F.when(F.col("event_id") % 23 == 0, " ").when(
            F.col("event_id") % 29 != 0, F.concat(F.lit("Breaks the "), F.col("event_type"), F.lit(" flow"))
        ).alias("impact_statement"),
        F.lit(None).cast("string").alias("diff_snippet"),
        F.when(F.col("event_id") % 13 != 0, F.array(word)).alias("evidence"),
        F.when(F.col("event_id") % 11 == 0, "CONTEXT").otherwise("DIFF").alias("evidence_source"),
        F.col("value").alias("token_cost"),
    )


def expected(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf, "labels")
    long_words = F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))
    return lab.join(docs, "doc_id").select(
        F.floor(F.col("doc_id") / 4).alias("pr_id"), F.col("doc_id").alias("ord"),
        F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("id"),
        doc_file().alias("file"),
        F.when(F.col("doc_id") % 10 != 9, (F.col("doc_id") % 30 + 1).cast("int")).alias("line_start"),
        F.when(F.col("doc_id") % 10 != 9, (F.col("doc_id") % 30 + 4).cast("int")).alias("line_end"),
        F.array(F.split(pick(TITLES, F.col("doc_id")), " ")[1]).alias("title_keywords"),
        F.slice(F.array_distinct(long_words), 1, 2).alias("evidence_keywords"),
        F.concat(pick(TITLES, F.col("doc_id") + 1), F.lit(" "), pick(DETAILS, F.col("doc_id"))).alias("description"),
        F.when(F.col("toxic") == 1, "ERROR").when(F.col("quality") == 0, "WARNING").otherwise("INFO").alias("severity"),
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("org/repo"), F.expr("p_partkey div 20 % 3").cast("string")).alias("repo"), k.alias("id"),
        F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit("/m"),
                 (k % 8).cast("string"), F.lit(".py")).alias("file"),
        F.concat(F.element_at(F.split("p_name", " "), -1), F.lit("_"), F.expr("p_partkey div 5 % 40").cast("string")).alias("name"),
        (k % 50 * 10 + 1).cast("int").alias("start_line"),
        (k % 50 * 10 + 1 + F.col("p_size")).cast("int").alias("end_line"),
        F.repeat(F.concat(F.col("p_name"), F.lit("();\n")), F.col("p_size")).alias("code"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved call edges: a part calls its supplier's part."""
    return (
        table(spark, sf, "lineitem").where("l_partkey <> l_suppkey")
        .select(F.col("l_partkey").alias("caller_id"), F.col("l_suppkey").alias("callee_id")).distinct()
    )


def called(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that some edge ends in. Callers are left out before rows are compared, so edges are not shuffled for it."""
    return table(spark, sf, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_suppkey").alias("id")).distinct()


def raw_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Call rows before resolution, with plain and dotted callee names.

    A call is told from others by its caller, the node's name and how it is written, which decide both names. Rows are dealt by caller and compared
    there, once, in as many tasks as the table asks for; who joins them with their callers does not move them again.
    """
    e = table(spark, sf, "lineitem").where("l_partkey <> l_suppkey").select(
        F.col("l_partkey").alias("caller_id"), (F.col("l_suppkey") * 3 + F.col("l_linenumber")).alias("target"))
    tgt = nodes(spark, sf).select(F.col("id").alias("target"), F.col("name").alias("short"))
    kind = (F.col("caller_id") + F.col("target")) % 4
    # 0 plain, 1 to 3 a module's, 4 self, 5 with a suffix; a node's name ends in a number, so none is another one's with the suffix.
    way = F.when(kind == 0, 0).when(kind == 1, F.col("target") % 3 + 1).when(kind == 2, 4).otherwise(5).cast("tinyint")
    rows = e.join(tgt, "target").select("caller_id", "short", way.alias("way"))
    one = rows.repartition(call_tasks(spark, sf), "caller_id").distinct()
    way = F.col("way")
    return one.select(
        "caller_id",
        F.when(way == 0, F.col("short"))
        .when(way <= 3, F.concat(F.lit("mod"), (way - 1).cast("string"), F.lit("."), F.col("short")))
        .when(way == 4, F.concat(F.lit("self."), F.col("short")))
        .otherwise(F.concat(F.col("short"), F.lit("_q"))).alias("callee_name"),
        F.when(way == 5, F.concat(F.col("short"), F.lit("_q"))).otherwise(F.col("short")).alias("callee_short_name"),
    )


#: Calls that one task holds.
CALLS = 1_000_000


def call_tasks(spark: SparkSession, sf: str, per: int = CALLS) -> int:
    """Among how many tasks calls are dealt: at least the session's partitions, more when the table is longer."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), table(spark, sf, "lineitem").count() // per + 1)


def imports(spark: SparkSession, sf: str) -> DataFrame:
    """Import bindings: a file binds the name of a node that lives in the file of the next part."""
    n = nodes(spark, sf)
    a = n.select("repo", "file", (F.col("id") + 1).alias("id"))
    direct = a.join(n.select("repo", "id", F.col("file").alias("source_file"), "name"), ["repo", "id"]).select(
        "repo", "file", "name", "source_file")
    prefix = a.join(n.select("repo", "id", F.col("file").alias("source_file")), ["repo", "id"]).select(
        "repo", "file", F.concat(F.lit("mod"), (F.col("id") % 3).cast("string")).alias("name"), "source_file")
    return direct.unionByName(prefix).distinct()


def changed(spark: SparkSession, sf: str) -> DataFrame:
    """Changed nodes per change: suppliers' parts, one change per nation."""
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("pr_id"), F.col("s_suppkey").alias("id"))


def file_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """One function per five new lines of each document's file, plus one enclosing lines 1 to 40."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.size(F.split("text", "\n")).alias("n"))
    base = docs.select(
        F.floor(F.col("doc_id") / 4).alias("pr_id"), "doc_id", doc_file().alias("file"),
        F.explode(F.expr("sequence(-1, cast(2 * n div 5 as int))")).alias("j"),
    )
    return base.select(
        "pr_id", (F.col("doc_id") * 100000 + F.col("j") + 1).alias("id"), "file",
        F.when(F.col("j") < 0, F.lit("outer")).otherwise(F.concat(F.lit("f"), F.col("j").cast("string"))).alias("name"),
        F.when(F.col("j") < 0, 1).otherwise(F.col("j") * 5 + 1).cast("int").alias("start_line"),
        F.when(F.col("j") < 0, 40).otherwise(F.col("j") * 5 + 5).cast("int").alias("end_line"),
    )


def pr_events(spark: SparkSession, sf: str) -> DataFrame:
    """Webhook deliveries as JSON payloads; every delivery id occurs twice."""
    e = table(spark, sf, "events")
    kind = (
        F.when(F.col("event_type").isin("click", "view"), "pull_request")
        .when(F.col("event_type") == "error", "issue_comment").otherwise("push")
    )
    url = F.concat(F.lit("https://github.com/org/repo"), (F.col("user_id") % 8).cast("string"), F.lit("/pull/"),
                   (F.col("event_id") % 50).cast("string"))
    action = (
        F.when(kind == "pull_request", pick(["opened", "synchronize", "labeled", "closed"], F.col("event_id")))
        .when(kind == "issue_comment", pick(["created", "edited"], F.col("event_id") + F.col("user_id")))
        .otherwise("")
    )
    inst = F.col("user_id").cast("string")
    mention = F.when(F.col("event_id") % 3 == 0, F.lit("please look @review-bot")).otherwise(F.lit("thanks"))
    payload = (
        F.when(kind == "pull_request", F.concat(
            F.lit('{"action":"'), action, F.lit('","pull_request":{'),
            F.when(F.col("event_id") % 41 == 0, F.lit("")).otherwise(
                F.concat(F.lit('"html_url":"'), url, F.lit('"'))),
            F.lit('},"installation":{"id":'), inst, F.lit("}}")))
        .when(kind == "issue_comment", F.concat(
            F.lit('{"action":"'), action, F.lit('","comment":{"body":"'), mention, F.lit('"},"issue":{'),
            F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(
                F.concat(F.lit('"pull_request":{"html_url":"'), url, F.lit('"}'))),
            F.lit('},"installation":{"id":'), inst, F.lit("}}")))
        .otherwise(F.lit("{}"))
    )
    return e.select(
        F.floor(F.col("event_id") / 2).cast("string").alias("delivery_id"), "ts", kind.alias("event"),
        payload.alias("payload"), F.col("event_id").alias("seq"),
    )


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """Source files, one small repository per change."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("r"), F.floor(F.col("doc_id") / 4).cast("string")).alias("repo"),
        F.floor(F.col("doc_id") / 4).alias("pr_id"), "doc_id", doc_file().alias("file"),
        F.array_join(F.transform(F.split("text", "\n"), lambda x, i: code_line(x, i, F.col("doc_id"), F.col("source"))), "\n").alias("content"),
    )


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """package.json per repository: the first word of each of its files; some have none."""
    w = F.coalesce(F.nullif(F.regexp_extract("text", "([a-z]{3,})", 1), F.lit("")), F.lit("w"))
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("pr_id"), "doc_id", w.alias("w")).where("pr_id % 7 <> 0")
    return d.groupBy("pr_id").agg(
        F.min_by("w", "doc_id").alias("a"), F.max_by("w", "doc_id").alias("b")
    ).select(
        F.concat(F.lit("r"), F.col("pr_id").cast("string")).alias("repo"),
        F.concat(F.lit('{"name":"x","dependencies":{"'), "a", F.lit('":"1","react":"^18"},"devDependencies":{"'), "b",
                 F.lit('":"2","react":"17"}}')).alias("content"))


def alias_configs(spark: SparkSession, sf: str) -> DataFrame:
    """tsconfig.json per repository; some have none, some no usable rule."""
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("pr_id")).where("pr_id % 5 <> 0").distinct()
    p = F.col("pr_id")
    return d.select(
        F.concat(F.lit("r"), p.cast("string")).alias("repo"), F.lit("tsconfig.json").alias("path"),
        F.when(p % 5 == 1, F.lit('{"compilerOptions":{"paths":{}}}'))
        .when(p % 5 == 2, F.lit('{"compilerOptions":{"baseUrl":"src","paths":{"@/*":["lib/*","*"],"~/x":["y"],"a*b*":["z"]}}}'))
        .otherwise(F.lit('{"compilerOptions":{"baseUrl":".","paths":{"@/*":["src/*"]}}}')).alias("content"))
