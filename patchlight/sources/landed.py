"""Readers of landed exports and writers of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.sources.checkouts import list_checkouts, with_content

PR_SCHEMA = (
    "repo string, number bigint, title string, description string, diff string, files array<string>, additions bigint, deletions bigint,"
    " head_sha string, base_branch string, head_branch string, author_name string, updated_at string, created_at string, commits bigint,"
    " files_detail array<struct<filename:string,additions:int,deletions:int,status:string,patch:string>>"
)
SCAN_SCHEMA = (
    "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string>>>"
)
ISSUE = (
    "struct<file:string,line:int,title:string,description:string,severity:string,confidence:double,category:string,"
    "impact_type:string,impact_statement:string,evidence:array<string>>"
)
RUN_SCHEMA = (
    f"result struct<summary:string,risk_level:string,merge_recommendation:string,issues:array<{ISSUE}>,findings:array<{ISSUE}>>,"
    f" issues array<{ISSUE}>, findings array<{ISSUE}>, sample struct<id:string,synthetic_diff:string>, error string"
)
BENCH_RUN = (
    "map<string,struct<golden_comments:array<struct<comment:string,severity:string>>,"
    "review_comments:array<struct<path:string,line:int,body:string>>,issue_count:int,"
    "evidence_gate_stats:struct<before_gate:int,after_gate:int>,elapsed:double,error:string>>"
)
PR_URL = r"github\.com/([^/]+)/([^/]+)/pulls?/(\d+)"


def read_prs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PR_SCHEMA).json(path)


def pr_files(prs: DataFrame) -> DataFrame:
    return prs.select("repo", "number", F.explode("files_detail").alias("f")).select("repo", "number", "f.*")


def pr_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """owner, repo_name, number; all null where the text is no pull request URL."""
    hit = F.col(url).rlike(PR_URL)
    return df.select(
        "*",
        F.when(hit, F.regexp_extract(url, PR_URL, 1)).alias("owner"), F.when(hit, F.regexp_extract(url, PR_URL, 2)).alias("repo_name"),
        F.when(hit, F.regexp_extract(url, PR_URL, 3).cast("bigint")).alias("number"))


def pr_meta(prs: DataFrame) -> DataFrame:
    return prs.select(
        "pr_id", "title", F.coalesce("author_name", F.lit("unknown")).alias("author"), "base_branch", "head_branch", "commits",
        F.size("files").cast("bigint").alias("changed_files"), F.array_join("files", ",").alias("files"))


def synthetic_context(samples: DataFrame) -> DataFrame:
    """Golden samples with an inline diff as change rows."""
    from patchlight.operators.diff import diff_stats

    add, rem = diff_stats(F.col("synthetic_diff"))
    files = F.coalesce("synthetic_files", F.array().cast("array<string>"))
    return samples.where("synthetic_diff is not null").select(
        "id", "url", F.coalesce("synthetic_pr_title", "id").alias("title"), F.coalesce("synthetic_pr_description", F.lit("")).alias("description"),
        F.col("synthetic_diff").alias("diff"), files.alias("files"), F.size(files).cast("bigint").alias("files_changed"),
        add.cast("bigint").alias("additions"), rem.cast("bigint").alias("deletions"), F.lit("").alias("head_sha"), F.lit("main").alias("base_branch"),
        F.lit("feature").alias("head_branch"), F.lit("synthetic").alias("author_name"))


def read_repo_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """Source files of one checkout; folder, suffix and size filters run on the listing, before contents are read."""
    return with_content(list_checkouts(spark, root, levels=0), root).select(F.lit(repo).alias("repo"), "file", "content")


def read_scan_results(spark: SparkSession, path: str) -> DataFrame:
    return scan_rows(spark.read.schema(SCAN_SCHEMA).option("multiLine", "true").json(path))


def scan_rows(reports: DataFrame) -> DataFrame:
    keys = [c for c in reports.columns if c != "results"]
    return reports.select(*keys, F.posexplode("results").alias("ord", "r")).select(
        *keys, "ord", F.col("r.check_id").alias("check_id"), F.col("r.path").alias("path"), F.coalesce("r.start.line", F.lit(0)).alias("start_line"),
        F.coalesce("r.end.line", "r.start.line", F.lit(0)).alias("end_line"), F.coalesce("r.extra.message", F.lit("")).alias("message"),
        F.coalesce("r.extra.severity", F.lit("WARNING")).alias("severity"))


def sample_reader(chunk: int = 1000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (path, ord, sample) of whole files (path, content), `chunk` at a time. A YAML list is composed item by item, so a file costs its text and one
    sample, not the tree of all its samples; anchors hold across items."""
    def samples(text: bytes) -> Iterator:
        import json

        try:
            found = json.loads(text)  # JSON is YAML, and quicker to read.
        except ValueError:
            pass
        else:
            yield from found
            return
        import yaml

        loader = yaml.SafeLoader(text)
        try:
            loader.get_event()
            if loader.check_event(yaml.StreamEndEvent):
                return
            loader.get_event()
            if not loader.check_event(yaml.SequenceStartEvent):
                yield from loader.construct_document(loader.compose_node(None, None)) or []
            else:
                loader.get_event()
                while not loader.check_event(yaml.SequenceEndEvent):
                    yield loader.construct_document(loader.compose_node(None, None))
                loader.get_event()
            loader.get_event()
            if not loader.check_event(yaml.StreamEndEvent):
                raise ValueError("a file of samples holds one document")
        finally:
            loader.dispose()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import pyarrow as pa

        def out(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
            columns = [pa.array([path] * len(rows), pa.string()), pa.array([i for i, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["path", "ord", "sample"])

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for i, s in enumerate(samples(content.as_py())):
                    rows.append((i, json.dumps(s, ensure_ascii=False, default=str)))
                    if len(rows) == chunk:
                        yield out(path.as_py(), rows)
                        rows = []
                if rows:
                    yield out(path.as_py(), rows)

    return parse


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """YAML lists of samples as one JSON document per sample; parquet is canonical afterwards."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInArrow(sample_reader(), "path string, ord bigint, sample string")


def golden_expected(golden: DataFrame) -> DataFrame:
    """Flat expected findings of read_golden rows, over the three layouts in use."""
    schema = (
        "struct<id:string,expected_findings:array<struct<id:string,file:string,line_range:array<int>,title_keywords:array<string>,"
        "evidence_keywords:array<string>,description:string,severity:string,source:string,reason:string>>>"
    )
    return golden.select(F.from_json("sample", schema).alias("s")).select(
        F.col("s.id").alias("sample_id"), F.posexplode("s.expected_findings").alias("ord", "e")).select(
        "sample_id", "ord", "e.id", "e.file", F.try_element_at("e.line_range", F.lit(1)).alias("line_start"),
        F.try_element_at("e.line_range", F.lit(2)).alias("line_end"), "e.title_keywords", "e.evidence_keywords", "e.description", "e.severity", "e.source", "e.reason")


def run_results(samples: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """A sample's stored result; an error record wins; none at all reads as 'no result'."""
    j = samples.select("id").join(errors.select("id", F.coalesce("error", F.lit("unknown error")).alias("_e")), "id", "left").join(
        results.select("id", "n_issues", F.lit(True).alias("_r")), "id", "left")
    return j.select(
        "id", F.when(F.col("_e").isNull() & F.col("_r"), F.col("n_issues")).otherwise(0).alias("n_issues"),
        F.when(F.col("_e").isNotNull(), F.col("_e")).when(F.col("_r").isNull(), "no result").otherwise("").alias("error"))


def run_findings(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Findings of a run file, wherever the file keeps them."""
    keys = [c for c in payloads.columns if c != text]
    p = payloads.select(*keys, F.from_json(text, RUN_SCHEMA).alias("p"))
    found = F.when(F.col("p.result").isNotNull(), F.coalesce("p.result.issues", "p.result.findings")).otherwise(F.coalesce("p.issues", "p.findings"))
    return p.select(*keys, F.posexplode(found).alias("ord", "f")).select(*keys, "ord", "f.*")


def run_diff(samples: DataFrame, run_samples: DataFrame) -> DataFrame:
    """The sample's own diff, else the run file's copy, else null."""
    copy = run_samples.select("id", F.col("synthetic_diff").alias("_copy"))
    return samples.join(copy, "id", "left").select("id", F.coalesce("synthetic_diff", "_copy").alias("diff"))


def bench_run(payloads: DataFrame, text: str = "payload") -> DataFrame:
    return payloads.select(F.explode(F.from_json(text, BENCH_RUN)).alias("url", "r")).select("url", "r.*")


def write_reviews(reviews: DataFrame, path: str) -> None:
    """One JSON payload per change, partitioned by run. A run that is written again replaces its results; other runs stay."""
    payload = reviews.select("run_id", F.to_json(F.struct(*[c for c in reviews.columns if c != "run_id"])).alias("value"))
    payload.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").text(path)


def dataset_items(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """Sample inputs, and expected outputs as rows that carry the item id."""
    has = [c for c in ("id", "url", "kind", "lang", "synthetic_diff") if c in samples.columns]
    items = samples.select("id", F.to_json(F.struct(*has)).alias("input"))
    out = expected.select(F.col("sample_id").alias("id"), F.to_json(F.struct(*[c for c in expected.columns if c != "sample_id"])).alias("expected_output"))
    return items.join(out, "id", "left")


def run_rows(results: DataFrame, goldens: DataFrame) -> DataFrame:
    """results: url, title, issue_count, risk_level, before_gate, after_gate, elapsed, error. A failed run keeps error and time only."""
    n = goldens.groupBy("url").agg(F.count("*").alias("golden_count"))
    ok = F.col("error").isNull()

    def when_ok(c: str):
        return F.when(ok, F.col(c)).alias(c)

    return results.join(n, "url", "left").withColumn("golden_count", F.coalesce("golden_count", F.lit(0))).select(
        "url", F.when(ok, F.left("title", F.lit(80))).alias("pr_title"), when_ok("golden_count"), when_ok("issue_count"), when_ok("risk_level"),
        when_ok("before_gate"), when_ok("after_gate"), F.round("elapsed", 1).alias("elapsed"), "error")


def without_errors(runs: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    ok = runs.where("error is null")
    return ok.orderBy(order).limit(limit) if limit else ok


def context_summary(prs: DataFrame) -> DataFrame:
    return prs.select("pr_id", "title", F.coalesce("head_sha", F.lit("")).alias("head_sha"), F.array_join("files", ",").alias("files"),
                      F.length("diff").cast("bigint").alias("diff_len"), F.lit(False).alias("diff_truncated"))
