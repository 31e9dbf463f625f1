import datetime
import json
import random
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import datasource as DS
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.operators import code as CD
from patchlight.operators import replies as RP
from patchlight.sources import checkouts as CO
from patchlight.sources import importers as I
from patchlight.sources import landed as L
from patchlight.streaming import events as E
from patchlight.streaming import jobs as J
from patchlight.streaming import limits as LM
from patchlight.streaming import upsert as U

PR = '{"action":"%s","pull_request":{"html_url":"https://github.com/o/r/pull/1"},"installation":{"id":7}}'


def drain(df, spark, name, path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / ("ck" + name))).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def land(tmp_path, rows):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(d)


EVENTS = "delivery_id string, ts timestamp, event string, payload string"


def test_webhook_events(spark):
    note = '{"action":"created","comment":{"body":"%s"},"issue":%s,"installation":{"id":1}}'
    link = '{"pull_request":{"html_url":"https://github.com/o/r/pull/2"}}'
    rows = [("a", None, "pull_request", PR % "opened"), ("b", None, "pull_request", PR % "labeled"), ("c", None, "issue_comment", note % ("hi @bot", link)),
            ("d", None, "issue_comment", note % ("hi", link)), ("e", None, "issue_comment", note % ("@bot", "{}")), ("f", None, "push", "{}"),
            ("g", None, "pull_request", '{"action":"opened","pull_request":{}}'), ("h", None, "pull_request", "not json")]
    got = {r.delivery_id: (r.status, r.job_event) for r in E.classify(spark.createDataFrame(rows, EVENTS), "@bot").collect()}
    assert got == {"a": ("job", "pull_request.opened"), "b": ("ignored", None), "c": ("job", "issue_comment.created"), "d": ("ignored", None),
                   "e": ("ignored", None), "f": ("ignored", None), "g": ("rejected", None), "h": ("ignored", None)}


def test_stream_dedup_and_rate_limit(spark, tmp_path):
    rows = [dict(delivery_id=str(i // 2), ts=f"2024-01-01T00:00:{i // 2:02d}Z", event="pull_request", payload=PR % "opened") for i in range(60)]
    stream = spark.readStream.schema(EVENTS).json(land(tmp_path, rows))
    jobs = E.review_jobs(LM.dedup_stream(stream, "delivery_id", "event"), "@bot")
    got = drain(jobs, spark, "jobs", tmp_path)
    assert sorted(int(r.delivery_id) for r in got) == list(range(30))
    limited = LM.rate_limit_stream(E.review_jobs(stream, "@bot"), limit=20)
    flags = drain(limited, spark, "limited", tmp_path)
    assert len(flags) == 60 and sum(r.limited for r in flags) == 40


def test_an_id_counts_again_after_its_hour(spark, tmp_path):
    times = ["00:00:00", "00:30:00", "00:59:59", "01:00:00", "01:30:00", "07:00:00", "07:59:00"]
    rows = [dict(delivery_id="d", ts=f"2024-01-01T{t}Z", event="pull_request", payload=t) for t in times] + [dict(delivery_id=None, ts="2024-01-01T00:00:00Z", event="push", payload="n")]
    stream = spark.readStream.schema(EVENTS).json(land(tmp_path, rows))
    got = drain(LM.dedup_stream(stream, "delivery_id", "event"), spark, "again", tmp_path)
    assert sorted(r.payload for r in got) == ["00:00:00", "01:00:00", "07:00:00", "n"]


def test_streams_read_tables_of_part_files(spark, tmp_path, sf):
    from patchlight.catalog import QUERIES

    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    whole = sorted(map(tuple, QUERIES["st_repo_stats"](spark, sf).collect()))
    assert whole and sorted(map(tuple, QUERIES["st_repo_stats"](spark, str(tmp_path)).collect())) == whole


def test_replies_are_read_item_by_item(spark):
    good = '"file":"a","title":"t","description":"d","severity":"ERROR","category":"c"'
    texts = [
        '{"findings":[{%s,"confidence":"0.9","line":"12"}]}' % good, '{"findings":["oops",{%s,"confidence":1,"line":3.0},{%s,"confidence":"high"}]}' % (good, good),
        'Here: [{%s,"confidence":0.5}]' % good, "none", '{"findings":[{"file":"x"}]}', 'see [1]: {"findings":[{%s,"confidence":0.25,"line":null}]}' % good,
    ]
    status, rows = RP.parse_reviews(spark.createDataFrame(list(enumerate(texts)), "k int, reply string"))
    assert [r.status for r in status.orderBy("k").collect()] == ["success"] * 3 + ["format_error"] + ["success"] * 2
    assert [(r.k, r.ord, r.line, r.confidence) for r in rows.orderBy("k", "ord").collect()] == [(0, 0, 12, 0.9), (1, 1, 3, 1.0), (2, 0, None, 0.5), (5, 0, None, 0.25)]


def test_api_quota_of_a_busy_hour_stays_linear(spark):
    import time

    span, n = 3_600_000_000, 60_000
    r = random.Random(1)
    times = sorted(r.randrange(3 * span) for _ in range(300)) + [span, span, 0]
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "key string, us long, seq long")
    got = {x.seq: (x.n, x.reset_at) for x in LM.api_quota(df, "key", "us", "seq", 3).collect()}
    for i, t in enumerate(times):
        window = [u for u in times if t - span <= u <= t]
        assert got[i] == (len(window), min(window) + span)
    busy = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 50_000).alias("us"), F.col("id").alias("seq"))
    start = time.time()
    assert LM.api_quota(busy, "key", "us", "seq", 3).where("n > 3").count() == n - 3
    assert time.time() - start < 30


def test_review_job_writes_each_batch_once(spark, tmp_path):
    rows = [dict(delivery_id=str(i), ts="2024-01-01T00:00:00Z", event="pull_request", payload=PR % "opened") for i in range(5)]
    stream = E.review_jobs(spark.readStream.schema(EVENTS).json(land(tmp_path, rows)), "@bot")
    for _ in range(2):
        J.start_review_job(stream, lambda b: b.select("pr_url", F.lit("LOW").alias("risk")), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


JOBS = "repo string, pr_id long, sha string, seq long, ts timestamp"


def _table_run(spark, jobs, base, review):
    stream = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).parquet(jobs)
    J.start_review_table(stream, review, base, once=True).awaitTermination()
    return {(r.pr_id, r.sha): r for r in J.reviews(spark, base).collect()}


def test_review_table_has_one_row_per_commit(spark, tmp_path):
    """Four micro-batches: a sha sent twice, a held lock across batches, a new review after it, a newer commit, a failed change, null keys."""
    at = lambda m: datetime.datetime(2024, 1, 1, 10, 0) + datetime.timedelta(minutes=m)
    batches = [
        [("r", 1, "a", 1, at(0)), ("r", 1, "a", 2, at(1)), ("r", 2, "x", 3, at(2)), (None, 4, None, 4, at(0))],
        [("r", 1, "a", 5, at(19)), ("r", 1, "b", 6, at(5)), ("r", 9, "z", 7, at(5)), (None, 4, None, 8, at(3))],
        [("r", 1, "a", 9, at(20)), ("r", 3, "x", 10, at(4)), ("other", 3, "x", 11, at(4)), ("r", 5, "w", 12, None)],
        [("r", 2, "y", 13, at(50))],
    ]
    seen = []

    def review(jobs):
        seen.append(sorted(r.seq for r in jobs.collect()))
        known = jobs.select("pr_id").distinct().where("pr_id < 9")
        return known.selectExpr("pr_id", "pr_id % 2 AS issue_count", "'LOW' AS risk_level", "IF(pr_id = 4, 'timeout', NULL) AS error")

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, JOBS).coalesce(1).write.parquet(f"{tmp_path}/jobs{k}")
    base = str(tmp_path / "base")
    source = tmp_path / "in"
    source.mkdir()
    for k in range(4):
        part = next((tmp_path / f"jobs{k}").glob("part-*"))
        (source / f"{k}.parquet").write_bytes(part.read_bytes())
        got = _table_run(spark, str(source), base, review)
    assert seen == [[1, 3, 4], [6, 7], [9, 11], [13]]
    rows = {k: (r.job, r.jobs, r.issue_count, r.risk_level, r.conclusion, r.error, r.superseded) for k, r in got.items()}
    assert rows == {
        (1, "a"): (9, 2, 1, "LOW", "action_required", None, False), (1, "b"): (6, 1, 1, "LOW", "action_required", None, True),
        (2, "x"): (3, 1, 0, "LOW", "success", None, True), (2, "y"): (13, 1, 0, "LOW", "success", None, False),
        (3, "x"): (11, 1, 1, "LOW", "action_required", None, False), (4, None): (4, 1, 0, "N/A", "failure", "timeout", False),
        (9, "z"): (7, 1, 0, "N/A", "failure", "no such change", False),
    }
    assert _table_run(spark, str(source), base, review) == got and len(seen) == 4


def test_upsert_run_again_changes_nothing(spark, tmp_path):
    """An epoch written twice, also after a part of it was lost, leaves the rows of one write; older versions go."""
    path, total = str(tmp_path / "t"), lambda both: both.groupBy("k").agg(F.sum("n").alias("n"))
    schema = spark.createDataFrame([], "k string, n long").schema
    batches = [[("a", 1), ("b", 1)], [("a", 2), (None, 5)], [("a", 3), ("c", 1)]]
    for epoch, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        for _ in range(2):
            U.upsert(df, path, ["k"], epoch, total, 4)
        shutil.rmtree(f"{path}/epoch={epoch}")
        U.upsert(df, path, ["k"], epoch, total, 4)
        U.forget(spark, path, schema, epoch)
    assert {tuple(r) for r in U.read(spark, path, schema).collect()} == {("a", 6), ("b", 1), (None, 5), ("c", 1)}
    assert {tuple(r) for r in U.read(spark, path, schema, before=2).collect()} >= {("a", 3), (None, 5)}
    versions = spark.read.parquet(path).select("epoch", "bucket").distinct().groupBy("bucket").count()
    assert max(r["count"] for r in versions.collect()) <= 2


def windows(ts, span):
    out, at = [], None
    for t in ts:
        if at is None or t >= at + span:
            at = t
        out.append(at)
    return out


def test_anchored_windows_against_a_scan(spark):
    rnd = random.Random(4)
    rows = []
    for key, gap in (("hot", 20), ("mid", 900), ("cold", 8000)):
        t = 0
        for i in range(1500 if key == "hot" else 200):
            t += rnd.randrange(0, gap) * 1_000_000
            rows.append((key, i, t))
    df = spark.createDataFrame(rows, "k string, seq long, us long")
    got = {(r.k, r.seq): r.opened for r in LM.anchored_windows(df, ["k"], "us", 60).collect()}
    for key in ("hot", "mid", "cold"):
        mine = [(s, t) for k, s, t in rows if k == key]
        assert [got[key, s] for s, _ in mine] == windows([t for _, t in mine], 60_000_000)
    n = LM.rate_limited(df, ["k"], "us", "seq", 60, 3).where("limited").count()
    assert n == sum(max(0, c["count"] - 3) for c in LM.anchored_windows(df, ["k"], "us", 60).groupBy("k", "opened").count().collect())


def test_windows_of_a_key_that_never_pauses(spark):
    """Many segments of one key: random, regular (on the boundaries of windows and segments), with gaps of whole segments, before the epoch, repeated times."""
    rnd, rows = random.Random(6), []
    dense = [-9_000_000_000 + 1_000_000 * rnd.randrange(0, 14_000) for _ in range(6000)]
    gapped = [t * 30_000_000 + (t // 50) * 20 * 3_840_000_000 for t in range(400)]
    for key, times in (("dense", dense), ("regular", [t * 20_000_000 for t in range(2000)]), ("gapped", gapped), (None, [5, 5, 60_000_005]), ("", [7])):
        rows += [(key, i, t) for i, t in enumerate(sorted(times))]
    df = spark.createDataFrame([*rows, ("dense", 10**6, None)], "k string, seq long, us long")
    got = {(r.k, r.seq): r.opened for r in LM.anchored_windows(df, ["k"], "us", 60).collect()}
    for key in ("dense", "regular", "gapped", None, ""):
        mine = [(s, t) for k, s, t in rows if k == key]
        assert [got[key, s] for s, _ in mine] == windows([t for _, t in mine], 60_000_000)
    assert len(got) == len(rows)


def test_busy_key_is_cut_into_segments(spark):
    """One key with all of 400,000 events is followed through a few hundred segments; every window holds a minute of it."""
    df = spark.range(400_000).selectExpr("'k' AS k", "id AS seq", "id * 50000 AS us")
    n = LM.anchored_windows(df, ["k"], "us", 60).groupBy("opened").count()
    assert sorted((r.opened, r["count"]) for r in n.collect()) == [(k * 60_000_000, min(1200, 400_000 - 1200 * k)) for k in range(334)]


def test_api_quota_of_calls_without_key_or_time(spark):
    df = spark.createDataFrame([("k", 5, 1), (None, 5, 2), ("k", None, 3), ("", 6, 4), ("k", 3_600_000_006, 5)], "key string, us long, seq long")
    got = {r.seq: (r.n, r.reset_at) for r in LM.api_quota(df, "key", "us", "seq", 3).collect()}
    assert got == {1: (1, 3_600_000_005), 2: (1, 3_600_000_005), 3: (None, None), 4: (1, 3_600_000_006), 5: (1, 7_200_000_006)}


def test_pr_urls(spark):
    df = spark.createDataFrame([("https://github.com/o/r/pull/12/files",), ("github.com/o/r/pulls/3",), ("https://gitlab.com/o/r/pull/1",)], "url string")
    assert [(r.owner, r.repo_name, r.number) for r in L.pr_url_parts(df).collect()] == [("o", "r", 12), ("o", "r", 3), (None, None, None)]


def test_repo_files_and_golden_yaml(spark, tmp_path):
    for p in ("src/a.py", "src/test_b.py", "node_modules/c.js", ".hidden/d.py", "e.md", "web/f.tsx", "src/__init__.py"):
        (tmp_path / "repo" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / p).write_text("x = 1")
    assert {r.file for r in L.read_repo_files(spark, str(tmp_path / "repo"), "r").collect()} == {"src/a.py", "web/f.tsx", "src/__init__.py"}
    (tmp_path / "g.yaml").write_text("- id: s1\n  url: u\n  expected_findings:\n  - {id: e1, file: a.py, line_range: [3, 4], title_keywords: [x]}\n  - {id: e2, description: d}\n- id: s2\n  url: v\n")
    golden = L.read_golden(spark, str(tmp_path / "g.yaml"))
    assert golden.count() == 2
    assert {(r.sample_id, r.id, r.line_start) for r in L.golden_expected(golden).collect()} == {("s1", "e1", 3), ("s1", "e2", None)}


def test_listing_has_the_rules_of_the_column_function(spark):
    names = ["a.py", ".py", "a.", "py", "a.b.ts", "test_a.py", "a_test.py", "a.spec.js", "__init__.py", "x.PY", "a.tsx", "noise.md"]
    folders = ["", "src/", "vendor/", "src/.git/", "a/dist/b/", "distance/", "build/", "_own/"]
    rows = [(f + n, size) for f in folders for n in names for size in (0, C.MAX_SOURCE_BYTES, C.MAX_SOURCE_BYTES + 1)]
    df = spark.createDataFrame(rows, "file string, length long")
    assert {tuple(r) for r in df.where(CD.reviewed_source(F.col("file"), F.col("length"))).collect()} == {r for r in rows if CO.is_reviewed(*r)}


def test_checkouts_are_listed_filtered_and_then_read(spark, tmp_path):
    root, sizes = f"file://{tmp_path}/co", {"a": 3, "b": 40}
    files = [(f"o/r{k}", f"{d}/{n}.py", n * size) for k in range(3) for d in ("src", "vendor") for n, size in sizes.items()]
    files += [("o/r1", "pkg/__init__.py", ""), ("o/r1", "pkg/null.py", None), ("o/r2", "x.md", "m")]
    df = spark.createDataFrame(files, "repo string, file string, content string")
    assert CO.write_checkouts(df, root) == CO.write_checkouts(df, root) == len(files)
    want = {(r, f, len(c or ""), c or "") for r, f, c in files if f.endswith(".py") and not f.startswith("vendor")}
    listing = CO.list_checkouts(spark, root, levels=2)
    assert {tuple(r) for r in CO.with_content(listing, root).collect()} == want and listing.count() == len(want)
    some = listing.where("repo <> 'o/r0' AND length <= 3 AND file LIKE 'src/%'")
    kept = {tuple(r) for r in CO.with_content(some, root).collect()}
    assert kept == {w for w in want if w[0] != "o/r0" and w[2] <= 3 and w[1].startswith("src/")} and kept
    reader = CO.CheckoutReader({"path": root, "levels": "2"})
    asked = [DS.Not(DS.EqualTo(("repo",), "o/r0")), DS.LessThanOrEqual(("length",), 3), DS.StringStartsWith(("file",), "src/"), DS.EqualTo(("file", "x"), 1)]
    assert list(reader.pushFilters(asked)) == asked[3:] and [p.repos for p in reader.partitions()] == [["o/r1"], ["o/r2"]]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    (tmp_path / "empty").mkdir()
    assert CO.with_content(CO.list_checkouts(spark, str(tmp_path / "empty")), str(tmp_path / "empty")).count() == 0


def test_written_reviews_are_partitioned(spark, tmp_path):
    L.write_reviews(spark.createDataFrame([(1, "LOW", "run1"), (2, "HIGH", "run2")], "pr_id long, risk string, run_id string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "run_id=run1").is_dir() and spark.read.text(str(tmp_path / "out")).count() == 2


def test_bench_run_file(spark):
    body = json.dumps({"u1": {"golden_comments": [{"comment": "c", "severity": "High"}], "review_comments": [], "issue_count": 3, "elapsed": 1.5}, "u2": {"error": "x"}})
    got = {r.url: (r.issue_count, r.error) for r in L.bench_run(spark.createDataFrame([(body,)], "payload string")).collect()}
    assert got == {"u1": (3, None), "u2": (None, "x")}


def test_importer_rows(spark):
    issue = "array<struct<title:string,description:string,rule_name:string,file_path:string,start_line:int,end_line:int,problematic_code_snippet:string>>"
    rows = [("cal.com", "https://g/o/r/pull/5/", [("Crash on null user", "it fails", "", "a/user_util.py", 0, 9, "getUser(id)"), ("naming is wrong", "", "", "a.py", 1, 1, ""), ("leak", "", "", "", 1, 1, "")])]
    samples, expected = I.qodo(spark.createDataFrame(rows, f"repo string, pr_url_to_review string, issues {issue}"))
    e = expected.collect()
    assert samples.first().id == "qodo-cal-com-5" and len(e) == 1
    assert (e[0].line_start, e[0].line_end, e[0].title_keywords, e[0].evidence_keywords) == (9, 9, ["Crash", "null", "user", "user_util"], ["getUser", "user_util"])


def test_reply_parsing(spark):
    good = '<think> hm </think> Sure: {"findings":[{"file":"a","title":"t","description":"d","severity":"ERROR","confidence":0.5,"category":"quality"},{"file":"b"}]} done'
    status, rows = RP.parse_reviews(spark.createDataFrame([(1, good), (2, "no json {"), (3, '{"findings":[]}')], "pr_id long, reply string"))
    assert {r.pr_id: (r.status, r.thinking) for r in status.collect()} == {1: ("success", "hm"), 2: ("format_error", ""), 3: ("success", "")}
    assert [(r.pr_id, r.file, r.evidence_source) for r in rows.collect()] == [(1, "a", "DIFF")]


def test_rule_model_end_to_end(spark):
    prompted = spark.createDataFrame([(1, "s", "+x = eval(y)"), (2, "s", "z" * 400)], "pr_id long, system string, prompt string")
    out = RP.run_reviewers(prompted, max_tokens=50)
    assert {r.pr_id: r.error for r in out.collect()} == {1: None, 2: "Budget exceeded: 100 > 50"}
    _, rows = RP.parse_reviews(out.where("error is null").select("pr_id", "reply"))
    assert [r.title for r in rows.collect()] == ["eval of input"]


def _in_parts(spark, tmp_path, rows, parts):
    """A stream with one micro-batch per part, in order of time."""
    import os

    (tmp_path / "in").mkdir()
    for p in range(parts):
        path = tmp_path / "in" / f"{p}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows[p * len(rows) // parts : (p + 1) * len(rows) // parts]))
        os.utime(path, (1_700_000_000 + p, 1_700_000_000 + p))
    return spark.readStream.schema("k string, seq long, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def _timed_rows(n=900):
    rnd, t, rows = random.Random(9), 1_704_067_200, []
    for i in range(n):
        t += rnd.choice([0, 1, 5, 40, 90])
        k = rnd.choice(["hot", "hot", "hot", "cold", "", None])
        rows.append((k, i, t))
    return rows, [dict(k=k, seq=i, ts=t) for k, i, t in rows]


def test_dedup_by_batches_carries_open_windows(spark, tmp_path):
    rows, landed = _timed_rows()
    L_out, base = str(tmp_path / "out"), str(tmp_path / "base")
    LM.start_dedup(_in_parts(spark, tmp_path, landed, 4), "k", "seq", L_out, base, 300, once=True).awaitTermination()
    want = set()
    for key in {k for k, _, _ in rows}:
        mine = [(t, i) for k, i, t in rows if k == key]
        starts = windows([t for t, _ in mine], 300)
        want |= {i for j, (t, i) in enumerate(mine) if j == 0 or starts[j] != starts[j - 1]}
    assert sorted(r.seq for r in spark.read.parquet(L_out).collect()) == sorted(want)
    # One row per open key and one for the watermark are handed on.
    assert spark.read.parquet(f"{base}/held/1").count() <= 5


def test_rate_limit_by_batches_carries_counts(spark, tmp_path):
    rows, landed = _timed_rows()
    out = str(tmp_path / "out")
    LM.start_rate_limit(_in_parts(spark, tmp_path, landed, 4), out, str(tmp_path / "base"), "k", "seq", 300, 3, once=True).awaitTermination()
    want = {}
    for key in {k for k, _, _ in rows}:
        mine, n, last = [(t, i) for k, i, t in rows if k == key], 0, None
        for (t, i), start in zip(mine, windows([t for t, _ in mine], 300)):
            n, last = (n + 1 if start == last else 1), start
            want[i] = n > 3
    assert {r.seq: r.limited for r in spark.read.parquet(out).collect()} == want and len(want) == len(rows)


def test_dedup_query_keeps_no_key_in_one_group(spark, sf, monkeypatch):
    from patchlight.catalog import QUERIES

    def whole_key(*a, **b):
        raise AssertionError("a whole key in one group")

    monkeypatch.setattr(LM, "dedup_stream", whole_key)
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("event_id") % 10).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()
    want = set()
    for key in range(10):
        mine = sorted((r.us, r.event_id) for r in e if r.k == key)
        starts = windows([t for t, _ in mine], 3_600_000_000)
        want |= {(i, key) for j, (_, i) in enumerate(mine) if j == 0 or starts[j] != starts[j - 1]}
    assert set(map(tuple, QUERIES["st_dedup_delivery"](spark, sf).collect())) == want


def test_api_quota_keeps_calls_that_are_equal_in_every_column(spark):
    df = spark.createDataFrame([("k", 5, 1), ("k", 5, 1), ("k", 9, 2), (None, 5, 1), (None, 5, 1)], "key string, us long, seq long")
    got = sorted(((r.key or "", r.seq, r.n, r.allowed) for r in LM.api_quota(df, "key", "us", "seq", 2).collect()))
    assert got == [("", 1, 2, True), ("", 1, 2, True), ("k", 1, 2, True), ("k", 1, 2, True), ("k", 2, 3, False)]


def test_samples_of_a_file_come_one_after_another(tmp_path, spark):
    """a list is not composed as a whole before its first samples are given; anchors, single documents and empty files read as before."""
    import json

    import pyarrow as pa
    import yaml

    from patchlight.sources.landed import read_golden, sample_reader

    def read(text):
        batch = pa.RecordBatch.from_pydict({"path": ["f"], "content": [text.encode()]})
        return sample_reader(2)(iter([batch]))

    first = next(read("- {id: a}\n- {id: b}\n- {id: c\n"))
    assert first.to_pydict() == {"path": ["f", "f"], "ord": [0, 1], "sample": ['{"id": "a"}', '{"id": "b"}']}
    for text in ("- &x {id: a, on: 2024-01-02}\n- *x\n- [1, *x]\n", "", "# none\n", "--- \n- a\n", '[{"id": 1}]', "{a: 1, b: 2}", "[a, b]"):
        want = [json.dumps(x, ensure_ascii=False, default=str) for x in (yaml.safe_load(text) or [])]
        assert [x for b in read(text) for x in b.to_pydict()["sample"]] == want, text
    (tmp_path / "g.yaml").write_text("- id: a\n  k: [1]\n- id: b\n")
    assert [(r.ord, r.sample) for r in read_golden(spark, str(tmp_path)).orderBy("ord").collect()] == [(0, '{"id": "a", "k": [1]}'), (1, '{"id": "b"}')]


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_segments_of_busy_keys_pass_in_batches(size):
    """what a worker holds of a segment is its step function and a batch, and windows are those of one scan."""
    r, span = random.Random(size), 60
    step = span * LM.SEGMENT
    times = {"a": sorted(r.sample(range(-step, 3 * step), 4000)), "b": sorted(r.sample(range(40 * step), 60)), "c": [5], "d": sorted(r.sample(range(step), 3000))}
    rows = [(k, t // step, t) for k, ts in times.items() for t in ts]

    def batches(rows, names):
        for i in range(0, len(rows), size):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size], strict=True)], names)

    made = list(LM._steps(span)(batches(rows, ["_key", "_seg", "_us"])))
    assert max(len(v) for b in made for v in b["_breaks"].to_pylist()) <= span + 1
    entry = {(k, g): x for b in LM._entries(iter(made)) for k, g, x in zip(*[c.to_pylist() for c in b.columns], strict=True)}
    held, new = [], LM._new
    LM._new = lambda t: held.append(t.num_rows) or new(t)
    try:
        marked = list(LM._marked(span)(batches([(k, g, t, entry[k, g]) for k, g, t in rows], ["_key", "_seg", "_us", "_x"])))
    finally:
        LM._new = new
    assert max(held) <= size
    got = {(k, t): o for b in marked for k, t, o in zip(*[c.to_pylist() for c in b.columns], strict=True)}
    want = {}
    for k, ts in times.items():
        opened = None
        for t in ts:
            opened = t if opened is None or t >= opened + span else opened
            want[k, t] = opened
    assert got == want
