"""Event queries: batch twins with oracles, and two that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from patchlight.catalog.base import CTES, query
from patchlight.operators import findings as FI
from patchlight.session import shared_folder
from patchlight.sources import carriers as K
from patchlight.streaming import events as E
from patchlight.streaming import jobs as J
from patchlight.streaming import limits as L

TRIGGER = "@review-bot"
US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"

CTES["c_ev"] = """SELECT event_id, ts, epoch_us(ts) AS us, user_id, CASE WHEN event_type IN ('click','view') THEN 'pull_request' WHEN event_type = 'error' THEN 'issue_comment' ELSE 'push' END AS event,
 'https://github.com/org/repo' || (user_id % 8) || '/pull/' || (event_id % 50) AS url, (event_id // 2)::VARCHAR AS delivery_id FROM events"""
CTES["c_jobs"] = """SELECT event_id, delivery_id, CASE WHEN event = 'pull_request' AND event_id % 4 <= 1 THEN CASE WHEN event_id % 41 = 0 THEN 'rejected' ELSE 'job' END
 WHEN event = 'issue_comment' AND (event_id + user_id) % 2 = 0 AND event_id % 3 = 0 AND event_id % 5 <> 0 THEN 'job' ELSE 'ignored' END AS status,
 url, event || '.' || CASE WHEN event = 'pull_request' THEN (['opened','synchronize','labeled','closed'])[event_id % 4 + 1] ELSE 'created' END AS job_event, user_id FROM c_ev"""


@query("st_events", """SELECT event_id AS seq, delivery_id, status, CASE WHEN status = 'job' THEN url END AS pr_url, CASE WHEN status = 'job' THEN job_event END AS job_event FROM c_jobs""")
def _(spark, sf):
    return E.classify(K.pr_events(spark, sf), TRIGGER).select("seq", "delivery_id", "status", "pr_url", "job_event")


@query("st_rejects", "SELECT delivery_id FROM c_jobs WHERE status = 'rejected'")
def _(spark, sf):
    return E.rejected(K.pr_events(spark, sf), TRIGGER).select("delivery_id")


def timed(spark, sf):
    return K.table(spark, sf, "events").select("event_id", "user_id", F.expr(US).alias("us"))


def _chain(key: str, seconds: int, us: str = "epoch_us(ts)", where: str = "true") -> str:
    return f"""SELECT event_id, k, us, opened FROM (
WITH RECURSIVE e AS (SELECT event_id, {key} AS k, {us} AS us, row_number() OVER (PARTITION BY {key} ORDER BY {us}, event_id) AS rn FROM events WHERE {where}),
 w AS (SELECT event_id, k, us, rn, us AS opened FROM e WHERE rn = 1
  UNION ALL SELECT e.event_id, e.k, e.us, e.rn, CASE WHEN e.us >= w.opened + {seconds}::BIGINT * 1000000 THEN e.us ELSE w.opened END FROM w JOIN e ON e.k = w.k AND e.rn = w.rn + 1)
SELECT * FROM w)"""


CTES["c_hookwin"] = _chain("user_id % 5", 600)
CTES["c_lockwin"] = _chain("user_id", 1200)


@query("st_rate_limit", "SELECT event_id, k AS inst, row_number() OVER (PARTITION BY k, opened ORDER BY us, event_id) > 2 AS limited FROM c_hookwin")
def _(spark, sf):
    e = timed(spark, sf).select("event_id", (F.col("user_id") % 5).alias("inst"), "us")
    return L.rate_limited(e, ["inst"], "us", "event_id", 600, 2).select("event_id", "inst", "limited")


@query("st_review_lock", "SELECT min_by(event_id, (us, event_id)) AS event_id, k AS sha FROM c_lockwin GROUP BY k, opened")
def _(spark, sf):
    e = timed(spark, sf).select("event_id", F.col("user_id").alias("sha"), "us")
    return L.first_per_ttl(e, ["sha"], "us", "event_id", 1200).select("event_id", "sha")


@query("st_rate_tumbling", "SELECT user_id, epoch_us(time_bucket(INTERVAL 60 SECOND, ts)) AS window_us, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    t = L.tumbling_counts(K.table(spark, sf, "events"), "user_id")
    return t.select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', window_start)").alias("window_us"), "n")


@query("st_api_window", """SELECT event_id, n, n <= 3 AS allowed, greatest(3 - n, 0) AS remaining, f + 3600000000 AS reset_at FROM (SELECT event_id,
 count(*) OVER w AS n, min(epoch_us(ts)) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))""")
def _(spark, sf):
    e = timed(spark, sf).withColumn("client", F.col("user_id") % 10)
    return L.api_quota(e, "client", "us", "event_id", 3).select("event_id", "n", "allowed", "remaining", "reset_at")


@query("st_supersede", """SELECT event_id AS review_id, bot AND (ts < mts OR (ts = mts AND event_id < mid)) AS superseded FROM (SELECT event_id, ts, event_type <> 'view' AS bot, event_id % 50 AS pr_id FROM events) e
LEFT JOIN (SELECT event_id % 50 AS pr_id, max(ts) AS mts, max_by(event_id, (ts, event_id)) AS mid FROM events WHERE event_type <> 'view' GROUP BY 1) m USING (pr_id)""")
def _(spark, sf):
    r = K.table(spark, sf, "events").select((F.col("event_id") % 50).alias("pr_id"), F.col("event_id").alias("review_id"), "ts",
                                            (F.col("event_type") != "view").alias("by_bot"))
    return J.superseded(r).select("review_id", "superseded")


def _stream(spark, sf):
    """The events table as a stream of its files, be it one file or a folder of part files."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # A pattern that only this name matches: a stream takes a single file by pattern only.
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def _run(spark, df, mode):
    """Run a stream over all present files into files of the shared folder and return them as a table.

    Appended rows go through the file sink; a complete result replaces what the batch before wrote.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").start(out)
    else:
        q = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


CTES["c_dedupwin"] = _chain("event_id % 10", 3600)


@query("st_dedup_delivery", "SELECT min_by(event_id, (us, event_id)) AS event_id, k AS delivery FROM c_dedupwin GROUP BY k, opened")
def _(spark, sf):
    s = _stream(spark, sf).select("event_id", (F.col("event_id") % 10).alias("delivery"), F.col("ts").cast("timestamp").alias("ts"))
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    L.start_dedup(s, "delivery", "event_id", f"{base}/out", base, once=True).awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{base}/out").select("event_id", "delivery")


@query("st_repo_stats", """SELECT 'org/repo' || (user_id % 8) AS repo, count(*) AS total_reviews, sum(event_id % 5)::BIGINT AS total_issues_found,
 round(avg(value), 2) AS avg_duration_ms, count(*) FILTER (event_type = 'error') AS n_high FROM events GROUP BY 1""")
def _(spark, sf):
    s = _stream(spark, sf).select(
        F.concat(F.lit("org/repo"), (F.col("user_id") % 8).cast("string")).alias("repo"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("duration_ms"), (F.col("event_id") % 5).alias("issue_count"),
        F.when(F.col("event_type") == "error", "HIGH").otherwise("LOW").alias("risk_level"))
    return _run(spark, J.repo_stats(s), "complete").select("repo", "total_reviews", "total_issues_found", "avg_duration_ms", "n_high")


#: The month of the events table played in three and a half hours, so that minutes hold several events of a key.
FAST = 200
FAST_US = f"({US}) div {FAST}"
CTES["c_fastwin"] = _chain("user_id % 2", 60, f"epoch_us(ts) // {FAST}")


@query("st_rate_limit_stream", "SELECT event_id, k AS installation_id, row_number() OVER (PARTITION BY k, opened ORDER BY us, event_id) > 20 AS limited FROM c_fastwin")
def _(spark, sf):
    s = _stream(spark, sf).select("event_id", (F.col("user_id") % 2).alias("installation_id"), F.timestamp_micros(F.expr(FAST_US)).alias("ts"))
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    L.start_rate_limit(s, f"{base}/out", base, order="event_id", once=True).awaitTermination()
    return spark.read.schema(s.schema.add("limited", "boolean")).parquet(f"{base}/out").select("event_id", "installation_id", "limited")


#: The month in a week: a change's forty events take three quarters of an hour.
BRISK = 4
BRISK_US = f"({US}) div {BRISK}"
_SHA = f"'c' || (event_id // 40) || '-' || (epoch_us(ts) // {BRISK} // 3600000000)"
CTES["c_jobruns"] = f"""SELECT k AS sha, opened, min(us) AS us, min_by(event_id, (us, event_id)) AS event_id, min_by(event_id, (us, event_id)) // 40 AS pr_id FROM (
{_chain(_SHA, 1200, f"epoch_us(ts) // {BRISK}", "event_type <> 'signup'")}) GROUP BY 1, 2"""


@query("st_review_job", """SELECT pr_id, sha, job, jobs, issue_count, risk_level, conclusion, superseded FROM (
SELECT *, (us, job) < max((us, job)) OVER (PARTITION BY pr_id) AS superseded FROM (
 SELECT r.pr_id, r.sha, max(r.us) AS us, max_by(r.event_id, (r.us, r.event_id)) AS job, count(*) AS jobs, any_value(coalesce(d.n, 0)) AS issue_count,
  any_value(CASE WHEN d.pr_id IS NULL THEN 'N/A' WHEN d.n_error > 0 THEN 'HIGH' WHEN d.n_warning > 0 THEN 'MEDIUM' ELSE 'LOW' END) AS risk_level,
  any_value(CASE WHEN d.pr_id IS NULL THEN 'failure' WHEN d.n > 0 THEN 'action_required' ELSE 'success' END) AS conclusion
 FROM c_jobruns r LEFT JOIN (SELECT p.pr_id, count(f.ord) AS n, count(*) FILTER (severity = 'ERROR') AS n_error, count(*) FILTER (severity = 'WARNING') AS n_warning
  FROM c_prs p LEFT JOIN c_find f USING (pr_id) GROUP BY 1) d ON d.pr_id = r.pr_id GROUP BY 1, 2))""")
def _(spark, sf):
    """Jobs of all events but sign-ups; a change is forty events, its head commit is a new one each hour."""
    us = F.expr(BRISK_US)
    pr = F.expr("event_id div 40")
    sha = F.concat(F.lit("c"), pr.cast("string"), F.lit("-"), F.expr(f"{BRISK_US} div 3600000000").cast("string"))
    s = _stream(spark, sf).where("event_type <> 'signup'")
    jobs = s.select(F.concat(F.lit("org/repo"), (pr % 8).cast("string")).alias("repo"), pr.alias("pr_id"), sha.alias("sha"), F.col("event_id").alias("seq"), F.timestamp_micros(us).alias("ts"))

    def review(accepted):
        asked = accepted.select("pr_id").distinct()
        found = FI.decisions(K.prs(spark, sf).join(asked, "pr_id", "left_semi"), K.findings(spark, sf).join(asked, "pr_id", "left_semi"))
        return found.select("pr_id", F.col("n").alias("issue_count"), "risk_level", F.lit(None).cast("string").alias("error"))

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    J.start_review_table(jobs, review, base, once=True).awaitTermination()
    return J.reviews(spark, base).select("pr_id", "sha", "job", "jobs", "issue_count", "risk_level", "conclusion", "superseded")
