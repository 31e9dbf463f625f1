"""Aggregates and jobs over review streams; each also runs as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from patchlight import constants as C
from patchlight.streaming import upsert
from patchlight.streaming.limits import first_per_ttl


def repo_stats(reviews: DataFrame) -> DataFrame:
    """Running statistics per repository. The risk distribution is three counters, so the state has
    a fixed size and the aggregation merges partially; valid in batch and in update mode."""
    risk = F.col("risk_level")
    return reviews.groupBy("repo").agg(
        F.count("*").alias("total_reviews"),
        F.sum("issue_count").alias("total_issues_found"),
        F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"),
        F.count_if(risk == "HIGH").alias("n_high"),
        F.count_if(risk == "MEDIUM").alias("n_medium"),
        F.count_if(risk == "LOW").alias("n_low"),
        F.max("ts").alias("last_review_at"),
    )


def superseded(reviews: DataFrame) -> DataFrame:
    """reviews: pr_id, review_id, ts, by_bot. Older bot reviews of a change are superseded by its newest."""
    newest = reviews.where("by_bot").groupBy("pr_id").agg(F.max(F.struct("ts", "review_id")).alias("_n"))
    return reviews.join(newest, "pr_id", "left").withColumn(
        "superseded", F.col("by_bot") & F.coalesce(F.struct("ts", "review_id") < F.col("_n"), F.lit(False))).drop("_n")


def start_review_job(jobs: DataFrame, review, out: str, checkpoint: str, once: bool = False):
    """Review each micro-batch of jobs with a batch plan and write one folder per batch.

    review takes the batch of jobs and returns result rows with repo. A batch that runs again after
    a lost executor or driver overwrites its own folder, so results appear once.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        review(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    w = jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


#: What the review table holds for a head commit of a change. job and reviewed_us name the job that gave the row; jobs counts those that were run.
REVIEWS = StructType([
    StructField("repo", StringType()), StructField("pr_id", LongType()), StructField("sha", StringType()), StructField("job", LongType()),
    StructField("reviewed_us", LongType()), StructField("jobs", LongType()), StructField("issue_count", LongType()), StructField("risk_level", StringType()),
    StructField("conclusion", StringType()), StructField("error", StringType()),
])
LOCKS = StructType([StructField("repo", StringType()), StructField("sha", StringType()), StructField("opened", LongType())])


def reviewed(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Rows of the review table for jobs (repo, pr_id, sha, seq, us) and results (pr_id, issue_count, risk_level, error).

    A change without a result, or with an error, has failed: no issues, no risk, and why. Of several jobs of one commit the last one counts.
    """
    last = jobs.groupBy("repo", "pr_id", "sha").agg(F.max(F.struct("us", "seq")).alias("_j"), F.count("*").alias("jobs"))
    found = results.select("pr_id", "issue_count", "risk_level", "error", F.lit(True).alias("_found"))
    error = F.when(F.col("_found").isNull(), "no such change").otherwise(F.col("error"))
    ok = error.isNull()
    rows = last.join(found, "pr_id", "left")
    return rows.select(
        "repo", "pr_id", "sha", F.col("_j.seq").alias("job"), F.col("_j.us").alias("reviewed_us"), "jobs",
        F.when(ok, F.col("issue_count")).otherwise(0).cast("bigint").alias("issue_count"), F.when(ok, F.col("risk_level")).otherwise("N/A").alias("risk_level"),
        F.when(~ok, "failure").when(F.col("issue_count") > 0, "action_required").otherwise("success").alias("conclusion"), error.alias("error"),
    ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REVIEWS])


def _latest(both: DataFrame) -> DataFrame:
    rest = [c for c in REVIEWS.names if c not in ("repo", "pr_id", "sha", "jobs")]
    row = F.max_by(F.struct(*rest), F.struct("reviewed_us", "job", "_new"))
    return both.groupBy("repo", "pr_id", "sha").agg(row.alias("_r"), F.sum("jobs").alias("jobs")).select("repo", "pr_id", "sha", "jobs", "_r.*")


def start_review_table(jobs: DataFrame, review: Callable[[DataFrame], DataFrame], base: str, seconds: int = C.LOCK_TTL_SECONDS, once: bool = False):
    """Review jobs (repo, pr_id, sha, seq, ts) micro-batch by micro-batch into a table keyed by (repo, pr_id, sha).

    A job takes the lock of its (repo, sha) for `seconds`; jobs that meet a held lock are dropped, later ones review the commit anew and replace its row. review is a
    batch plan: the accepted jobs in, (pr_id, issue_count, risk_level, error) per change out. Locks and reviews are replaced by key under the batch's epoch, so a
    batch that runs again, after a lost executor or driver, changes nothing.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        timed = batch.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).where("us IS NOT NULL").select("repo", "pr_id", "sha", "seq", "us")
        held = upsert.read(spark, f"{base}/locks", LOCKS, epoch) if epoch else spark.createDataFrame([], LOCKS)
        held = held.select(F.col("repo").alias("_repo"), F.col("sha").alias("_sha"), "opened")
        same = F.col("repo").eqNullSafe(F.col("_repo")) & F.col("sha").eqNullSafe(F.col("_sha"))
        free = timed.join(held, same, "left").where(F.col("opened").isNull() | (F.col("us") >= F.col("opened") + seconds * 1_000_000))
        first = first_per_ttl(free.select(*timed.columns), ["repo", "sha"], "us", "seq", seconds)
        first.write.mode("overwrite").parquet(f"{base}/accepted/{epoch}")
        accepted = spark.read.schema(first.schema).parquet(f"{base}/accepted/{epoch}")
        rows = reviewed(accepted, review(accepted))
        upsert.upsert(rows, f"{base}/reviews", ["repo", "pr_id", "sha"], epoch, _latest)
        locks = accepted.groupBy("repo", "sha").agg(F.max("us").cast("bigint").alias("opened")).select(*LOCKS.names)
        upsert.upsert(locks, f"{base}/locks", ["repo", "sha"], epoch, lambda both: both.groupBy("repo", "sha").agg(F.max("opened").alias("opened")))
        for name, schema in (("reviews", REVIEWS), ("locks", LOCKS)):
            upsert.forget(spark, f"{base}/{name}", schema, epoch)

    w = jobs.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state")
    return (w.trigger(availableNow=True) if once else w).start()


def reviews(spark: SparkSession, base: str) -> DataFrame:
    """The review table with superseded: a newer review of the change is there."""
    now = upsert.read(spark, f"{base}/reviews", REVIEWS)
    newest = now.groupBy("repo", "pr_id").agg(F.max(F.struct("reviewed_us", "job")).alias("_n"))
    on = F.col("repo").eqNullSafe(F.col("_repo")) & F.col("pr_id").eqNullSafe(F.col("_pr"))
    newest = newest.select(F.col("repo").alias("_repo"), F.col("pr_id").alias("_pr"), "_n")
    return now.join(newest, on).withColumn("superseded", F.struct("reviewed_us", "job") < F.col("_n")).drop("_repo", "_pr", "_n")
