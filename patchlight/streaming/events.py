"""Webhook feed to review jobs; the same columns run on batch and streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C

PAYLOAD = (
    "struct<action:string,pull_request:struct<html_url:string>,comment:struct<body:string>,"
    "issue:struct<pull_request:struct<html_url:string>>,installation:struct<id:bigint>>"
)


def classify(events: DataFrame, trigger: str) -> DataFrame:
    """events: delivery_id, ts, event, payload. Adds status (job, ignored, rejected), pr_url, job_event, installation_id."""
    p = events.withColumn("_p", F.from_json("payload", PAYLOAD))
    is_pr, is_comment = F.col("event") == "pull_request", F.col("event") == "issue_comment"
    url = F.when(is_pr, F.coalesce("_p.pull_request.html_url", F.lit(""))).when(
        is_comment, F.coalesce("_p.issue.pull_request.html_url", F.lit("")))
    ok_pr = is_pr & F.coalesce(F.col("_p.action").isin(C.PR_ACTIONS), F.lit(False))
    ok_comment = (
        is_comment & F.coalesce(F.col("_p.action") == "created", F.lit(False))
        & F.coalesce(F.col("_p.comment.body").contains(trigger), F.lit(False)) & (url != ""))
    status = F.when(ok_pr & (url == ""), "rejected").when(ok_pr | ok_comment, "job").otherwise("ignored")
    return p.select(
        *events.columns, status.alias("status"), F.when(status == "job", url).alias("pr_url"),
        F.when(status == "job", F.concat("event", F.lit("."), "_p.action")).alias("job_event"),
        F.col("_p.installation.id").alias("installation_id"))


def review_jobs(events: DataFrame, trigger: str) -> DataFrame:
    return classify(events, trigger).where("status = 'job'").drop("status", "payload")


def rejected(events: DataFrame, trigger: str) -> DataFrame:
    return classify(events, trigger).where("status = 'rejected'").select("delivery_id", "ts", "event")
