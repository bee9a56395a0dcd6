"""Submitted postings: what goes through on its own, what waits for a reviewer, and what reviewers decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..schemas import REVIEW_QUEUE, conform

PENDING, MERGED, CONFIRMED, REJECTED = "pending", "auto_merged", "confirmed", "rejected"


def submissions(previews: DataFrame, now: str, mode: str = "auto") -> DataFrame:
    """Queue entries of previewed postings: job_id, route_status and what else is known, kept as JSON.

    Only in mode auto, postings of an existing job go through; all others wait. The id follows
    from posting, mode and time, so that a submission that runs twice makes one entry.
    """
    if mode not in ("auto", "manual"):
        raise ValueError("mode has to be auto or manual")
    status = F.when((F.lit(mode) == "auto") & (F.col("route_status") == "existing_job"), MERGED).otherwise(PENDING)
    payload = F.to_json(F.struct(*(c for c in previews.columns if c not in ("job_id", "route_status"))))
    out = previews.select(stable_id(F.col("job_id"), F.lit(mode), F.lit(now)).alias("review_id"), "job_id", status.alias("status"), "route_status", payload.alias("payload"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return conform(out, REVIEW_QUEUE)


def decided(queue: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """The entries that decisions (review_id, decision: confirmed or rejected) change; one that is not pending, or not there, is an error."""
    fail = lambda said: F.raise_error(F.concat(F.lit(said), "review_id")).cast("boolean")
    rows = decisions.select("review_id", "decision").distinct().join(queue, "review_id", "left")
    error = F.when(F.col("status").isNull(), fail("no review ")).when(F.col("status") != PENDING, fail("not pending: ")).when(~F.col("decision").isin(CONFIRMED, REJECTED), fail("unknown decision for "))
    rows = rows.withColumn("_e", error).where("_e IS NULL").drop("_e")
    return conform(rows.drop("status", "updated_at").withColumn("updated_at", F.lit(now)).withColumnRenamed("decision", "status"), REVIEW_QUEUE)


def accepted(queue: DataFrame) -> DataFrame:
    """review_id, job_id and payload of entries whose postings belong to the event stream."""
    return queue.where(F.col("status").isin(MERGED, CONFIRMED)).select("review_id", "job_id", "payload")
