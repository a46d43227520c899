"""The job queue as set operations: what is due, and what a pass changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Jobs
from tidemark.functions.scoring import backoff_seconds, seconds_between


def due(jobs: DataFrame, as_of: datetime, conf: Jobs = DEFAULTS.jobs, limit: int | None = None) -> DataFrame:
    """Pending jobs whose waiting time after the last attempt is over, oldest first."""
    wait = seconds_between(F.lit(as_of), F.col("updated_at")) >= backoff_seconds(F.col("attempts"), conf.backoff_s, conf.backoff_cap)
    found = jobs.where((F.col("status") == "pending") & ((F.col("attempts") == 0) | wait))
    return found if limit is None else found.orderBy("created_at", "id").limit(limit)


def after_pass(jobs: DataFrame, outcomes: DataFrame, as_of: datetime, conf: Jobs = DEFAULTS.jobs) -> DataFrame:
    """Jobs after a pass: ``outcomes(id, ok, error)``. Done, or one attempt more: pending again, failed at the last."""
    j = jobs.join(outcomes, "id", "left")
    tried = F.col("ok").isNotNull()
    attempts = F.col("attempts") + F.when(tried & ~F.col("ok"), 1).otherwise(0)
    status = F.when(tried & F.col("ok"), "done").when(tried & (attempts >= conf.max_attempts), "failed").when(tried, "pending").otherwise(F.col("status"))
    return j.select(
        *[c for c in jobs.columns if c not in ("status", "attempts", "last_error", "updated_at")],
        status.alias("status"), attempts.alias("attempts"), F.when(tried & ~F.col("ok"), F.col("error")).otherwise(F.col("last_error")).alias("last_error"),
        F.when(tried, F.lit(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def activity(jobs: DataFrame) -> DataFrame:
    """``job_type, pending, running`` of the unfinished jobs."""
    open_jobs = jobs.where(F.col("status").isin("pending", "running"))
    return open_jobs.groupBy("job_type").agg(F.count(F.when(F.col("status") == "pending", 1)).alias("pending"), F.count(F.when(F.col("status") == "running", 1)).alias("running"))


def enqueue(memories: DataFrame, job_types: tuple[str, ...], as_of: datetime) -> DataFrame:
    """One pending job per memory and type, with an id that is the same each time."""
    kinds = F.explode(F.array(*[F.lit(t) for t in job_types])).alias("job_type")
    return memories.select(F.col("id").alias("memory_id"), kinds).select(
        F.sha2(F.concat_ws(":", "memory_id", "job_type"), 256).alias("id"), "job_type", "memory_id", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"),
        F.lit(None).cast("string").alias("last_error"), F.lit(as_of).alias("created_at"), F.lit(as_of).alias("updated_at"),
    )
