"""Batch jobs (tenant_id, job_id, status, attempts, error_code, dispatch_after): claims, attempts, and what ends them.

Each function takes the jobs and gives all of them after the step; other columns stay. Lists of jobs may repeat one or name
one that does not exist. What was overtaken (an attempt of another number, a job that has ended) changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import DISPATCH_SECONDS, DUE_JOBS, JOB_ATTEMPTS, UNFINISHED_JOBS
from .paging import due_jobs

_JOB = ["tenant_id", "job_id"]


def _marked(jobs: DataFrame, listed: DataFrame, mark: str, *more: str) -> DataFrame:
    return jobs.join(listed.select(*_JOB, *more).distinct().withColumn(mark, F.lit(True)), [*_JOB, *more], "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def _end(jobs: DataFrame, when: Column, code: str) -> DataFrame:
    return jobs.withColumns({"status": F.when(when, "FAILED").otherwise(F.col("status")), "error_code": F.when(when, code).otherwise(F.col("error_code"))})


def claim_jobs(jobs: DataFrame, now: Column, limit: int = DUE_JOBS) -> DataFrame:
    """The longest due unfinished jobs, at most ``limit``, are ``claimed``: not due again before some seconds have passed.

    They are a top-k of at most ``limit`` rows, which are broadcast: a claim does not shuffle the jobs.
    """
    due = F.broadcast(due_jobs(jobs, now, limit).select(*_JOB, F.lit(True).alias("claimed")))
    rows = jobs.join(due, _JOB, "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    later = now + F.make_dt_interval(secs=F.lit(DISPATCH_SECONDS))
    return rows.withColumn("dispatch_after", F.when(F.col("claimed"), later).otherwise(F.col("dispatch_after")))


def start_attempts(jobs: DataFrame, delivered: DataFrame) -> DataFrame:
    """Delivered unfinished jobs run their next attempt, or fail if all have been made."""
    rows = _marked(jobs, delivered, "_on")
    open_ = F.col("_on") & F.col("status").isin(UNFINISHED_JOBS)
    rows = rows.withColumns({"_starts": open_ & (F.col("attempts") < JOB_ATTEMPTS), "_over": open_ & (F.col("attempts") >= JOB_ATTEMPTS)})
    rows = _end(rows, F.col("_over"), "BATCH_RETRIES_EXHAUSTED")
    rows = rows.withColumns({"status": F.when(F.col("_starts"), "RUNNING").otherwise(F.col("status")), "attempts": F.col("attempts") + F.col("_starts").cast("int")})
    return rows.select(*jobs.columns)


def break_attempts(jobs: DataFrame, broken: DataFrame) -> DataFrame:
    """Running attempts (tenant_id, job_id, number) that broke for a passing reason: tried again, the last one fails."""
    rows = _marked(jobs, broken.withColumnRenamed("number", "attempts"), "_on", "attempts")
    rows = rows.withColumn("_on", F.col("_on") & (F.col("status") == "RUNNING"))
    rows = rows.withColumn("status", F.when(F.col("_on") & (F.col("attempts") < JOB_ATTEMPTS), "RETRYING").otherwise(F.col("status")))
    return _end(rows, F.col("_on") & (F.col("attempts") >= JOB_ATTEMPTS), "BATCH_RETRIES_EXHAUSTED").select(*jobs.columns)


def fail_deliveries(jobs: DataFrame, undelivered: DataFrame) -> DataFrame:
    rows = _marked(jobs, undelivered, "_on")
    rows = rows.withColumn("_on", F.col("_on") & F.col("status").isin(UNFINISHED_JOBS))
    return _end(rows, F.col("_on"), "BATCH_DELIVERY_FAILED").select(*jobs.columns)
