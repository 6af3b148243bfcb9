"""Capture tables: content duplicates, retention and store status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capture_dedup(captures: DataFrame) -> DataFrame:
    """First uploaded capture of each content hash and the number of copies."""
    first = F.min(F.struct("uploaded_at", "capture_id"))
    return (
        captures.groupBy("sha256")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
        .select(
            "sha256",
            F.col("first.capture_id").alias("capture_id"),
            F.col("first.uploaded_at").alias("uploaded_at"),
            "copies",
        )
    )


def latest_per(table: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """Newest row per key: latest job of a capture, latest assessment of a job."""
    newest = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return (
        table.withColumn("place", F.row_number().over(newest))
        .where(F.col("place") == 1)
        .drop("place")
    )


def capture_dedup_with_job(captures: DataFrame, jobs: DataFrame) -> DataFrame:
    """Deduplicated captures with their latest job, if any."""
    job = latest_per(jobs, "capture_id", "created_at", "job_id").select(
        "capture_id", "job_id", F.col("status").alias("job_status")
    )
    return capture_dedup(captures).join(job, "capture_id", "left")


def _expired(now: datetime):
    return (
        F.col("deleted_at").isNull()
        & F.col("expires_at").isNotNull()
        & (F.col("expires_at") <= F.lit(now).cast("timestamp"))
    )


def expired_captures(captures: DataFrame, now: datetime, limit: int | None = None) -> DataFrame:
    """Captures to remove, longest expired first, optionally one batch of them."""
    chosen = captures.where(_expired(now)).orderBy("expires_at", "capture_id")
    return chosen if limit is None else chosen.limit(limit)


def expire_captures(captures: DataFrame, now: datetime, limit: int | None = None) -> DataFrame:
    """The capture table with expired rows marked deleted."""
    if limit is None:
        hit = _expired(now)
        marked = captures
    else:
        chosen = expired_captures(captures, now, limit).select(
            "capture_id", F.lit(True).alias("_expired")
        )
        marked = captures.join(chosen, "capture_id", "left")
        hit = F.coalesce(F.col("_expired"), F.lit(False))
    moment = F.lit(now).cast(captures.schema["deleted_at"].dataType)
    return marked.select(
        *[
            F.when(hit, F.lit("deleted")).otherwise(F.col(c)).alias(c)
            if c == "status"
            else F.when(hit, moment).otherwise(F.col(c)).alias(c)
            if c == "deleted_at"
            else F.col(c)
            for c in captures.columns
        ]
    )


def storage_status(captures: DataFrame, now: datetime) -> DataFrame:
    """Kept captures, their bytes, and how many of them have expired."""
    kept = F.col("deleted_at").isNull()
    return captures.agg(
        F.count_if(kept).alias("capture_count"),
        F.coalesce(F.sum(F.when(kept, F.col("file_size"))), F.lit(0)).alias("total_bytes"),
        F.count_if(_expired(now)).alias("expired_count"),
    )


def flow_retention(stored: DataFrame, now: datetime, keep_days: int = 90) -> DataFrame:
    """Flows young enough to keep. ``day`` is the partition column, so old files are not read."""
    oldest = F.to_date(F.lit(now).cast("timestamp") - F.expr(f"INTERVAL '{int(keep_days)}' DAY"))
    return stored.where(F.col("day") >= oldest)
