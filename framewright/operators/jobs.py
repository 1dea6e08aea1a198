"""Analysis jobs as an append-only log; what is visible follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "source_id string, analysis_id string, content_hash string, fingerprint string, status string, at timestamp, error string"


def begin(sources: DataFrame, at) -> DataFrame:
    """Log rows that an attempt begins: sources has source_id, analysis_id, content_hash, fingerprint."""
    return _rows(sources, "running", at, F.lit(None).cast("string"))


def fail(sources: DataFrame, at, error: str) -> DataFrame:
    """Log rows that an attempt failed; what was active stays active."""
    return _rows(sources, "failed", at, F.lit(error))


def promote(sources: DataFrame, at) -> DataFrame:
    """Log rows that an analysis is complete: appended last, they are the only thing that makes it visible."""
    return _rows(sources, "completed", at, F.lit(None).cast("string"))


def _rows(sources: DataFrame, status: str, at, error) -> DataFrame:
    return sources.select("source_id", "analysis_id", "content_hash", "fingerprint", F.lit(status).alias("status"), F.lit(at).cast("timestamp").alias("at"), error.alias("error"))


def jobs(log: DataFrame) -> DataFrame:
    """source_id, active (the newest completed attempt), last_status, last_error, attempts, from the whole log.

    One map-side aggregate by source; of entries of one time a completed one is newest.
    """
    entry = F.struct("analysis_id", "content_hash", "fingerprint")
    order = F.struct("at", (F.col("status") == "completed").cast("int"), "analysis_id")
    return log.where("source_id is not null").groupBy("source_id").agg(
        F.max_by(entry, F.when(F.col("status") == "completed", order)).alias("active"),
        F.max_by("status", order).alias("last_status"),
        F.max_by("error", order).alias("last_error"),
        F.count_if(F.col("status") == "running").alias("attempts"),
    )


def exit_code(log: DataFrame) -> int:
    """1 if the last attempt of any source failed, else 0."""
    return int(jobs(log).where("last_status = 'failed'").limit(1).count() > 0)
