"""Jobs, chunks and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pataspark.functions.scoring import TIER_MEDIUM, progress_pct
from pataspark.schemas import TERMINAL_STATUS


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_STATUS)


def can_retry(status: Column) -> Column:
    return status.isin("failed", "cancelled")


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("row_count"))


def chunk_results(records: DataFrame) -> DataFrame:
    """Processed, succeeded (overall ≥ 60) and failed rows per job and chunk."""
    ok = F.count_if(F.coalesce(F.col("overall"), F.lit(0)) >= TIER_MEDIUM)
    return records.groupBy("job_id", "chunk_index").agg(
        F.count("*").alias("processed"), ok.alias("succeeded"), (F.count("*") - ok).alias("failed"))


def rows_to_resume(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows whose chunk is not completed; failed and pending chunks are done again."""
    done = chunks.filter(F.col("status") == "completed").select("job_id", "chunk_index").distinct()
    return rows.join(done, ["job_id", "chunk_index"], "left_anti")


def chunks_to_resume(chunks: DataFrame) -> DataFrame:
    keys = chunks.select("job_id", "chunk_index").distinct()
    return rows_to_resume(keys, chunks)


def with_stats(jobs: DataFrame, stats: DataFrame) -> DataFrame:
    return jobs.join(stats, "job_id", "left")


def job_progress(chunks: DataFrame) -> DataFrame:
    """Status and progress of each job from the state of its chunks."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    per_job = chunks.groupBy("job_id").agg(
        F.count("*").alias("total_chunks"), n("completed").alias("completed_chunks"),
        n("failed").alias("failed_chunks"), n("pending").alias("pending_chunks"),
        F.sum("row_count").alias("total_rows"),
        F.sum(F.when(F.col("status") == "completed", F.col("row_count")).otherwise(0)).alias("processed_rows"))
    status = (F.when(F.col("completed_chunks") == F.col("total_chunks"), "completed")
              .when(F.col("completed_chunks") + F.col("failed_chunks") == F.col("total_chunks"), "failed")
              .when(F.col("pending_chunks") == F.col("total_chunks"), "queued").otherwise("processing"))
    return per_job.withColumn("status", status).withColumn(
        "progress_pct", progress_pct(F.col("processed_rows"), F.col("total_rows")))


def apply_reviews(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Take over review decisions: (record_id, review_status, reviewed_by, reviewed_at, review_notes).

    Only the last decision of a record counts; records without one keep what they have.
    """
    fields = ("review_status", "reviewed_by", "reviewed_at", "review_notes")
    latest = decisions.groupBy("record_id").agg(
        F.max_by(F.struct(*fields), F.struct("reviewed_at", "review_status")).alias("_d"))
    joined = records.join(latest, "record_id", "left")
    decided = F.col("_d").isNotNull()
    return joined.select(*[
        F.when(decided, F.col(f"_d.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in records.columns])


def stage_times(stats: DataFrame) -> DataFrame:
    """Seconds spent per stage over all jobs, from the four stored timings."""
    stages = ("profiling", "processing", "reporting", "export")
    one = stats.agg(*[F.sum(f"{s}_time").alias(s) for s in stages])
    return one.unpivot([], list(stages), "stage", "seconds")


def stalled_jobs(events: DataFrame, asof: Column, seconds: int = 60) -> DataFrame:
    """Jobs whose last chunk event is older than the limit."""
    last = events.groupBy("job_id").agg(F.max("event_time").alias("last_event"))
    idle = F.unix_timestamp(asof) - F.unix_timestamp("last_event")
    return last.withColumn("idle_seconds", idle).filter(F.col("idle_seconds") > seconds)
