"""Dashboard aggregates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from pataspark.functions.scoring import TIER_MIDPOINTS
from pataspark.functions.text import percentage
from pataspark.operators.common import any_case_equal
from pataspark.operators.jobs import is_terminal

STATE_LIMIT, DISTRICT_LIMIT = 36, 50
UNKNOWN = "Unknown"


def _with_shares(counts: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Top groups with their share of the kept rows and of all rows.

    The window runs over the few groups left after the limit, never over records.
    """
    everything = counts.agg(F.sum("record_count").alias("_all")).scalar()
    top = counts.orderBy(F.desc("record_count"), *keys).limit(limit)
    kept = F.sum("record_count").over(Window.partitionBy())
    return (top.withColumn("percentage", percentage(F.col("record_count"), kept))
            .withColumn("pct_of_all", percentage(F.col("record_count"), everything)))


def _known(c: str) -> Column:
    value = F.col(c)
    return F.when(F.coalesce(value, F.lit("")) == "", UNKNOWN).otherwise(value)


def state_distribution(records: DataFrame, limit: int = STATE_LIMIT) -> DataFrame:
    counts = records.groupBy(_known("state").alias("state")).agg(F.count("*").alias("record_count"))
    return _with_shares(counts, ["state"], limit)


def district_distribution(records: DataFrame, state: str | None = None, limit: int = DISTRICT_LIMIT) -> DataFrame:
    if state:
        records = records.filter(any_case_equal(F.col("state"), F.lit(state)))
    counts = records.groupBy(_known("district").alias("district"), _known("state").alias("state")).agg(
        F.count("*").alias("record_count"))
    return _with_shares(counts, ["district", "state"], limit)


def _tier_total() -> Column:
    return sum((F.col(f"confidence_{t}") for t in TIER_MIDPOINTS), F.lit(0))


def kpi_overview(jobs_with_stats: DataFrame) -> DataFrame:
    """One row of totals, success rate, mean quality, mean confidence and time."""
    done = is_terminal(F.col("status"))
    weighted = sum((F.col(f"confidence_{t}") * F.lit(mid) for t, mid in TIER_MIDPOINTS.items()), F.lit(0.0))
    confidence = F.when(done & (_tier_total() > 0), weighted / _tier_total())
    quality = F.when(done & (F.col("final_quality_score") != 0), F.col("final_quality_score"))
    zero = F.lit(0)
    return jobs_with_stats.agg(
        F.coalesce(F.sum("total_rows"), zero).alias("total_records"),
        F.coalesce(F.sum("processed_rows"), zero).alias("processed_records"),
        F.coalesce(F.sum(F.col("total_rows") - F.col("processed_rows")), zero).alias("pending_records"),
        F.coalesce(F.sum("failed_rows"), zero).alias("failed_records"),
        F.coalesce(F.sum("manual_review_rows"), zero).alias("manual_review_records"),
        percentage(F.count_if(F.col("status") == "completed"), F.count_if(done)).alias("success_rate"),
        F.round(F.coalesce(F.avg(quality), F.lit(0.0)), 2).alias("avg_quality_score"),
        F.round(F.coalesce(F.avg(confidence), F.lit(0.0)), 2).alias("avg_confidence"),
        F.round(F.coalesce(F.sum(F.when(done, F.col("processing_time"))), F.lit(0.0)), 2).alias("total_processing_time"))


_BEFORE = ("complete_addresses", "missing_pincode", "missing_locality", "missing_city", "missing_district",
           "missing_state", "invalid_addresses", "duplicate_addresses")
_AFTER = ("pincodes_added", "cities_added", "districts_added", "states_added", "spell_corrections",
          "improved_records", "manual_review_records")


def quality_comparison(jobs_with_stats: DataFrame) -> DataFrame:
    """Before, after and delta over all jobs; a job without statistics counts as zero."""
    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    has_stats = F.col("total_records").isNotNull()
    sums = jobs_with_stats.agg(
        F.coalesce(F.sum(F.when(has_stats, F.col("total_rows"))), F.lit(0)).alias("total_records"),
        *[total(f"{c}_before").alias(f"before_{c}") for c in _BEFORE], *[total(c).alias(c) for c in _AFTER],
        F.coalesce(F.avg(F.coalesce("overall_quality_before", F.lit(0.0))), F.lit(0.0)).alias("_before"),
        F.coalesce(F.avg(F.coalesce("final_quality_score", F.lit(0.0))), F.lit(0.0)).alias("_after"))
    added = F.col("pincodes_added") + F.col("cities_added") + F.col("districts_added") + F.col("states_added")
    return (sums.withColumn("before_quality_pct", F.round("_before", 2))
            .withColumn("after_quality_pct", F.round("_after", 2))
            .withColumn("quality_improvement", F.round(F.col("_after") - F.col("_before"), 2))
            .withColumn("fill_rate", percentage(added, F.col("total_records"))).drop("_before", "_after"))


def tier_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(*[F.coalesce(F.sum(f"confidence_{t}"), F.lit(0)).alias(t) for t in TIER_MIDPOINTS])


def daily_throughput(jobs_with_stats: DataFrame, asof: datetime, days: int = 30) -> DataFrame:
    """Jobs, records and speed per completion day within the last days before ``asof``."""
    cutoff = F.lit(asof) - F.make_interval(days=F.lit(days))
    rows = jobs_with_stats.filter((F.col("status") == "completed") & (F.col("completed_at") >= cutoff))
    seconds, jobs, records = F.col("_seconds"), F.col("jobs_processed"), F.col("records_processed")
    return (rows.groupBy(F.to_date("completed_at").alias("date"))
            .agg(F.count("*").alias("jobs_processed"), F.sum("processed_rows").alias("records_processed"),
                 F.coalesce(F.sum("processing_time"), F.lit(0.0)).alias("_seconds"))
            .select("date", jobs, records,
                    F.round(F.coalesce(F.try_divide(records * F.lit(1.0), seconds), F.lit(0.0)), 2).alias("avg_records_per_second"),
                    F.round(F.coalesce(F.try_divide(seconds, jobs), F.lit(0.0)), 2).alias("avg_processing_time_seconds"))
            .orderBy("date"))


def failure_categories(chunks: DataFrame) -> DataFrame:
    failed = chunks.filter(F.col("status") == "failed")
    return (failed.groupBy(F.coalesce("error_message", F.lit("processing_error")).alias("category"))
            .agg(F.count("*").alias("error_count")).orderBy(F.desc("error_count"), "category"))


def drill_down(records: DataFrame) -> DataFrame:
    """Counts on every step State → District → City → Locality in one pass."""
    levels = ["state", "district", "city", "locality"]
    return (records.select(*[_known(c).alias(c) for c in levels]).rollup(*levels)
            .agg(F.grouping_id().cast("int").alias("level_mask"), F.count("*").alias("record_count")))


def completeness_over_time(records: DataFrame, fields: list[str]) -> DataFrame:
    """Filled share per day and column."""
    day = F.to_date("created_at").alias("date")
    counts = records.groupBy(day).agg(
        F.count("*").alias("total"), *[F.count_if(F.coalesce(F.col(f), F.lit("")) != "").alias(f) for f in fields])
    long = counts.unpivot(["date", "total"], list(fields), "column_name", "filled")
    return long.withColumn("completeness", percentage(F.col("filled"), F.col("total")))


def top_mismatches(df: DataFrame, k: int = 10, errors: str = "errors") -> DataFrame:
    """Most frequent mismatch patterns, names left out."""
    pattern = F.regexp_replace("e", "'[^']*'", "?")
    return (df.select(F.explode(errors).alias("e")).groupBy(pattern.alias("pattern"))
            .agg(F.count("*").alias("record_count")).orderBy(F.desc("record_count"), "pattern").limit(k))
