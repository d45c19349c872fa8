"""Reports, exports, profiles and reference refresh built from the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from pataspark.operators import dashboard, jobs, profile, quality
from pataspark.operators.audit import change, changed_fields
from pataspark.operators.common import cut_lineage
from pataspark.operators.lookups import of_jobs, recent_jobs, with_tiers
from pataspark.sources import readers, versions, writers


def profile_dataset(df: DataFrame, row_index: str, columns: list[str] | None = None) -> DataFrame:
    """Column profile with samples and the address-column verdict."""
    columns = columns or [c for c in df.columns if c != row_index]
    stats = profile.profile_columns(df, columns)
    samples = profile.sample_values(df, columns, row_index)
    verdict = profile.detect_address_columns(df, row_index, columns)
    return stats.join(samples, "column_name", "left").join(verdict, "column_name")


def job_quality_stats(records: DataFrame) -> DataFrame:
    """Stored statistics per job, measured from processed records."""
    key_fields = ["line1", "line2", "pincode", "locality", "city", "district", "state"]
    # Read three times below.
    records = cut_lineage(records.select("job_id", "confidence", "normalized", "parsed", "enriched"))

    def flat(side: str, locality: Column) -> DataFrame:
        return records.select("job_id", locality.alias("locality"), *[
            F.col(f"{side}.{f}").alias(f) for f in ("line1", "line2", "pincode", "city", "district", "state")])

    before = quality.quality_baseline(flat("normalized", F.col("parsed.locality")), key_fields, ["job_id"])
    after = quality.quality_baseline(flat("enriched", F.col("enriched.locality")), key_fields, ["job_id"])
    names = {c: f"{c}_before" for c in before.columns if c not in ("job_id", "total_records", "overall_quality_pct")}
    b = before.withColumnsRenamed(names | {"overall_quality_pct": "overall_quality_before"})
    a = after.select("job_id", F.col("overall_quality_pct").alias("final_quality_score"))
    sides = records.select("job_id", "confidence", F.struct(
        F.col("normalized.pincode").alias("pincode"), F.col("parsed.locality").alias("locality"),
        *[F.col(f"normalized.{f}").alias(f) for f in ("city", "district", "state")]).alias("b"),
        F.struct(*[F.col(f"enriched.{f}").alias(f) for f in quality.QUALITY_FIELDS]).alias("a"))

    def filled(side: str) -> Column:
        return sum((F.when(F.coalesce(F.col(f"{side}.{f}"), F.lit("")) != "", 1).otherwise(0)
                    for f in quality.QUALITY_FIELDS), F.lit(0))

    def added(f: str) -> Column:
        return F.count_if((F.coalesce(F.col(f"b.{f}"), F.lit("")) == "") & (F.coalesce(F.col(f"a.{f}"), F.lit("")) != ""))

    corrected = [F.when((F.col(f"b.{f}") != "") & (F.col(f"a.{f}") != "") & (F.col(f"b.{f}") != F.col(f"a.{f}")), 1)
                 .otherwise(0) for f in ("locality", "city", "district", "state")]
    tier = F.col("confidence.tier")
    measured = sides.groupBy("job_id").agg(
        added("pincode").alias("pincodes_added"), added("city").alias("cities_added"),
        added("district").alias("districts_added"), added("state").alias("states_added"),
        F.sum(sum(corrected, F.lit(0))).alias("spell_corrections"),
        F.count_if(filled("a") > filled("b")).alias("improved_records"),
        F.count_if(tier.isin("low", "unverified")).alias("manual_review_records"),
        *[F.count_if(tier == t).alias(f"confidence_{t}") for t in ("high", "medium", "low", "unverified")])
    return (b.join(a, "job_id").join(measured, "job_id")
            .withColumn("improvement_percentage", F.round(F.col("final_quality_score") - F.col("overall_quality_before"), 2)))


def job_report(stats: DataFrame, jobs_table: DataFrame | None = None) -> DataFrame:
    """Report columns per job; with a job table only completed jobs get one."""
    if jobs_table is not None:
        stats = stats.join(jobs_table.filter(F.col("status") == "completed").select("job_id"), "job_id", "left_semi")
    return quality.report_from_stats(stats)


def export_results(records: DataFrame, *, tiers: list[str] | None = None, include_original: bool = True) -> DataFrame:
    """Rows of an export file, optionally of some tiers only."""
    return writers.export_columns(with_tiers(records, tiers), include_original)


def export_all(records: DataFrame, path: str, fmt: str = "csv", include_original: bool = True) -> None:
    """The default file, the review queue (low, unverified) and the high-confidence file."""
    for name, tiers in (("all", None), ("review_queue", ["low", "unverified"]), ("high", ["high"])):
        writers.write_table(export_results(records, tiers=tiers, include_original=include_original), f"{path}/{name}", fmt)


def refresh(raw: DataFrame, dataset: str, version: str, root: str, registry: DataFrame, at: datetime,
            checksum: str | None = None) -> tuple[str, DataFrame]:
    """Load a raw reference table as a new version, register and activate it.

    Returns the path and the new registry. The old version stays on disk, so a rollback is
    another activation.
    """
    load = {
        "pincode": lambda: readers.load_pincode_directory(raw, version),
        "locality": lambda: readers.load_locality_dictionary(raw, version),
        "census": lambda: readers.load_census(raw),
        "boundaries": lambda: readers.load_boundaries(raw),
        "places": lambda: readers.load_places(raw),
    }[dataset]
    path = versions.write_version(load(), root, dataset, version)
    stored = raw.sparkSession.read.parquet(path)
    row = versions.new_version(stored, dataset, version, checksum, at)
    return path, versions.activate(registry.unionByName(row), dataset, version, at)


def review_records(records: DataFrame, decisions: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame]:
    """Apply reviewer decisions; returns the new records and one audit row per changed status."""
    reviewed = jobs.apply_reviews(records, decisions)
    old = records.select("record_id", F.col("review_status").alias("_old"))
    pairs = reviewed.join(old, "record_id").filter(F.col("reviewed_by").isNotNull())
    trail = changed_fields(
        pairs, [change("review_status", F.col("_old"), F.col("review_status"), "manual_override", 100, "manual")],
        created_at=F.lit(at).cast("timestamp"), user_id=F.col("reviewed_by"))
    return reviewed, trail


def dashboard_pack(jobs_table: DataFrame, stats: DataFrame, records: DataFrame, chunks: DataFrame,
                   asof: datetime, only: DataFrame | None = None, days: int = 30) -> dict[str, DataFrame]:
    """All dashboard frames by name, for the jobs of ``only(job_id)`` or for all jobs."""
    if only is not None:
        jobs_table, stats, chunks = (of_jobs(t, only) for t in (jobs_table, stats, chunks))
    joined = jobs.with_stats(jobs_table, stats)
    shown = of_jobs(records, jobs_table)
    return {
        "overview": dashboard.kpi_overview(joined),
        "quality": dashboard.quality_comparison(joined),
        "confidence": dashboard.tier_totals(stats),
        "states": dashboard.state_distribution(shown),
        "districts": dashboard.district_distribution(shown),
        "performance": dashboard.daily_throughput(joined, asof, days),
        "errors": dashboard.failure_categories(chunks),
        "recent_jobs": recent_jobs(jobs_table),
        "reports": recent_jobs(jobs_table, status="completed"),
    }
