"""Filters over the reference tables, record, job and audit tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from pataspark.functions.geo import inside_country_box
from pataspark.operators.common import any_case_equal

SEARCH_LIMIT = 50


def pins_in(directory: DataFrame, district: str, state: str) -> DataFrame:
    return directory.filter(any_case_equal(F.col("district"), F.lit(district))
                            & any_case_equal(F.col("state"), F.lit(state)))


def localities_in(dictionary: DataFrame, city: str, district: str, state: str) -> DataFrame:
    return pins_in(dictionary, district, state).filter(any_case_equal(F.col("city"), F.lit(city)))


def by_canonical_name(dictionary: DataFrame, name: str) -> DataFrame:
    return dictionary.filter(any_case_equal(F.col("canonical_name"), F.lit(name)))


def search_names(df: DataFrame, column: str, text: str, limit: int = SEARCH_LIMIT,
                 order: Sequence[str] = ()) -> DataFrame:
    """Case-insensitive substring search; the text is taken literally."""
    hits = df.filter(F.contains(F.lower(column), F.lit(text.lower())))
    return hits.orderBy(*(order or [column])).limit(limit)


def search_alias(dictionary: DataFrame, alias: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    return dictionary.filter(F.array_contains("aliases", alias)).orderBy("id").limit(limit)


def with_tiers(records: DataFrame, tiers: Sequence[str] | None, column: str = "confidence_tier") -> DataFrame:
    """Rows of the listed tiers; no list keeps every row."""
    return records.filter(F.col(column).isin(*tiers)) if tiers else records


def review_queue(records: DataFrame, status: str | None = None) -> DataFrame:
    """By review status, or the low and unverified tiers when none is given."""
    if status:
        return records.filter(F.col("review_status") == status)
    return with_tiers(records, ("low", "unverified"))


def filter_jobs(jobs: DataFrame, *, user_id: str | int | None = None, status: str | None = None,
                created_from: datetime | None = None, created_before: datetime | None = None,
                filename: str | None = None) -> DataFrame:
    if user_id is not None:
        jobs = jobs.filter(F.col("user_id") == user_id)
    if status is not None:
        jobs = jobs.filter(F.col("status") == status)
    if created_from is not None:
        jobs = jobs.filter(F.col("created_at") >= F.lit(created_from))
    if created_before is not None:
        jobs = jobs.filter(F.col("created_at") < F.lit(created_before))
    if filename is not None:
        jobs = jobs.filter(F.col("filename") == filename)
    return jobs


def of_jobs(records: DataFrame, jobs: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the given jobs: a short list of ids, or a frame with a ``job_id`` column."""
    if isinstance(jobs, DataFrame):
        return records.join(jobs.select("job_id"), "job_id", "left_semi")
    return records.filter(F.col("job_id").isin(*jobs))


def valid_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.filter(inside_country_box(F.col(lat), F.col(lon)))


def page(df: DataFrame, order: Sequence, offset: int, limit: int) -> DataFrame:
    """One page of a sorted table."""
    return df.orderBy(*order).offset(offset).limit(limit)


def record_page(records: DataFrame, job_id: str, offset: int = 0, limit: int = 50,
                review_status: str | None = None, confidence_tier: str | None = None) -> DataFrame:
    rows = records.filter(F.col("job_id") == job_id)
    if review_status:
        rows = rows.filter(F.col("review_status") == review_status)
    if confidence_tier:
        rows = rows.filter(F.col("confidence_tier") == confidence_tier)
    return page(rows, ["row_index"], offset, limit)


def job_scan(df: DataFrame, job_id: str, order: Sequence[str]) -> DataFrame:
    """All rows of one job in order, for an export: one pruned scan and a range sort."""
    return df.filter(F.col("job_id") == job_id).orderBy(*order)


def recent_jobs(jobs: DataFrame, limit: int = 10, status: str | None = None) -> DataFrame:
    return filter_jobs(jobs, status=status).orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def pending_chunks(chunks: DataFrame, job_id: str | None = None) -> DataFrame:
    rows = chunks.filter(F.col("status") == "pending")
    if job_id is not None:
        rows = rows.filter(F.col("job_id") == job_id)
    return rows.orderBy("job_id", "chunk_index")
