"""Writing results: plain exports and re-runnable partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from pataspark.schemas import AUDIT_COLUMNS

_ENRICHED = ("line1", "line2", "locality", "city", "district", "state", "pincode", "country")
_ORIGINAL = ("line1", "line2", "landmark", "pincode", "city", "district", "state", "country")


def csv_to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_columns(records: DataFrame, include_original: bool = True) -> DataFrame:
    """The 15 result columns and, if wanted, the 8 original ones; NULL becomes empty text."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    columns = [F.col("record_id"), F.col("row_index"), text("patient_id_hash").alias("patient_id_hash")]
    columns += [text(f"enriched.{f}").alias(f"enriched_{f}") for f in _ENRICHED]
    columns += [
        F.coalesce("confidence.overall", F.lit(0)).alias("confidence_overall"),
        F.coalesce("confidence.tier", F.lit("unverified")).alias("confidence_tier"),
        F.coalesce("confidence.method", F.lit("manual")).alias("match_method"), F.col("review_status")]
    if include_original:
        columns += [text(f"original.{f}").alias(f"original_{f}") for f in _ORIGINAL]
    return records.select(*columns)


def audit_export_columns(audit: DataFrame, null_as_text: bool = True) -> DataFrame:
    """The 11 audit columns; in text files missing values are empty text."""
    texts = ("old_value", "new_value", "user_id")
    return audit.select(*[
        F.coalesce(F.col(c), F.lit("")).alias(c) if null_as_text and c in texts
        else F.col(c).alias("timestamp" if c == "created_at" else c) for c in AUDIT_COLUMNS])


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with header or Parquet, one file per partition."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True, escape='"')
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unsupported format: {fmt}")


def write_partitions(df: DataFrame, path: str, keys: Sequence[str], rows_per_file: int = 1_000_000) -> None:
    """Replace exactly the partitions that occur in ``df``; running it again changes nothing.

    Files are cut by row count instead of shuffling each key into one task, so one huge job
    is still written by many tasks.
    """
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).parquet(path))


def write_records(records: DataFrame, path: str) -> None:
    """Records laid out by job and chunk."""
    keys = ["job_id"] + (["chunk_index"] if "chunk_index" in records.columns else [])
    write_partitions(records, path, keys)


def append_audit(audit: DataFrame, path: str) -> None:
    """Append audit rows by month; rows whose id the month already has are left out.

    Ids are stable, so running a batch again adds nothing. Only the ids of the months concerned are read.
    """
    rows = audit.withColumn("year_month", F.date_format("created_at", "yyyy-MM")).dropDuplicates(["id", "year_month"])
    try:
        written = audit.sparkSession.read.schema("id " + audit.schema["id"].dataType.simpleString() + ", year_month string").parquet(path)
        written.isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        months = [r.year_month for r in rows.select("year_month").distinct().collect()]
        rows = rows.join(written.filter(F.col("year_month").isin(months)), ["id", "year_month"], "left_anti")
    rows.write.mode("append").partitionBy("year_month").parquet(path)
