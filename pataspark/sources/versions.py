"""Registry of dataset versions. A version is a folder; activating one never deletes another."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from pataspark.operators.common import last_row_wins
from pataspark.schemas import DATASET_VERSIONS


def new_version(loaded: DataFrame, dataset: str, version: str, checksum: str | None, at: datetime) -> DataFrame:
    """One registry row for a loaded dataset, with its row count."""
    return loaded.agg(F.count("*").alias("row_count")).select(
        F.lit(dataset).alias("dataset_name"), F.lit(version).alias("version"),
        F.lit(checksum).cast("string").alias("checksum_sha256"), F.lit("loaded").alias("status"), "row_count",
        F.lit(at).cast("timestamp").alias("loaded_at"), F.lit(None).cast("timestamp").alias("activated_at"),
        F.lit(None).cast("timestamp").alias("archived_at")).select(*DATASET_VERSIONS.fieldNames())


def activate(registry: DataFrame, dataset: str, version: str, at: datetime) -> DataFrame:
    """Stamp a loaded version as the active one. Stamping an older version is a rollback."""
    chosen = (F.col("dataset_name") == dataset) & (F.col("version") == version) & (F.col("status") == "loaded")
    return registry.withColumn(
        "activated_at", F.when(chosen, F.lit(at).cast("timestamp")).otherwise(F.col("activated_at")))


def active_versions(registry: DataFrame) -> DataFrame:
    """Latest activated loaded version per dataset."""
    live = registry.filter((F.col("status") == "loaded") & F.col("activated_at").isNotNull())
    return last_row_wins(live, ["dataset_name"], ["activated_at", "version"])


def duplicate_versions(registry: DataFrame) -> DataFrame:
    return (registry.groupBy("dataset_name", "version").agg(F.count("*").alias("entries"))
            .filter(F.col("entries") > 1))


def write_version(df: DataFrame, root: str, dataset: str, version: str) -> str:
    """Write a full refresh as a new version folder and return its path."""
    path = f"{root}/{dataset}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path
