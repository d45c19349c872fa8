"""Reading uploads and reference datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pataspark import schemas as S
from pataspark.functions.text import is_pin, split_list

# Limits of an upload batch.
MAX_FILES, MAX_FILE_BYTES, MAX_COLUMNS, MAX_ROWS = 50, 2 * 1024**3, 500, 50_000_000
ALLOWED_EXTENSIONS = (".csv", ".xls", ".xlsx")
ALLOWED_CONTENT_TYPES = (
    "text/csv", "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
)


def read_csv(spark: SparkSession, paths: str | Sequence[str], *, file_column: str | None = None) -> DataFrame:
    """One or many CSV files with a header, every column as text, so codes keep leading zeros."""
    df = spark.read.csv(paths if isinstance(paths, str) else list(paths), header=True, inferSchema=False,
                        multiLine=False, escape='"')
    return df.select("*", F.col("_metadata.file_path").alias(file_column)) if file_column else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def infer_types(df: DataFrame) -> DataFrame:
    """(column_name, dtype) guessed from all filled values of text columns: bigint, double or string."""
    text = [F.col(f"`{c}`") for c in df.columns]
    checks = []
    for name, c in zip(df.columns, text):
        filled = F.count_if(c.isNotNull() & (c != ""))
        checks.append(F.struct(
            F.lit(name).alias("column_name"),
            F.when(filled == 0, "string")
            .when(F.count_if(F.expr(f"try_cast(`{name}` AS BIGINT)").isNotNull()) == filled, "bigint")
            .when(F.count_if(F.expr(f"try_cast(`{name}` AS DOUBLE)").isNotNull()) == filled, "double")
            .otherwise("string").alias("dtype")))
    return df.agg(F.array(*checks).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def check_upload(filename: str, content_type: str) -> None:
    """Raise on a content type or extension that is not accepted."""
    if content_type not in ALLOWED_CONTENT_TYPES:
        raise ValueError(f"Unsupported file type: {content_type}")
    if not filename.lower().endswith(ALLOWED_EXTENSIONS):
        raise ValueError(f"Unsupported file extension: {filename}")


def upload_violations(df: DataFrame, *, max_file_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES,
                      max_columns: int = MAX_COLUMNS, max_rows: int = MAX_ROWS) -> DataFrame:
    """(subject, rule, actual, allowed) for every broken limit of a file-backed frame; empty if fine."""
    columns = len(df.columns)
    files = (df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
             .groupBy("path").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows")))
    too_big = files.filter(F.col("bytes") > max_file_bytes).select(
        F.col("path").alias("subject"), F.lit("file_bytes").alias("rule"), F.col("bytes").alias("actual"),
        F.lit(max_file_bytes).cast("bigint").alias("allowed"))
    totals = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    limits = F.array(*[F.struct(
        F.lit("batch").alias("subject"), F.lit(rule).alias("rule"), actual.cast("bigint").alias("actual"),
        F.lit(allowed).cast("bigint").alias("allowed")) for rule, actual, allowed in (
            ("files", F.col("files"), max_files), ("rows", F.col("rows"), max_rows),
            ("columns", F.lit(columns), max_columns))])
    batch = totals.select(F.explode(limits).alias("l")).select("l.*").filter(F.col("actual") > F.col("allowed"))
    return too_big.unionByName(batch)


def load_pincode_directory(raw: DataFrame, version: str, *, clean: bool = True) -> DataFrame:
    """Typed PIN directory from raw text rows.

    ``clean`` also trims, lower-cases the closed value sets, title-cases the names and keeps
    valid PINs only.
    """
    require_columns(raw, S.PINCODE_CSV_COLUMNS)

    def text(c: str) -> Column:
        return F.trim(c) if clean else F.col(c)

    def title(c: str) -> Column:
        return F.initcap(F.trim(c)) if clean else F.col(c)

    kind = (lambda c: F.lower(F.trim(c))) if clean else F.col
    items = split_list(F.col("localities"))
    df = raw.select(
        text("pincode").alias("pincode"), text("office_name").alias("office_name"),
        kind("office_type").alias("office_type"), kind("delivery_status").alias("delivery_status"),
        title("district").alias("district"), title("state").alias("state"),
        *[text(c).alias(c) for c in ("taluk", "circle", "region", "division")],
        F.col("latitude").try_cast("double").alias("latitude"),
        F.col("longitude").try_cast("double").alias("longitude"),
        (F.transform(items, lambda x: F.initcap(x)) if clean else items).alias("localities"),
        F.lit(version).alias("source_version"))
    return df.filter(is_pin(F.col("pincode"))) if clean else df


def load_locality_dictionary(raw: DataFrame, version: str) -> DataFrame:
    """Dictionary rows with defaults for the optional columns."""
    require_columns(raw, ("id", "canonical_name", "pincode", "city", "district", "state"))
    defaults = {"aliases": F.array().cast("array<string>"), "source": F.lit("merged"), "source_version": F.lit(version)}
    fields = []
    for f in S.LOCALITY_DICTIONARY.fields:
        if f.name in raw.columns and f.name != "source_version":
            c = F.col(f.name).cast(f.dataType)
            fields.append((F.coalesce(c, defaults[f.name]) if f.name in defaults else c).alias(f.name))
        else:
            fields.append(defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
    return raw.select(*fields)


def load_census(raw: DataFrame) -> DataFrame:
    """Census rows with codes as text; optional columns that are absent become NULL."""
    require_columns(raw, ("state_code", "state_name", "level"))
    return raw.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in S.CENSUS_HIERARCHY.fields])


def _geojson_rings(geometry: Column) -> Column:
    """Rings of a GeoJSON Polygon or MultiPolygon text as arrays of struct(x, y)."""
    kind = F.get_json_object(geometry, "$.type")
    text = F.get_json_object(geometry, "$.coordinates")
    ring = T.ArrayType(T.ArrayType(T.DoubleType()))
    polygon = F.from_json(text, T.ArrayType(ring))
    multi = F.flatten(F.from_json(text, T.ArrayType(T.ArrayType(ring))))
    rings = F.when(kind == "MultiPolygon", multi).when(kind == "Polygon", polygon)
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def load_boundaries(raw: DataFrame) -> DataFrame:
    """Administrative boundaries that carry a level.

    ``raw`` has osm_id, tags (map) and either ``rings`` or ``geometry`` (GeoJSON text).
    """
    tag = F.col("tags")
    rings = F.col("rings") if "rings" in raw.columns else _geojson_rings(F.col("geometry"))
    level = F.try_element_at(tag, F.lit("admin_level")).try_cast("int")
    return raw.filter((F.try_element_at(tag, F.lit("boundary")) == "administrative") & level.isNotNull()).select(
        "osm_id", level.alias("admin_level"), F.try_element_at(tag, F.lit("name")).alias("name"),
        F.try_element_at(tag, F.lit("name:en")).alias("name_en"),
        F.try_element_at(tag, F.lit("name:hi")).alias("name_hi"), "tags", rings.alias("rings"))


def load_places(raw: DataFrame) -> DataFrame:
    """Points that carry a place tag: osm_id, tags, x, y."""
    tag = F.col("tags")
    place = F.try_element_at(tag, F.lit("place"))
    return raw.filter(place.isNotNull()).select(
        "osm_id", F.try_element_at(tag, F.lit("name")).alias("name"),
        F.try_element_at(tag, F.lit("name:en")).alias("name_en"), place.alias("place_type"), "tags", "x", "y")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def rejects(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the broken rules."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)
