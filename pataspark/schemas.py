"""Schemas, closed value sets and small configuration records."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

# Closed value sets of the data model.
JOB_STATUS = ("pending", "profiling", "mapping", "queued", "processing", "completed", "failed", "cancelled")
CHUNK_STATUS = ("pending", "processing", "completed", "failed")
REVIEW_STATUS = ("auto", "needs_review", "manual_verified", "rejected")
CONFIDENCE_TIER = ("high", "medium", "low", "unverified")
MATCH_METHOD = ("exact", "fuzzy", "inferred", "manual")
PROCESSING_METHOD = (
    "normalization", "parsing", "pin_resolution", "locality_match",
    "spell_correction", "hierarchy_enrichment", "validation_correction", "manual_override",
)
DATA_SOURCE = ("india_post", "osm", "census", "libpostal", "rapidfuzz", "manual", "inferred")
OFFICE_TYPE = ("head", "sub", "branch")
DELIVERY_STATUS = ("delivery", "non_delivery")
LOCALITY_SOURCE = ("india_post", "osm", "census", "merged")
TERMINAL_STATUS = ("completed", "failed", "cancelled")

INPUT_FIELDS = ("line1", "line2", "landmark", "pincode", "city", "district", "state", "country")
PARSED_FIELDS = (
    "house_number", "street", "locality", "sublocality", "village",
    "city", "district", "state", "pincode", "country",
)
ENRICHED_FIELDS = ("line1", "line2", "locality", "city", "district", "state", "pincode", "country")
COMPLETENESS_FIELDS = ("house_number", "street", "locality", "city", "district", "state", "pincode")
CONTEXT_FIELDS = ("pincode", "locality", "city", "district", "state", "taluk")


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


ADDRESS_INPUT = T.StructType(_strings(*INPUT_FIELDS))
PARSED_ADDRESS = T.StructType(_strings(*PARSED_FIELDS))
ENRICHED_ADDRESS = T.StructType(_strings(*ENRICHED_FIELDS, "formatted") + _doubles("latitude", "longitude"))
CONFIDENCE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in (
        "overall", "pincode_validity", "locality_match", "hierarchy_consistency",
        "parsing_completeness", "fuzzy_quality")]
    + _strings("method", "tier")
)

PINCODE_CSV_COLUMNS = (
    "pincode", "office_name", "office_type", "delivery_status", "district", "state", "taluk",
    "circle", "region", "division", "latitude", "longitude", "localities",
)
PINCODE_DIRECTORY = T.StructType(
    _strings("pincode", "office_name", "office_type", "delivery_status", "district", "state",
             "taluk", "circle", "region", "division")
    + _doubles("latitude", "longitude")
    + [T.StructField("localities", T.ArrayType(T.StringType()))]
    + _strings("source_version")
)
LOCALITY_DICTIONARY = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("canonical_name", T.StringType()),
     T.StructField("aliases", T.ArrayType(T.StringType()))]
    + _strings("pincode", "city", "district", "state")
    + _doubles("latitude", "longitude")
    + [T.StructField("population", T.LongType())]
    + _strings("source", "source_version")
)
CENSUS_CODES = ("state_code", "district_code", "subdistrict_code", "village_code")
CENSUS_NAMES = ("state_name", "district_name", "subdistrict_name", "village_name")
CENSUS_HIERARCHY = T.StructType(
    _strings("state_code", "state_name", "district_code", "district_name", "subdistrict_code",
             "subdistrict_name", "village_code", "village_name", "level")
    + [T.StructField("population", T.LongType())]
    + _doubles("latitude", "longitude")
)
RINGS = T.ArrayType(T.ArrayType(T.StructType(_doubles("x", "y"))))
ADMIN_BOUNDARIES = T.StructType(
    [T.StructField("osm_id", T.LongType()), T.StructField("admin_level", T.IntegerType())]
    + _strings("name", "name_en", "name_hi")
    + [T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("rings", RINGS)]
)
LOCALITY_POINTS = T.StructType(
    [T.StructField("osm_id", T.LongType())] + _strings("name", "name_en", "place_type")
    + [T.StructField("tags", T.MapType(T.StringType(), T.StringType()))] + _doubles("x", "y")
)
AUDIT_COLUMNS = (
    "id", "record_id", "job_id", "field_name", "old_value", "new_value",
    "processing_method", "confidence", "source_dataset", "user_id", "created_at",
)
DATASET_VERSIONS = T.StructType(
    _strings("dataset_name", "version", "checksum_sha256", "status")
    + [T.StructField("row_count", T.LongType())]
    + [T.StructField(n, T.TimestampType()) for n in ("loaded_at", "activated_at", "archived_at")]
)
CHUNK_EVENTS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()),
    T.StructField("row_count", T.LongType()), T.StructField("total_rows", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("event_time", T.TimestampType()),
])


@dataclass(frozen=True)
class ColumnMapping:
    """Which source column holds each logical address field."""

    patient_id: str | None = None
    address_line_1: str | None = None
    address_line_2: str | None = None
    landmark: str | None = None
    pincode: str | None = None
    city: str | None = None
    district: str | None = None
    state: str | None = None
    country: str | None = None

    @classmethod
    def from_dict(cls, data: dict) -> "ColumnMapping":
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})


@dataclass(frozen=True)
class ConfidenceWeights:
    """Component weights of the overall score; they must sum to 1 within 0.001."""

    pincode_validity: float = 0.25
    locality_match: float = 0.25
    hierarchy_consistency: float = 0.20
    parsing_completeness: float = 0.15
    fuzzy_quality: float = 0.15

    def __post_init__(self) -> None:
        if abs(sum(getattr(self, f.name) for f in fields(self)) - 1.0) > 0.001:
            raise ValueError("Weights must sum to 1.0")
