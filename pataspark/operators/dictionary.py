"""Building the locality dictionary from its three sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pataspark.functions.text import CITY_RENAMES
from pataspark.operators.chunking import dense_index

_COLUMNS = ("canonical_name", "variant", "pincode", "city", "district", "state", "latitude", "longitude",
            "population", "source", "priority")


def _title(c: str) -> Column:
    return F.initcap(F.trim(c))


def from_post_offices(directory: DataFrame) -> DataFrame:
    """Localities named by the PIN directory."""
    return directory.select(F.explode("localities").alias("n"), "pincode", "district", "state", "latitude",
                            "longitude").select(
        _title("n").alias("canonical_name"), F.trim("n").alias("variant"), "pincode", "district", "state",
        "latitude", "longitude", F.lit("india_post").alias("source"), F.lit(0).alias("priority"))


def from_places(points: DataFrame) -> DataFrame:
    """Localities from place points: (name, alt_name, pincode, city, district, state, latitude, longitude)."""
    return points.select(
        _title("name").alias("canonical_name"), F.trim(F.coalesce("alt_name", "name")).alias("variant"), "pincode",
        "city", "district", "state", "latitude", "longitude", F.lit("osm").alias("source"), F.lit(1).alias("priority"))


def from_census(villages: DataFrame) -> DataFrame:
    return villages.filter(F.col("village_name").isNotNull()).select(
        _title("village_name").alias("canonical_name"), F.trim("village_name").alias("variant"), "pincode",
        F.col("district_name").alias("district"), F.col("state_name").alias("state"), "latitude", "longitude",
        "population", F.lit("census").alias("source"), F.lit(2).alias("priority"))


def combine_sources(*sources: DataFrame) -> DataFrame:
    """Union of sources whose columns differ; absent columns are NULL."""
    types = {"population": "bigint", "latitude": "double", "longitude": "double", "priority": "int"}
    whole = sources[0]
    for s in sources[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    return whole.select(*[
        (F.col(c) if c in whole.columns else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in _COLUMNS])


def build_dictionary(*sources: DataFrame) -> DataFrame:
    """One row per name, PIN, city, district and state.

    The source with the best priority names the row, coordinates are medians, aliases are the
    other spellings plus former city names. Partial aggregation keeps distinct spellings and
    coordinates only, so a place named in a great many rows stays small.
    """
    keys = ["canonical_name", "pincode", "city", "district", "state"]
    rows = combine_sources(*sources).filter(F.coalesce("canonical_name", F.lit("")) != "")
    merged = rows.groupBy(*keys).agg(
        F.min_by("source", "priority").alias("source"), F.median("latitude").alias("latitude"),
        F.median("longitude").alias("longitude"), F.max("population").alias("population"),
        F.collect_set("variant").alias("variants"))
    former = F.create_map(*[F.lit(x) for old, new in CITY_RENAMES for x in (new, old)])
    others = F.filter("variants", lambda v: F.lower(v) != F.lower("canonical_name"))
    renamed = F.array_compact(F.array(F.try_element_at(former, F.lower("canonical_name"))))
    aliases = F.array_sort(F.array_distinct(F.concat(others, renamed)))
    return dense_index(merged.withColumn("aliases", aliases).drop("variants"), keys, "id", start=1).select(
        "id", "canonical_name", "aliases", "pincode", "city", "district", "state", "latitude", "longitude",
        "population", "source")
