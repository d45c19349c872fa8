"""Point-in-polygon joins over a fixed grid of cells.

Boundaries cover cells, points fall into one cell, so the join is an equality on the cell
followed by an exact test. Equal points are counted first: a city that holds a third of all
records is still few distinct points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pataspark.functions import geo
from pataspark.operators.common import any_case_equal, broadcast_if_small, cut_lineage

# Administrative levels of the boundary table.
STATE_LEVEL, DISTRICT_LEVEL, CITY_LEVEL, VILLAGE_LEVEL = 4, 6, 8, 10
LEVEL_NAMES = {STATE_LEVEL: "state", DISTRICT_LEVEL: "district", CITY_LEVEL: "city", VILLAGE_LEVEL: "village"}
CELL_DEGREES = 0.25
# Boundary cells carry their polygon, so the check before a broadcast counts edges (32 bytes each).
_BROADCAST_EDGES = 2_000_000
NOT_FOUND = "No containing hierarchy found for coordinates"


def _cell(v: Column) -> Column:
    return F.floor(v / CELL_DEGREES)


def prepare_boundaries(boundaries: DataFrame) -> DataFrame:
    """Add edges, bounding box and area to every boundary; written once as many joins read it."""
    e = F.col("edges")

    def bound(pick, axis: str) -> Column:
        return pick(F.transform(e, lambda s: s[axis]))

    with_edges = boundaries.select("osm_id", "admin_level", "name", "name_en", "rings",
                                   geo.edges(F.col("rings")).alias("edges"))
    return cut_lineage(
        with_edges.filter(F.size("edges") > 0)
            .select("*", bound(F.array_min, "x1").alias("min_x"), bound(F.array_max, "x1").alias("max_x"),
                    bound(F.array_min, "y1").alias("min_y"), bound(F.array_max, "y1").alias("max_y"),
                    geo.polygon_area(F.col("rings")).alias("area")))


def boundary_cells(prepared: DataFrame) -> DataFrame:
    return (prepared.withColumn("cell_x", F.explode(F.sequence(_cell(F.col("min_x")), _cell(F.col("max_x")))))
            .withColumn("cell_y", F.explode(F.sequence(_cell(F.col("min_y")), _cell(F.col("max_y"))))))


def _broadcast_if_few_edges(cells: DataFrame) -> DataFrame:
    total = cells.agg(F.sum(F.size("edges")).alias("n")).first()["n"] or 0
    return F.broadcast(cells) if total <= _BROADCAST_EDGES else cells


def distinct_points(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(x, y, point_count) of rows that have coordinates."""
    return (df.filter(geo.has_coordinates(F.col(lat), F.col(lon)))
            .groupBy(F.col(lon).alias("x"), F.col(lat).alias("y")).agg(F.count("*").alias("point_count")))


def containing_boundaries(points: DataFrame, prepared: DataFrame) -> DataFrame:
    """points(x, y, …) joined with every boundary that holds them."""
    cells = _broadcast_if_few_edges(boundary_cells(prepared).drop("rings"))
    x, y = F.col("x"), F.col("y")
    inside = (x.between(F.col("min_x"), F.col("max_x")) & y.between(F.col("min_y"), F.col("max_y"))
              & geo.point_in_polygon(x, y, F.col("edges")))
    return (points.withColumn("cell_x", _cell(x)).withColumn("cell_y", _cell(y))
            .join(cells, ["cell_x", "cell_y"]).filter(inside)
            .select(*points.columns, "osm_id", "admin_level", "name", "name_en", "area"))


def smallest_boundary(points: DataFrame, prepared: DataFrame, admin_level: int) -> DataFrame:
    """Per distinct point the smallest boundary of a level that holds it; none gives no row."""
    hits = containing_boundaries(points.select("x", "y").distinct(), prepared.filter(F.col("admin_level") == admin_level))
    pick = F.min_by(F.struct("osm_id", "name", "name_en", "admin_level"), F.struct("area", "osm_id"))
    return hits.groupBy("x", "y").agg(pick.alias("b")).select("x", "y", "b.*")


def choropleth(records: DataFrame, prepared: DataFrame, level: str) -> DataFrame:
    """Records per state or district polygon."""
    code = {name: n for n, name in LEVEL_NAMES.items()}[level]
    hits = containing_boundaries(distinct_points(records), prepared.filter(F.col("admin_level") == code))
    return hits.groupBy("osm_id", "name", "name_en").agg(F.sum("point_count").alias("record_count"))


def boundary_contains(prepared: DataFrame, outer_level: int, inner_level: int) -> DataFrame:
    """(outer_id, inner_id): all vertices of the inner inside or on the outer, no edges crossing,
    and no vertex of the outer (a hole's, say) inside the inner.

    Candidates meet on the cell of the inner boundary's first vertex.
    """
    inner = (prepared.filter(F.col("admin_level") == inner_level)
             .select(F.col("osm_id").alias("inner_id"), F.col("name").alias("inner_name"),
                     F.col("edges").alias("inner_edges"), F.col("min_x").alias("ix0"), F.col("max_x").alias("ix1"),
                     F.col("min_y").alias("iy0"), F.col("max_y").alias("iy1"))
             .withColumn("cell_x", _cell(F.col("inner_edges")[0]["x1"]))
             .withColumn("cell_y", _cell(F.col("inner_edges")[0]["y1"])))
    outer = boundary_cells(prepared.filter(F.col("admin_level") == outer_level)).select(
        "cell_x", "cell_y", F.col("osm_id").alias("outer_id"), F.col("name").alias("outer_name"),
        F.col("edges").alias("outer_edges"), "min_x", "max_x", "min_y", "max_y")
    box = ((F.col("ix0") >= F.col("min_x")) & (F.col("ix1") <= F.col("max_x"))
           & (F.col("iy0") >= F.col("min_y")) & (F.col("iy1") <= F.col("max_y")))

    def vertex_ok(e: Column) -> Column:
        return (geo.point_in_polygon(e["x1"], e["y1"], F.col("outer_edges"))
                | F.exists("outer_edges", lambda o: geo.on_edge(e["x1"], e["y1"], o)))

    intruding = F.exists("outer_edges", lambda o: geo.point_in_polygon(o["x1"], o["y1"], F.col("inner_edges")))
    crossing = F.exists("inner_edges", lambda e: F.exists("outer_edges", lambda o: geo.edges_cross(e, o)))
    return (inner.join(outer, ["cell_x", "cell_y"]).filter(box)
            .filter(F.forall("inner_edges", vertex_ok) & ~crossing & ~intruding)
            .select("outer_id", "outer_name", "inner_id", "inner_name"))


def city_hierarchy(prepared: DataFrame) -> DataFrame:
    """(city_id, city_name, district_name, state_name) from boundary containment."""
    cd = boundary_contains(prepared, DISTRICT_LEVEL, CITY_LEVEL).select(
        F.col("inner_id").alias("city_id"), F.col("inner_name").alias("city_name"),
        F.col("outer_id").alias("district_id"), F.col("outer_name").alias("district_name"))
    ds = boundary_contains(prepared, STATE_LEVEL, DISTRICT_LEVEL).select(
        F.col("inner_id").alias("district_id"), F.col("outer_name").alias("state_name"))
    return cd.join(ds, "district_id").select("city_id", "city_name", "district_name", "state_name")


def locate(points: DataFrame, prepared: DataFrame) -> DataFrame:
    """Per distinct point its city, district and state (the smallest city when several hold it)."""
    cities = containing_boundaries(points.select("x", "y").distinct(),
                                   prepared.filter(F.col("admin_level") == CITY_LEVEL))
    named = cities.join(broadcast_if_small(city_hierarchy(prepared)), F.col("osm_id") == F.col("city_id"))
    pick = F.min_by(F.struct("city_name", "district_name", "state_name"),
                    F.struct("area", "osm_id", "district_name", "state_name"))
    return named.groupBy("x", "y").agg(pick.alias("h")).select("x", "y", "h.*")


def hierarchy_errors(city: Column, district: Column, state: Column, *, located: Column) -> Column:
    """Array of mismatch messages of expected names against ``city_name`` and so on."""
    def mismatch(kind: str, expected: Column, found: str) -> Column:
        actual = F.coalesce(F.col(found), F.lit(""))
        differs = (F.coalesce(expected, F.lit("")) != "") & ~any_case_equal(expected, actual)
        return F.when(differs, F.concat(F.lit(f"{kind} mismatch: expected '"), expected,
                                        F.lit("', found '"), F.coalesce(F.col(found), F.lit("None")), F.lit("'")))

    checks = F.array_compact(F.array(
        mismatch("City", city, "city_name"), mismatch("District", district, "district_name"),
        mismatch("State", state, "state_name")))
    return F.when(located, checks).otherwise(F.array(F.lit(NOT_FOUND)))


def validate_hierarchy(df: DataFrame, prepared: DataFrame, *, lat: str = "latitude", lon: str = "longitude",
                       city: str = "city", district: str = "district", state: str = "state") -> DataFrame:
    """Add ``errors``: empty when the point lies where the names say. No coordinates, no errors."""
    found = locate(distinct_points(df, lat, lon), prepared)
    has = geo.has_coordinates(F.col(lat), F.col(lon))
    joined = df.join(found, (F.col(lon) == F.col("x")) & (F.col(lat) == F.col("y")), "left")
    errors = hierarchy_errors(F.col(city), F.col(district), F.col(state), located=F.col("x").isNotNull())
    none = F.array().cast("array<string>")
    return joined.select(*df.columns, F.when(has, errors).otherwise(none).alias("errors"))


def place_admin_names(points: DataFrame, prepared: DataFrame) -> DataFrame:
    """Place points (osm_id, x, y) with the names of the boundaries around them, one column per level."""
    hits = containing_boundaries(points.select(F.col("osm_id").alias("place_id"), "x", "y"), prepared)
    names = [F.min_by("name", F.when(F.col("admin_level") == level, F.struct("area", "osm_id"))).alias(f"{label}_name")
             for level, label in LEVEL_NAMES.items()]
    found = hits.groupBy("place_id").agg(*names)
    return (points.select(F.col("osm_id").alias("place_id")).join(found, "place_id", "left"))
