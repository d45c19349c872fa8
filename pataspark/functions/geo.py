"""Points and polygons as plain columns: rings are arrays of arrays of struct(x, y)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Box that holds every valid coordinate.
LAT_MIN, LAT_MAX, LON_MIN, LON_MAX = 6.0, 38.0, 68.0, 98.0


def inside_country_box(lat: Column, lon: Column) -> Column:
    return lat.between(LAT_MIN, LAT_MAX) & lon.between(LON_MIN, LON_MAX)


def has_coordinates(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull()


def point_wkt(lat: Column, lon: Column) -> Column:
    return F.when(has_coordinates(lat, lon),
                  F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")))


def _ring_edges(ring: Column) -> Column:
    """Consecutive vertices as edges; the ring is closed if it is not already."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda p, q: F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def edges(rings: Column) -> Column:
    """All edges of all rings, zero-length closing edges left out."""
    return F.filter(F.flatten(F.transform(rings, _ring_edges)),
                    lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def _cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def on_edge(x: Column, y: Column, e: Column) -> Column:
    return (
        (_cross(e["x1"], e["y1"], e["x2"], e["y2"], x, y) == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def point_in_polygon(x: Column, y: Column, polygon_edges: Column) -> Column:
    """Even-odd rule over all rings, so holes count. A point on an edge is outside."""
    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return straddles & (x < at)

    odd = F.size(F.filter(polygon_edges, crosses)) % 2 == 1
    return odd & ~F.exists(polygon_edges, lambda e: on_edge(x, y, e))


def edges_cross(e: Column, f: Column) -> Column:
    """Whether two edges cross at a point inside both."""
    def side(edge: Column, px: Column, py: Column) -> Column:
        return F.signum(_cross(edge["x1"], edge["y1"], edge["x2"], edge["y2"], px, py))
    return (
        (side(e, f["x1"], f["y1"]) * side(e, f["x2"], f["y2"]) < 0)
        & (side(f, e["x1"], e["y1"]) * side(f, e["x2"], e["y2"]) < 0)
    )


def signed_ring_area(ring: Column) -> Column:
    """Shoelace formula; positive when counter-clockwise."""
    return F.aggregate(_ring_edges(ring), F.lit(0.0),
                       lambda acc, e: acc + e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2.0


def polygon_area(rings: Column) -> Column:
    """Area under the even-odd rule for rings that do not cross each other.

    A ring that lies inside an odd number of the other rings is a hole.
    """
    def signed(i_ring: Column) -> Column:
        first = i_ring[0]
        depth = F.size(F.filter(rings, lambda other: point_in_polygon(
            first["x"], first["y"], edges(F.array(other)))))
        return F.abs(signed_ring_area(i_ring)) * F.when(depth % 2 == 1, -1.0).otherwise(1.0)

    return F.aggregate(F.transform(rings, signed), F.lit(0.0), lambda acc, a: acc + a)
