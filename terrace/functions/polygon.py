"""Polygons as column expressions: rings are arrays of closed arrays of points (lon, lat), shells and holes alike, by the even-odd rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.geo import EARTH, EQUATOR_DEGREE, MERIDIAN_DEGREE, haversine


def ring_edges(ring: Column) -> Column:
    """Structs a, b of neighbouring points; none of a ring of fewer than two."""
    step = lambda k: F.struct(F.get(ring, k).alias("a"), F.get(ring, k + 1).alias("b"))
    return F.when(F.size(ring) > 1, F.transform(F.sequence(F.lit(0), F.size(ring) - 2), step)).otherwise(F.transform(F.slice(ring, 1, 0), lambda p: F.struct(p.alias("a"), p.alias("b"))))


def edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, ring_edges))


def on_border(sides: Column, lon: Column, lat: Column) -> Column:
    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straight = (b["lon"] - a["lon"]) * (lat - a["lat"]) == (lon - a["lon"]) * (b["lat"] - a["lat"])
        return straight & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    return F.exists(sides, touches)


def crossing_lon(e: Column, lat: Column) -> Column:
    a, b = e["a"], e["b"]
    return F.try_divide((b["lon"] - a["lon"]) * (lat - a["lat"]), b["lat"] - a["lat"]) + a["lon"]


def spans(e: Column, lat: Column) -> Column:
    return (e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)


def inside(sides: Column, lon: Column, lat: Column) -> Column:
    """Whether edges surround a point by casting a ray to the east; points on the border are outside."""
    crossed = F.filter(sides, lambda e: spans(e, lat) & (lon < crossing_lon(e, lat)))
    return (F.size(crossed) % 2 == 1) & ~on_border(sides, lon, lat)


def box(rings: Column) -> dict[str, Column]:
    points = F.flatten(rings)
    return {
        "west": F.array_min(F.transform(points, lambda p: p["lon"])), "south": F.array_min(F.transform(points, lambda p: p["lat"])),
        "east": F.array_max(F.transform(points, lambda p: p["lon"])), "north": F.array_max(F.transform(points, lambda p: p["lat"])),
    }


def _sum(sides: Column, of) -> Column:
    return F.aggregate(sides, F.lit(0.0), lambda total, e: total + of(e["a"], e["b"]))


def signed_area(ring: Column) -> Column:
    """In square degrees; positive if counterclockwise."""
    return _sum(ring_edges(ring), lambda a, b: (a["lon"] * b["lat"] - b["lon"] * a["lat"]) / 2)


def sphere_area(ring: Column) -> Column:
    """Square metres on the sphere; null for a missing ring."""
    part = lambda a, b: F.radians(b["lon"] - a["lon"]) * (F.lit(2.0) + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"])))
    return F.abs(_sum(ring_edges(ring), part)) * F.lit(EARTH * EARTH / 2)


def length(ring: Column) -> Column:
    """Metres along the ring."""
    return _sum(ring_edges(ring), lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))


def kept_rings(rings: Column, least_km2: float = 10.0, thinnest: float = 25.0) -> Column:
    """The shell, and the holes that are neither small nor slivers (length over the root of the area, in km)."""
    square_km = lambda r: sphere_area(r) / 1e6
    large = lambda r: (square_km(r) > least_km2) & (F.try_divide(length(r) / 1000, F.sqrt(square_km(r))) < thinnest)
    return F.filter(rings, lambda r, k: (k == 0) | large(r))


def valid(rings: Column) -> Column:
    """Closed rings without repeated points, the shell counterclockwise and holes clockwise; what has no area goes."""
    plain = F.transform(rings, lambda r: F.filter(r, lambda p, k: (k == 0) | (p != F.get(r, k - 1))))
    closed = F.transform(plain, lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))))
    whole = F.filter(closed, lambda r: (F.size(r) > 3) & (signed_area(r) != 0))
    return F.transform(whole, lambda r, k: F.when((signed_area(r) > 0) == (k == 0), r).otherwise(F.reverse(r)))


def point_on_surface(rings: Column) -> Column:
    """The middle of the widest stretch inside at the middle latitude."""
    sides, b = edges(rings), box(rings)
    lat = (b["south"] + b["north"]) / 2
    at = F.array_sort(F.transform(F.filter(sides, lambda e: spans(e, lat)), lambda e: crossing_lon(e, lat)))
    pairs = F.transform(F.filter(at, lambda x, k: k % 2 == 0), lambda x, k: F.struct((F.get(at, 2 * k + 1) - x).alias("width"), x.alias("lon")))
    best = F.array_max(pairs)
    return F.when(F.size(at) > 0, F.struct((best["lon"] + best["width"] / 2).alias("lon"), lat.alias("lat")))


def segment_metres(lon: Column, lat: Column, e: Column) -> Column:
    """From a point to an edge, on a plane that touches at the point."""
    x = lambda v: (v - lon) * F.cos(F.radians(lat)) * F.lit(EQUATOR_DEGREE)
    y = lambda v: (v - lat) * F.lit(MERIDIAN_DEGREE)
    ax, ay, bx, by = x(e["a"]["lon"]), y(e["a"]["lat"]), x(e["b"]["lon"]), y(e["b"]["lat"])
    share = F.coalesce(F.try_divide(-(ax * (bx - ax) + ay * (by - ay)), (bx - ax) * (bx - ax) + (by - ay) * (by - ay)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.sqrt(F.pow(ax + t * (bx - ax), F.lit(2)) + F.pow(ay + t * (by - ay), F.lit(2)))


def border_metres(sides: Column, lon: Column, lat: Column) -> Column:
    return F.array_min(F.transform(sides, lambda e: segment_metres(lon, lat, e)))


def geojson(rings: Column) -> Column:
    pairs = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), pairs.alias("coordinates")))


def parts_geojson(parts: Column) -> Column:
    """Of an array of rings, one for each part."""
    pairs = F.transform(parts, lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"]))))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), pairs.alias("coordinates")))


def parts_from_geojson(text: Column) -> Column:
    """An array of rings for each part of a polygon or multipolygon; null for other texts."""
    kind = F.get_json_object(text, "$.type")
    line = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    one = F.transform(F.from_json(text, "coordinates array<array<array<double>>>")["coordinates"], line)
    many = F.transform(F.from_json(text, "coordinates array<array<array<array<double>>>>")["coordinates"], lambda rings: F.transform(rings, line))
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)


def from_geojson(text: Column) -> Column:
    """Rings of a polygon, or of all parts of a multipolygon; null for other texts."""
    return F.flatten(parts_from_geojson(text))


def svg_path(rings: Column) -> Column:
    """Move, lines and close for each ring; y grows downwards."""
    number = lambda v: F.format_string("%.3f", v)
    point = lambda p: F.concat_ws(" ", number(p["lon"]), number(F.lit(0.0) - p["lat"]))
    one = lambda r: F.concat(F.lit("M "), F.array_join(F.transform(F.slice(r, F.lit(1), F.size(r) - 1), point), " L "), F.lit(" Z"))
    return F.array_join(F.transform(rings, one), " ")


def focus(west: Column, east: Column, shifted_west: Column, shifted_east: Column, child_west: Column, child_east: Column) -> tuple[Column, Column, Column]:
    """West and east of a view and the longitude of its centre, over the antimeridian where that is the shorter way.

    Shifted bounds are of longitudes from 0 to 360. A span above 350 degrees says nothing; the children's bounds do, if any.
    """
    back = lambda x: F.when(x > 180, x - 360).otherwise(x)
    wide, shorter = (east - west) > 350, (shifted_east - shifted_west) < (east - west)
    pick = lambda child, shifted, normal: F.when(wide & child_west.isNotNull(), child).when(shorter, shifted).otherwise(normal)
    middle = lambda a, b: back((a + b) / 2)
    return pick(back(child_west), back(shifted_west), west), pick(back(child_east), back(shifted_east), east), pick(middle(child_west, child_east), middle(shifted_west, shifted_east), (west + east) / 2)
