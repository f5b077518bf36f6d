"""Distances, boxes, tiles and projections as column expressions. Longitudes and latitudes are in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres.
EARTH, EQUATOR_DEGREE, MERIDIAN_DEGREE, WEB_EARTH = 6_371_000.0, 111_320.0, 110_540.0, 6_378_137.0
MOST_LATITUDE = 85.06


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def flat_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """On a plane that touches at the mean latitude."""
    x = (lon2 - lon1) * F.lit(EQUATOR_DEGREE) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(x * x + F.pow((lat2 - lat1) * F.lit(MERIDIAN_DEGREE), F.lit(2)))


def box_size_km(west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Width (across the antimeridian where west > east) and height."""
    span = F.when(west <= east, east - west).otherwise(east - west + 360)
    return span * F.lit(111.0) * F.cos(F.radians((south + north) / 2)), (north - south) * F.lit(111.0)


def in_box(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """With its borders; west > east is a box over the antimeridian."""
    across = F.when(west > east, (lon >= west) | (lon <= east)).otherwise(lon.between(west, east))
    return across & lat.between(south, north)


def in_view(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Longitudes modulo 360; west > east is a view over the antimeridian, and one as wide as the world sees all longitudes."""
    width = F.when(west <= east, east - west).otherwise(east + 360 - west)
    return lat.between(south, north) & ((width >= 360) | (F.pmod(F.pmod(lon - west, F.lit(360.0)) + 360, F.lit(360.0)) <= width))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres; latitudes are held within where it is defined."""
    held = F.greatest(F.lit(-MOST_LATITUDE), F.least(F.lit(MOST_LATITUDE), lat))
    return F.radians(lon) * F.lit(WEB_EARTH), F.log(F.tan(F.lit(math.pi / 4) + F.radians(held) / 2)) * F.lit(WEB_EARTH)


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile."""
    n = 1 << zoom
    held = F.greatest(F.lit(-MOST_LATITUDE), F.least(F.lit(MOST_LATITUDE), lat))
    x, y = (lon + 180) / 360, (F.lit(1.0) - F.log(F.tan(F.lit(math.pi / 4) + F.radians(held) / 2)) / F.lit(math.pi)) / 2
    place = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v * n))).cast("long")
    return place(x), place(y)


def detail(zoom: Column, overview: Column, low: Column, medium: Column, full: Column) -> Column:
    """The coarsest stored form that a zoom level allows."""
    return F.coalesce(F.when(zoom <= 2, overview), F.when(zoom <= 4, low), F.when(zoom <= 8, medium), full)


def mean_longitude(lon: Column) -> Column:
    """Aggregate: the direction of the sum of unit vectors."""
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(lon))), F.avg(F.cos(F.radians(lon)))))


def parsed_point(text: Column) -> Column:
    """Struct lon, lat of `Point(lon lat)`; null if it isn't one."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    part = lambda k: F.nullif(F.regexp_extract(text, rf"(?i)point\s*\(\s*{number}\s+{number}\s*\)", k), F.lit("")).cast("double")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("lon"), part(2).alias("lat")))


def entity_id(uri: Column) -> Column:
    """What stands after the last slash of an entity's address."""
    return F.substring_index(uri, "/", -1)
