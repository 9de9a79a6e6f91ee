"""Column functions on places: distance, bearing, boxes, bands."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres along the great circle."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees from north, 0 to 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))) + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), F.pmod(F.floor((degrees + 22.5) / 45), F.lit(8)).cast("int") + 1)


def label(km: Column) -> Column:
    """Metres, in tens, below a kilometre; one decimal below ten; whole kilometres beyond."""
    return F.when(km < 1, F.concat((F.round(km * 100) * 10).cast("int").cast("string"), F.lit(" m"))).when(km < 10, F.format_string("%.1f km", km)).otherwise(F.concat(F.round(km).cast("int").cast("string"), F.lit(" km")))


def band(km: Column, edges: tuple[float, ...] = (1, 3, 10)) -> Column:
    """How many of the edges the distance passes."""
    return sum(((km > e).cast("int") for e in edges), F.lit(0))


def box(lat: Column, lon: Column, at: tuple[float, float], km: float) -> Column:
    """Whether a place lies in the box about a circle; the box may cross the antimeridian, and near a pole takes all longitudes."""
    high = km / EARTH_KM * 180 / math.pi
    inside = (lat >= at[0] - high) & (lat <= at[0] + high)
    if abs(at[0]) + high >= 89.9:
        return inside
    wide = math.degrees(math.asin(min(1.0, math.sin(km / EARTH_KM) / math.cos(math.radians(at[0])))))
    west, east = at[1] - wide, at[1] + wide
    if west < -180:
        return inside & ((lon >= west + 360) | (lon <= east))
    if east > 180:
        return inside & ((lon >= west) | (lon <= east - 360))
    return inside & (lon >= west) & (lon <= east)
