"""Reference systems (GEO-3) as column expressions: degrees of WGS84, Web Mercator, UTM zones."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import WGS84_A, WGS84_F
from gridloom.functions.numeric import col

DEGREES = ("EPSG:4326", "OGC:CRS84")
WEB_MERCATOR = "EPSG:3857"
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500000.0, 10000000.0

# Transverse Mercator by series in the third flattening N, to its fourth power (under a millimetre within a zone).
# Published coefficients of N, N^2, N^3, N^4 for the terms 1 to 4.
N = WGS84_F / (2 - WGS84_F)
FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
BACKWARD = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
LATITUDE = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))
RADIUS = UTM_SCALE * WGS84_A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)


def _series(table: tuple, term: Callable[[int], Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(sum(c * N ** (k + 1) for k, c in enumerate(row))) * term(2 * (j + 1)) for j, row in enumerate(table)))


def utm_zone(crs: str) -> tuple[int, bool] | None:
    """Zone and whether it is southern, of EPSG:326zz and EPSG:327zz."""
    code = crs.upper().removeprefix("EPSG:")
    if len(code) == 5 and code.isdigit() and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60:
        return int(code[3:]), code[:3] == "327"
    return None


def to_utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """East and north in metres."""
    e = 2 * math.sqrt(N) / (1 + N)
    s, d = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    up, side = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
    east = side + _series(FORWARD, lambda k: F.cos(k * up) * F.sinh(k * side))
    north = up + _series(FORWARD, lambda k: F.sin(k * up) * F.cosh(k * side))
    return UTM_EAST + RADIUS * east, (UTM_SOUTH if south else 0.0) + RADIUS * north


def from_utm(east: Column, north: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    up, side = (north - (UTM_SOUTH if south else 0.0)) / RADIUS, (east - UTM_EAST) / RADIUS
    a = up - _series(BACKWARD, lambda k: F.sin(k * up) * F.cosh(k * side))
    b = side - _series(BACKWARD, lambda k: F.cos(k * up) * F.sinh(k * side))
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi + _series(LATITUDE, lambda k: F.sin(k * chi))
    return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + (6 * zone - 183), F.degrees(lat)


def _to_degrees(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    if crs.upper() in DEGREES:
        return x, y
    if crs.upper() == WEB_MERCATOR:
        return F.degrees(x / WGS84_A), F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2)
    if zone := utm_zone(crs):
        return from_utm(x, y, *zone)
    raise ValueError(f"unknown reference system {crs}")


def _from_degrees(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    if crs.upper() in DEGREES:
        return lon, lat
    if crs.upper() == WEB_MERCATOR:
        return F.radians(lon) * WGS84_A, F.asinh(F.tan(F.radians(lat))) * WGS84_A
    if zone := utm_zone(crs):
        return to_utm(lon, lat, *zone)
    raise ValueError(f"unknown reference system {crs}")


def transform_xy(x, y, source: str | None, target: str = "EPSG:4326") -> tuple[Column, Column]:
    """GEO-3: x and y of `source` in `target`; a missing source is taken for the target. Nulls stay null."""
    x, y = col(x), col(y)
    if not source or source.upper() == target.upper():
        return x, y
    return _from_degrees(*_to_degrees(x, y, source), target)


def reproject(features: DataFrame, source: str | None, target: str = "EPSG:4326", parts: str = "parts") -> DataFrame:
    """GEO-3 over a feature table: all vertices of all parts."""

    def moved(v: Column) -> Column:
        x, y = transform_xy(v["x"], v["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return features.withColumn(parts, F.transform(parts, lambda ring: F.transform(ring, moved)))
