"""Geometry scalars: distances, places in the grid, cell areas, centroids, inner points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import col

EARTH_KM = 6371.0088
#: WGS84: half axis in metres and flattening.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """GEO-6: great-circle distance; the root is held to 1. Null where a coordinate is missing or no number."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    f1, f2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((f2 - f1) / 2), 2) + F.cos(f1) * F.cos(f2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    # least() would take 1 for a null, and 1 is below NaN
    return F.when(a.isNotNull() & ~F.isnan(a), F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def unit_vector(lon, lat) -> tuple[Column, Column, Column]:
    """A place on the sphere of radius 1: no seam at 180 degrees, none at the poles."""
    lon, lat = F.radians(col(lon)), F.radians(col(lat))
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def chord(km: float) -> float:
    """The straight way through the sphere of radius 1 between places `km` apart on the Earth."""
    return 2 * math.sin(min(km / (2 * EARTH_KM), math.pi / 2))


def antipodal_km(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Inverse geodesic by the azimuth at the place further from the equator, for pairs that the fixed-point iteration doesn't settle.

    With that place in the south and the other one no further north, the longitude that a geodesic gains until it meets the
    other latitude on its way north grows with its azimuth, so bisection finds the azimuth for any pair. Longitude and length
    are integrals along the auxiliary sphere of smooth functions, taken by Gauss-Legendre quadrature.
    """
    f, b = WGS84_F, WGS84_A * (1 - WGS84_F)
    swap = np.abs(lat1) < np.abs(lat2)
    south, north = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    turn = np.where(south > 0, -1.0, 1.0)
    b1, b2 = (np.arctan((1 - f) * np.tan(np.radians(x * turn))) for x in (south, north))
    b1 = np.minimum(b1, -1e-200)  # on the equator the way starts just south of it
    goal = np.radians(np.abs((lon2 - lon1 + 180) % 360 - 180))
    node, weight = np.polynomial.legendre.leggauss(32)
    e2 = f * (2 - f) / (1 - f) ** 2

    def way(azimuth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sa, ca = np.sin(azimuth), np.cos(azimuth)
        s0 = sa * np.cos(b1)
        c0 = np.hypot(ca, sa * np.sin(b1))
        c2 = np.sqrt(np.maximum((ca * np.cos(b1)) ** 2 + np.cos(b2) ** 2 - np.cos(b1) ** 2, 0)) / np.cos(b2)
        s1, w1 = np.arctan2(np.sin(b1), ca * np.cos(b1)), np.arctan2(s0 * np.sin(b1), ca * np.cos(b1))
        s2, w2 = np.arctan2(np.sin(b2), c2 * np.cos(b2)), np.arctan2(s0 * np.sin(b2), c2 * np.cos(b2))
        half, middle = (s2 - s1) / 2, (s2 + s1) / 2
        root = np.sqrt(1 + e2 * c0[:, None] ** 2 * np.sin(middle[:, None] + half[:, None] * node) ** 2)
        gained = w2 - w1 - f * s0 * half * (((2 - f) / (1 + (1 - f) * root)) @ weight)
        return gained, b * half * (root @ weight)

    lo, hi = np.zeros(len(goal)), np.full(len(goal), np.pi)
    for _ in range(60):
        middle = (lo + hi) / 2
        short = way(middle)[0] < goal
        lo, hi = np.where(short, middle, lo), np.where(short, hi, middle)
    return way((lo + hi) / 2)[1] / 1000


def inverse_km(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Inverse geodesic for all pairs; NaN only where a coordinate is."""
    out = vincenty_km(lon1, lat1, lon2, lat2)
    left = np.flatnonzero(np.isnan(out) & np.isfinite(lon1) & np.isfinite(lat1) & np.isfinite(lon2) & np.isfinite(lat2))
    if len(left):
        out[left] = antipodal_km(*(x[left] for x in (lon1, lat1, lon2, lat2)))
    return out


def vincenty_km(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Inverse geodesic on the ellipsoid by fixed-point iteration; NaN where it doesn't settle (near antipodes)."""
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = (np.arctan((1 - WGS84_F) * np.tan(np.radians(x))) for x in (lat1, lat2))
    d = np.radians((lon2 - lon1 + 180) % 360 - 180)
    lam = d.copy()
    settled = np.zeros(len(d), bool)
    with np.errstate(all="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl)
            cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, np.cos(u1) * np.cos(u2) * sl / np.where(ss == 0, 1, ss))
            c2 = 1 - sa**2
            cm = np.where(c2 == 0, 0.0, cs - 2 * np.sin(u1) * np.sin(u2) / np.where(c2 == 0, 1, c2))
            c = WGS84_F / 16 * c2 * (4 + WGS84_F * (4 - 3 * c2))
            new = d + (1 - c) * WGS84_F * sa * (sigma + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        u = c2 * (WGS84_A**2 - b**2) / b**2
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        delta = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        # beyond half a turn the iteration has left the shortest way
        return np.where((settled & (np.abs(lam) <= np.pi)) | ((ss == 0) & (cs > 0)), b * big * (sigma - delta) / 1000, np.nan)


def geodesic_km(lon1, lat1, lon2, lat2) -> Column:
    """GEO-7: WGS84 geodesic distance of any two places, batch-wise over Arrow; null where a coordinate is missing or no number."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, c, d in batches:
            out = inverse_km(*(x.to_numpy(dtype=float) for x in (a, b, c, d)))
            yield pd.Series([None if math.isnan(v) else v for v in out], dtype="float64")

    return F.when(col(lon1).isNotNull() & col(lat1).isNotNull() & col(lon2).isNotNull() & col(lat2).isNotNull(), run(*map(col, (lon1, lat1, lon2, lat2))))


def row_col(lon, lat, spec) -> tuple[Column, Column]:
    """GEO-8: the cell of a point; null outside the grid."""
    c = F.floor((col(lon) - spec.x0) / spec.dx).cast("int")
    r = F.floor((F.lit(spec.y0) - col(lat)) / abs(spec.dy)).cast("int")
    inside = (c >= 0) & (c < spec.width) & (r >= 0) & (r < spec.height)
    return F.when(inside, r), F.when(inside, c)


def cell_area_latlon(lat, dx: float, dy: float) -> Column:
    """GRD-7: square kilometres of a cell in degrees."""
    return F.lit(111.32 * abs(dx) * 111.32 * abs(dy)) * F.cos(F.radians(col(lat)))


def cell_area(lat, spec, model: str = "latlon") -> Column:
    """GRD-8, GRD-9: `latlon` as above for degrees; `constant` is 1 for degrees; metres give dx * dy / 1e6 in both."""
    geographic = spec.crs.upper() in ("EPSG:4326", "OGC:CRS84")
    if not geographic and abs(spec.dx) >= 0.01:
        return F.lit(abs(spec.dx * spec.dy) / 1e6)
    return F.lit(1.0) if model == "constant" else cell_area_latlon(lat, spec.dx, spec.dy)


def finite_points(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """GEO-4: rows whose coordinates are finite numbers."""
    ok = F.lit(True)
    for c in (lon, lat):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < 1e30)
    return df.filter(ok)


def with_geometry(df: DataFrame, parts: str = "parts") -> DataFrame:
    """GEO-5: features that have at least one vertex."""
    return df.filter(F.col(parts).isNotNull() & F.exists(parts, lambda p: F.size(p) > 0))


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring, closed if it isn't."""
    closed = F.when(F.element_at(ring, 1) != F.element_at(ring, -1), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)
    return F.when(F.size(ring) > 1, F.zip_with(F.slice(closed, 1, F.size(closed) - 1), F.slice(closed, 2, F.size(closed) - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def polygon_centroid(parts: str = "parts") -> tuple[Column, Column]:
    """GEO-1: area-weighted centroid over all rings (holes wind the other way); vertex mean where the area is 0."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        k = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct((s["a"] + k).alias("a"), (s["x"] + (e["x1"] + e["x2"]) * k).alias("x"), (s["y"] + (e["y1"] + e["y2"]) * k).alias("y"))

    s = F.aggregate(F.flatten(F.transform(parts, ring_edges)), zero, add)
    vertices = F.flatten(F.col(parts))
    mean = lambda k: F.aggregate(vertices, F.lit(0.0), lambda acc, v: acc + v[k]) / F.size(vertices)
    return tuple(F.when(F.abs(s["a"]) > 1e-15, s[k] / (3 * s["a"])).otherwise(mean(k)) for k in ("x", "y"))


def inner_point(parts: list[list[tuple[float, float]]], kind: str) -> tuple[float, float] | None:
    """GEO-2: a point inside: the middle of the widest span at half height (polygons), the middle vertex's place (lines)."""
    rings = [[(float(x), float(y)) for x, y in r] for r in parts if len(r)]
    if not rings:
        return None
    if kind == "point":
        return rings[0][0]
    if kind == "line":
        line = max(rings, key=len)
        lengths = [math.dist(a, b) for a, b in zip(line, line[1:], strict=False)]
        half = sum(lengths) / 2
        for (a, b), n in zip(zip(line, line[1:], strict=False), lengths, strict=True):
            if n >= half and n > 0:
                t = half / n
                return a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
            half -= n
        return line[0]
    ys = sorted({y for r in rings for _, y in r})
    if len(ys) < 2:
        return rings[0][0]
    middle = (ys[0] + ys[-1]) / 2
    below, above = max(y for y in ys if y <= middle), min((y for y in ys if y > middle), default=ys[-1])
    level = (below + above) / 2
    cross = sorted(a[0] + (level - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True) if (a[1] <= level) != (b[1] <= level))
    spans = list(zip(cross[::2], cross[1::2], strict=False))
    if not spans:
        return rings[0][0]
    a, b = max(spans, key=lambda s: s[1] - s[0])
    return (a + b) / 2, level


def representative_points(features: DataFrame) -> DataFrame:
    """GEO-2 over a features table: lon and lat are added; features of no vertex give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [inner_point([[(v["x"], v["y"]) for v in r] for r in p or []], k) for k, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), *(pa.array([a[i] if a else None for a in at], pa.float64()) for i in (0, 1))], names=["feature_id", "lon", "lat"])

    points = features.select(F.col("feature_id").cast("long").alias("feature_id"), "kind", "parts").mapInArrow(run, "feature_id long, lon double, lat double")
    return features.join(points, "feature_id")
