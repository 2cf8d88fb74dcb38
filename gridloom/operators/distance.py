"""Distance joins (JON-9..12, 14) by cubes of the unit sphere's space: an equi-join on cubes, then one exact distance.

The side that is multiplied is the smaller one; a cube's cells meet its points in one task, and cubes that hold very many rows
are split by Spark's skew handling, as the join is a plain equi-join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import chord, finite_points, haversine_km, unit_vector
from gridloom.functions.numeric import dominant
from gridloom.session import written

#: Exponents of the cubes' sides in the search for the nearest target: 1/4 of the Earth's radius, then a quarter each time, down to 6 km.
LEVELS = (3, 5, 7, 9, 11)


def _placed(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Rows that have a place, with it on the unit sphere."""
    x, y, z = unit_vector(lon, lat)
    return finite_points(df, lon, lat).withColumns({"__x": x, "__y": y, "__z": z})


def radius_pairs(points: DataFrame, targets: DataFrame, radius_km: float, measure=haversine_km) -> DataFrame:
    """All pairs within the radius with dist_km, anywhere on the Earth. points: p_lon, p_lat; targets: t_lon, t_lat.

    Places are put into cubes of the unit sphere's space, twice as wide as the radius' chord, so that nothing depends on
    180 degrees or the poles; a point goes to the cubes that its ball touches, 3.4 of them on average. Rows without a place
    have no pairs.
    """
    reach = chord(radius_km * (1.0 if measure is haversine_km else 1.01)) * (1 + 1e-9) + 1e-12
    side = 2 * reach
    cube = lambda c, by=0.0: F.floor((F.col(c) + by) / side)
    left = _placed(points, "p_lon", "p_lat")
    for c in ("__x", "__y", "__z"):
        left = left.withColumn(f"{c}c", F.explode(F.sequence(cube(c, -reach), cube(c, reach))))
    right = _placed(targets, "t_lon", "t_lat").withColumns({f"{c}c": cube(c) for c in ("__x", "__y", "__z")}).drop("__x", "__y", "__z")
    both = left.drop("__x", "__y", "__z").join(right, ["__xc", "__yc", "__zc"]).drop("__xc", "__yc", "__zc")
    return both.withColumn("dist_km", measure("p_lon", "p_lat", "t_lon", "t_lat")).filter(F.col("dist_km") <= radius_km)


def nearest(points: DataFrame, targets: DataFrame, measure=haversine_km) -> DataFrame:
    """The distance to each point's nearest target of each layer, however far: __k, __l, dist_km.

    points: __k, p_lon, p_lat; targets: __l, t_lon, t_lat. The targets' cubes form a tree. From its top each point keeps, of the
    cubes of a layer that hold a target, those that may be nearer than some target surely is (a cube's centre tells both
    bounds), and goes on to their parts; only the last cubes' targets are measured. A layer has some 400 cubes at the top, a cube 64 parts
    at most, and a point keeps the few around its nearest ones.
    """
    t = _placed(targets.select("__l", "t_lon", "t_lat").distinct(), "t_lon", "t_lat")
    side = lambda k: 2.0 / (1 << k)
    cube = lambda k: [F.floor((F.col(c) + 1) / side(k)).alias(f"{c}{k}") for c in ("__x", "__y", "__z")]
    slack = 1e-9 if measure is haversine_km else 0.01  # of a distance, between the sphere's and the measure's
    held = _placed(points.select("__k", "p_lon", "p_lat"), "p_lon", "p_lat")
    # the top is one join on the layer; every point meets every layer there
    there = targets.agg(F.collect_set("__l")).first()[0]
    if not there:
        return held.select("__k", F.lit(None).cast(targets.schema["__l"].dataType).alias("__l"), F.lit(None).cast("double").alias("dist_km")).limit(0)
    held = held.withColumn("__l", F.explode(F.array(*(F.lit(x) for x in sorted(there)))))
    above, keys = 0, []
    for k in LEVELS:
        parts = t.select("__l", *(cube(above) if above else []), *cube(k)).distinct()
        held = held.join(parts if above else F.broadcast(parts), ["__l", *keys]).drop(*keys)
        above, keys = k, [f"{c}{k}" for c in ("__x", "__y", "__z")]
        way = F.sqrt(sum((F.pow(F.col(c) - ((F.col(c + str(k)) + 0.5) * side(k) - 1), 2) for c in ("__x", "__y", "__z")), F.lit(0.0)))
        half = side(k) * math.sqrt(3) / 2 * (1 + 1e-9)
        # chords grow with distances, so bounds on the one serve the other
        best = F.min(F.least(way + half, F.lit(2.0))).over(Window.partitionBy("__k", "__l"))
        held = held.withColumns({"__way": way, "__best": best}).filter((F.col("__way") - half) * (1 - slack) <= F.col("__best") * (1 + slack)).drop("__way", "__best")
    last = t.select("__l", "t_lon", "t_lat", *cube(LEVELS[-1]))
    return held.join(last, ["__l", *keys]).groupBy("__k", "__l").agg(F.min(measure("p_lon", "p_lat", "t_lon", "t_lat")).alias("dist_km"))


def radius_kpis(points: DataFrame, cells: DataFrame, radii, key: str = "project_id", households: float = 5.0) -> DataFrame:
    """AGG-7: per point and radius: cells in the disk, people, households, poorest households, cropland, shares (0..1) of
    all cells of the disk (no data counts as 0), road cells at risk. One distance per pair serves all radii.

    cells: x, y, area_km2, pop, crop_frac, poverty, elec, rural, priority, risk.
    """
    p = points.select(F.col(key).alias("__k"), F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
    t = cells.withColumnsRenamed({"x": "t_lon", "y": "t_lat"})
    pairs = radius_pairs(p, t, max(radii)).withColumn("radius_km", F.explode(F.array(*(F.lit(float(r)) for r in radii)))).filter("dist_km <= radius_km")
    share = lambda c: F.sum(F.coalesce((F.col(c) > 0.5).cast("int"), F.lit(0))) / F.count("*")
    out = pairs.groupBy("__k", "radius_km").agg(
        F.count("*").alias("denom_cells"),
        F.coalesce(F.sum("pop"), F.lit(0.0)).alias("pop"),
        F.coalesce(F.sum(F.col("pop") / households), F.lit(0.0)).alias("hh"),
        F.coalesce(F.sum(F.col("pop") / households * F.col("poverty")), F.lit(0.0)).alias("poorest_hh"),
        F.coalesce(F.sum(F.col("crop_frac") * F.col("area_km2")), F.lit(0.0)).alias("ag_km2"),
        share("elec").alias("pct_electrified"),
        share("rural").alias("pct_rural"),
        share("priority").alias("pct_priority"),
        F.sum(F.coalesce((F.col("risk") > 0.5).cast("long"), F.lit(0))).alias("risk_roadcells"),
    )
    return out.withColumnRenamed("__k", key)


def pivot_radii(kpis: DataFrame, radii, key: str = "project_id") -> DataFrame:
    """One row per point with a column per metric and radius."""
    metrics = [c for c in kpis.columns if c not in (key, "radius_km")]
    return kpis.groupBy(key).agg(*(F.max(F.when(F.col("radius_km") == float(r), F.col(m))).alias(f"{m}_{r:g}km") for r in radii for m in metrics))


def _places(points: DataFrame, targets: DataFrame, key: str, layer: str, layers: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points as __k and place, their distinct places, and targets as layer, place and number of copies."""
    p = points.select(F.col(key).alias("__k"), F.col("lon").cast("double").alias("p_lon"), F.col("lat").cast("double").alias("p_lat"))
    t = targets.select(F.col(layer).alias("__l"), F.col("lon").cast("double").alias("t_lon"), F.col("lat").cast("double").alias("t_lat")).filter(F.col("__l").isin(layers)).groupBy("__l", "t_lon", "t_lat").agg(F.count("*").alias("__n"))
    return p, p.select("p_lon", "p_lat").distinct(), t


def _counts(layers: list[str], kms: list[float]) -> dict[str, Column]:
    """The numbers of targets of a place's pairs, by the names of their columns."""
    return {f"count_{la}_le{r:g}km": F.sum(F.when((F.col("__l") == la) & (F.col("dist_km") <= r), F.col("__n"))) for la in layers for r in kms}


def counts_within(points: DataFrame, targets: DataFrame, radii, key: str = "site_id", layer: str = "layer", layers: list[str] = (), distance=haversine_km) -> DataFrame:
    """The counts of nearest_and_counts alone: one join within the largest radius, no search beyond it, nothing written."""
    layers = list(layers) or [r[0] for r in targets.select(layer).distinct().orderBy(layer).collect()]
    p, places, t = _places(points, targets, key, layer, layers)
    kms = [float(r) for r in radii]
    counts = _counts(layers, kms)
    near = radius_pairs(places, t, max(kms), distance).groupBy("p_lon", "p_lat").agg(*(n.alias(c) for c, n in counts.items()))
    return p.join(near, ["p_lon", "p_lat"], "left").fillna(dict.fromkeys(counts, 0)).select(F.col("__k").alias(key), F.col("p_lon").alias("lon"), F.col("p_lat").alias("lat"), *counts)


def nearest_and_counts(points: DataFrame, targets: DataFrame, radii, key: str = "site_id", layer: str = "layer", layers: list[str] = (), distance=haversine_km) -> DataFrame:
    """JON-10: per point and target layer the distance to the nearest target and the numbers within the radii.

    Distances are between distinct places: targets of one layer and place are one row with their number, points of one place
    one row that its points read. One join within the largest radius counts, and finds the nearest target of most places; the
    others, written once, search the tree of cubes. Layers without targets, and points without a place, have null and 0;
    targets without a place count nowhere.
    """
    layers = list(layers) or [r[0] for r in targets.select(layer).distinct().orderBy(layer).collect()]
    p, places, t = _places(points, targets, key, layer, layers)
    kms = [float(r) for r in radii]
    near = radius_pairs(places, t, max(kms), distance)
    names = {la: f"dist_km_nearest_{la}" for la in layers}
    counts = near.groupBy("p_lon", "p_lat").agg(*(n.alias(c) for c, n in _counts(layers, kms).items()), *(F.min(F.when(F.col("__l") == la, F.col("dist_km"))).alias(n) for la, n in names.items()))
    out = written(places.join(counts, ["p_lon", "p_lat"], "left").withColumn("__place", F.monotonically_increasing_id()), "nearest")
    far = out.filter(reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names.values()))).select(F.col("__place").alias("__k"), "p_lon", "p_lat")
    if not far.isEmpty():
        best = nearest(far, t, distance).groupBy(F.col("__k").alias("__place")).agg(*(F.min(F.when(F.col("__l") == la, F.col("dist_km"))).alias(f"__d_{n}") for la, n in names.items()))
        out = out.join(best, "__place", "left").withColumns({n: F.coalesce(n, f"__d_{n}") for n in names.values()})
    out = p.join(out.drop("__place"), ["p_lon", "p_lat"], "left")
    zero = dict.fromkeys(_counts(layers, kms), 0)
    cols = [F.col("__k").alias(key), F.col("p_lon").alias("lon"), F.col("p_lat").alias("lat"), *names.values(), *zero]
    return out.fillna(zero).select(*cols)


def within_nearest(points: DataFrame, clusters: DataFrame, radius_km: float, key: str = "project_id") -> DataFrame:
    """JON-11: each point's nearest cluster centre, its distance and whether it lies within the radius."""
    c = clusters.select(F.lit("cluster").alias("layer"), F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))
    near = nearest_and_counts(points, c, [radius_km], key, layers=["cluster"])
    return near.select(key, "lon", "lat", "dist_km_nearest_cluster", F.coalesce(F.col("dist_km_nearest_cluster") <= radius_km, F.lit(False)).alias("within_radius"))


def sample_points(points: DataFrame, cells: DataFrame, columns: list[str], key: str = "site_id") -> DataFrame:
    """JON-14: layers at the cells of points (row, col); outside the grid: nulls."""
    return points.join(cells.select("row", "col", *columns), ["row", "col"], "left").select(key, "row", "col", *columns)


def by_position(table: DataFrame, names: DataFrame, order: str, index: str) -> DataFrame:
    """JON-15: attributes of the n-th row of `names` (file order) for index n, from 1."""
    numbered = names.withColumn("__n", F.row_number().over(Window.orderBy(order))).drop(order)
    return table.join(numbered, F.col(index) == F.col("__n"), "left").drop("__n")


def dominant_financier(counts: DataFrame, parts: dict[str, str]) -> DataFrame:
    """PRJ-28 over count columns."""
    return counts.withColumn("dominant", dominant({k: F.col(c) for k, c in parts.items()}))
