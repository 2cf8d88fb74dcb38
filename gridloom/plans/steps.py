"""The reference workload's steps (Q00-Q14) as functions from tables to tables; each is one lazy plan but for its scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import geodesic_km, haversine_km, row_col
from gridloom.functions.numeric import flag, np_round, safe_div
from gridloom.operators import cluster, cost, distance, focal, grid, od, raster, scenario, score, select, tabular, zonal
from gridloom.operators.grid import GridSpec
from gridloom.params import SCENARIOS, Params, sanitize_radii
from gridloom.session import written


def build_base(spark, spec: GridSpec, layers: dict[str, tuple[DataFrame, GridSpec, str]], polygons: dict[str, DataFrame], zones: DataFrame, code: str = "adm2", p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Q00: (cells, zones). layers: name -> (row, col, value; its grid; resampling); polygons: cropland, elec, urban, aoi."""
    cells = grid.template_cells(spark, spec)
    stacked = {name: grid.align(df, s, cells, spec, how) for name, (df, s, how) in layers.items() if name != "flood"}
    if "flood" in layers:
        df, s, _ = layers["flood"]
        stacked["flood_max"] = grid.align(df, s, cells, spec, "max")
        # no data is not above the depth, so it counts as 0 in the share
        wet = df.select("row", "col", flag(F.col("value") >= p.flood_depth_m).cast("double").alias("value"))
        stacked["flood_frac"] = grid.align(wet, s, cells, spec, "average")
    out = grid.stack_layers(cells, stacked)
    empty = {"crop_frac": 0.0, "elec": 0.0, "urban": 0.0}
    if "cropland" in polygons:
        out = out.join(raster.coverage_fraction(polygons["cropland"], spec).withColumnRenamed("value", "crop_frac"), ["row", "col"], "left")
    if "elec" in polygons:
        out = out.join(raster.burn(polygons["elec"], spec, F.col("value") == 1).withColumnRenamed("value", "elec"), ["row", "col"], "left")
    if "urban" in polygons:
        out = out.join(raster.burn(polygons["urban"], spec, F.col("value") == 2).select("row", "col", F.lit(1.0).alias("urban")), ["row", "col"], "left")
        rural = raster.burn(polygons["urban"], spec, F.col("value") == 0).select("row", "col", F.lit(1.0).alias("rural"))
        out = out.join(rural, ["row", "col"], "left").fillna(0.0, ["rural"])
    out = out.fillna({k: v for k, v in empty.items() if k in out.columns})
    labelled = raster.zone_labels(zones, code)
    out = out.join(raster.burn_zones(zones, spec, code), ["row", "col"], "left")
    if "aoi" in polygons:
        out = raster.aoi_mask(out, polygons["aoi"], spec)
        out = grid.apply_mask(out, [c for c in out.columns if c not in ("aoi", "row", "col", "x", "y", "area_km2", "in_aoi", "zone_id")], p.mask_policy, p.min_aoi_overlap)
    return out, labelled


def isochrone_masks(cells: DataFrame, p: Params = Params()) -> DataFrame:
    """Q01: cells by threshold; null travel stays null."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in p.iso_thresholds)))
    return cells.select("row", "col", "travel_min", t.alias("thresh_min")).withColumn("mask", (F.col("travel_min") <= F.col("thresh_min")).cast("int"))


def isochrone_kpis(cells: DataFrame, p: Params = Params()) -> DataFrame:
    """Q02: constant cell area, as the published table has it."""
    return zonal.isochrone_kpis(cells, p.iso_thresholds, 1.0)


def flood_bottlenecks(cells: DataFrame, p: Params = Params()) -> DataFrame:
    """Q04: cells with `near` (3 x 3 around priority cells), summed up; the depth decides where there is no exceedance share."""
    near = focal.focal_max(cells, "selected", 1, "near")
    has_fraction = "flood_frac" in cells.columns and cells.filter(F.col("flood_frac").isNotNull()).limit(1).count() > 0
    return zonal.flood_summary(near if "flood_frac" in near.columns else near.withColumn("flood_frac", F.lit(None).cast("double")), p.flood_depth_m, p.flood_exceed_fraction, has_fraction)


def site_audit(points: DataFrame, cells: DataFrame, spec: GridSpec, p: Params = Params()) -> DataFrame:
    """Q05: layers at sites, and cropland and electricity in the disk around them (constant cell area)."""
    r, c = row_col("lon", "lat", spec)
    at = points.withColumns({"row": r, "col": c}).filter("row is not null and col is not null")
    layers = cells.select("row", "col", "travel_min", "veg", "ntl", "drought", flag(F.col("road") > 0.5).alias("near_road_flag"))
    around = cells.select("row", "col", flag(F.col("crop_frac") > 0).alias("crop_cells"), F.coalesce("crop_frac", F.lit(0.0)).alias("crop_km2"), flag(F.col("elec") > 0.5).alias("elec_cells"), F.lit(1).alias("cells"))
    disk = focal.disk_sums(at, around, ["crop_cells", "crop_km2", "elec_cells", "cells"], p.audit_radius_cells)
    out = at.select("site_id", "lon", "lat", "row", "col").join(layers, ["row", "col"], "left").join(disk, "site_id")
    return out.select("site_id", "lon", "lat", "row", "col", "travel_min", F.col("veg").alias("veg_index"), "ntl", F.col("drought").alias("drought_pct"), F.col("crop_cells").alias("cropland_cells_5km"), F.col("crop_km2").alias("cropland_km2_5km"), F.col("elec_cells").alias("electrified_cells_5km"), safe_div(F.col("elec_cells").cast("double"), "cells").alias("electrified_share_5km"), "near_road_flag")


def muni_ingest(themes: dict[str, DataFrame], target: str, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q06: (wide indicators, correlations with the target, profiles)."""
    long = tabular.mean_of_duplicates(tabular.ingest_themes(themes, skip))
    wide = written(tabular.drop_empty_columns(tabular.wide_table(long)), "indicators")
    poverty = [c for c in wide.columns if c.startswith("poverty__")]
    return wide, tabular.correlations(wide, target), tabular.profiles(wide, [*poverty, *(c for c in wide.columns if c.startswith("traveltime__"))], target)


def priority(cells: DataFrame, p: Params = Params(), zones: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Q07: (cells with score and mask, zone ranking)."""
    masked = written(score.priority_mask(cells, p), "priority")
    return masked, zonal.rank_pack(masked, zones=zones)


def project_kpis(projects: DataFrame, cells: DataFrame, p: Params = Params(), reference: tuple[str, float, float] | None = None) -> DataFrame:
    """Q08: one row per project with all metrics at all radii, and the distance to a reference point."""
    radii = sanitize_radii(p.radii_km)
    wide = distance.pivot_radii(distance.radius_kpis(projects, cells, radii, households=p.people_per_household), radii)
    out = projects.join(wide, "project_id", "left")
    if reference:
        name, lon, lat = reference
        out = out.withColumn(f"dist_km_to_{name}", haversine_km(F.lit(lon), F.lit(lat), "lon", "lat"))
    return out


#: Parts of the shortlist's score: True where less is more urgent.
SHORTLIST = {"poverty_rural": False, "food_insec_scale": False, "avg_minutes_to_market_financial": False, "pct_priority": False, "cropland_km2": False, "pct_electrified": True, "rwi_mean": True}


def muni_shortlist(cells: DataFrame, indicators: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Q09: zone statistics, indicators, rural people, composite score, best first."""
    pack = zonal.municipality_pack(cells, zone)
    table = tabular.left_on_text(pack, indicators, [zone])
    table = table.withColumn("rural_pop_est", F.col("pop_total") * F.col("pct_rural"))
    return select.composite(table, SHORTLIST).orderBy(F.desc("score"), zone)


def scenario_sweep(cells: DataFrame, p: Params = Params(), scenarios=SCENARIOS) -> DataFrame:
    """Q10."""
    return scenario.sweep(cells, p, scenarios)


def priority_clusters(masked: DataFrame, p: Params = Params(), policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Q11: (cells with cluster_id, cluster table): 8 neighbours, pruned by cells and area, largest first."""
    chosen = masked.filter("selected = 1")
    ids = cluster.connected_components(chosen, p.cluster_connectivity)
    keys = [k for k in ("aoi", "row", "col") if k in masked.columns]
    cells = written(cluster.prune(chosen.join(ids, keys), p.min_cluster_cells, p.min_cluster_km2), "clusters")
    median = select.percentile_of(masked, "drought", 0.5)  # of the whole grid
    return cells, cluster.order_clusters(zonal.cluster_pack(cells, thresholds=p.iso_thresholds, policy=policy, drought_median=median if median is not None else 0.0))


def catchments(sites: DataFrame, cells: DataFrame, roads: DataFrame, spec: GridSpec, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Q12: (minutes from each site, catchment table)."""
    r, c = row_col("lon", "lat", spec)
    at = sites.withColumns({"row": r, "col": c})
    surface = written(cost.travel_minutes(at, cost.friction_surface(cells, roads, spec, p), spec, max(p.iso_thresholds) + p.extra_cost_min), "minutes")
    return surface, cost.catchment_kpis(surface, cells, p.iso_thresholds)


def synergies(points: DataFrame, projects: DataFrame, layers: list[str], p: Params = Params(), key: str = "site_id", measure=geodesic_km) -> DataFrame:
    """Q13: nearest projects and counts within radii, by the geodesic; distances with one decimal."""
    radii = sanitize_radii(p.radii_km)
    out = distance.nearest_and_counts(points, projects, radii, key, layers=layers, distance=measure)
    return out.withColumns({f"dist_km_nearest_{la}": np_round(f"dist_km_nearest_{la}", 1) for la in layers})


def od_model(zones: DataFrame, p: Params = Params(), code: str = "code") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q14: (flows, zone attributes, agents)."""
    massed = od.with_mass(zones, p) if "mass" not in zones.columns else zones
    flows = od.gravity(massed, p, code)
    return flows, od.zone_attributes(massed, code), od.agents_exact(flows, massed, p, code)
