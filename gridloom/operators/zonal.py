"""Aggregations over zones, clusters and thresholds (AGG): one pass each, conditional sums instead of chains of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.numeric import flag, np_round, percent_guard, safe_div
from gridloom.operators.ordered import quantiles, scalar_quantiles


def poison(aggregate: Column, value: Column | str) -> Column:
    """A policy for sums and means: null if any value of the group is."""
    return F.when(F.count(value) == F.count("*"), aggregate)


def _agg(how: str, value: str, policy: str) -> Column:
    out = {"sum": F.sum, "mean": F.avg}[how](value)
    return poison(out, value) if policy == "poison" else out


def masked_sum(cells: DataFrame, value: str, mask: str) -> DataFrame:
    """AGG-1: one row with the sum where the mask is 1; 0 if nothing is."""
    return cells.agg(F.coalesce(F.sum(F.when(F.col(mask) == 1, F.col(value))), F.lit(0.0)).alias("total"))


def zonal(cells: DataFrame, value: str, how: str = "mean", zone: str = "zone_id", policy: str = "skip") -> DataFrame:
    """AGG-2, AGG-3: sum or mean by zone over cells that have a value and a zone above 0."""
    if how not in ("sum", "mean"):
        raise ValueError(f"unknown aggregate {how!r}")
    rows = cells.filter(F.col(zone) > 0)
    rows = rows if policy == "poison" else rows.filter(F.col(value).isNotNull())
    return rows.groupBy(zone).agg(_agg(how, value, policy).alias(value))


def isochrone_kpis(cells: DataFrame, thresholds, area_km2: Column | float = 1.0) -> DataFrame:
    """AGG-4: per threshold people, cells, area, cropland, electrified cells and their shares of the totals.

    cells: travel_min, pop, crop_frac, elec. One scan: each cell is multiplied by the thresholds and summed at once.
    """
    area = area_km2 if isinstance(area_km2, Column) else F.lit(float(area_km2))
    base = cells.select("travel_min", "pop", (F.col("crop_frac") * area).alias("crop"), flag(F.col("elec") > 0.5).alias("elec"), area.alias("area"))
    t = base.withColumn("travel_cut_min", F.explode(F.array(*(F.lit(float(x)) for x in thresholds)))).withColumn("inside", F.coalesce(F.col("travel_min") <= F.col("travel_cut_min"), F.lit(False)))
    within = lambda c: F.coalesce(F.sum(F.when(F.col("inside"), F.col(c))), F.lit(0)).alias
    g = t.groupBy("travel_cut_min").agg(within("pop")("pop_within"), F.count_if("inside").alias("cells_within"), within("area")("area_km2_within"), within("crop")("cropland_km2"), within("elec")("electrified_cells"), F.coalesce(F.sum("pop"), F.lit(0.0)).alias("pop_total"), F.coalesce(F.sum("crop"), F.lit(0.0)).alias("cropland_total_km2"), F.sum("elec").alias("electrified_total_cells"))
    share = lambda a, b: percent_guard(safe_div(100 * F.col(a), b))
    return g.select("travel_cut_min", "pop_within", "cells_within", "area_km2_within", share("pop_within", "pop_total").alias("pop_pct"), "cropland_km2", share("cropland_km2", "cropland_total_km2").alias("cropland_pct"), "electrified_cells", share("electrified_cells", "electrified_total_cells").alias("electrified_pct"), "pop_total", "cropland_total_km2", "electrified_total_cells", (F.col("electrified_total_cells") == 0).alias("note_electrification_denominator_zero"))


def rank_pack(cells: DataFrame, score: str = "score", mask: str = "selected", zone: str = "zone_id", zones: DataFrame | None = None, legacy_max_label: bool = False) -> DataFrame:
    """AGG-5, WIN-4: per zone mean score, selected and all cells and areas, share selected, and the rank.

    With `zones` every zone has a row; legacy_max_label leaves out zones beyond the largest one that has a score.
    """
    rows = cells.filter((F.col(zone) > 0) & F.col(score).isNotNull())
    chosen = F.col(mask) == 1
    g = rows.groupBy(zone).agg(F.avg(score).alias("score"), F.count_if(chosen).alias("selected_cells"), F.coalesce(F.sum(F.when(chosen, F.col("area_km2"))), F.lit(0.0)).alias("selected_km2"), F.count("*").alias("total_cells"), F.sum("area_km2").alias("total_km2"))
    if zones is not None:
        g = zones.select(zone).join(g, zone, "left").fillna(0, ["selected_cells", "selected_km2", "total_cells", "total_km2"])
        if legacy_max_label:
            top = Window.partitionBy()
            g = g.withColumn("__top", F.max(F.when(F.col("score").isNotNull(), F.col(zone))).over(top)).filter(F.col(zone) <= F.col("__top")).drop("__top")
    g = g.withColumns({"share_selected": F.coalesce(safe_div("selected_cells", "total_cells"), F.lit(0.0)), "selected": F.col("selected_cells") > 0})
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), zone)))


def municipality_pack(cells: DataFrame, zone: str = "zone_id") -> DataFrame:
    """AGG-6, JON-4: per zone area, people in all and by travel time, cropland, shares (0..1) over all cells, mean rwi: one groupBy."""
    mean01 = lambda c: F.avg(flag(F.col(c) > 0.5))
    near = lambda t: F.coalesce(F.sum(F.when(F.col("travel_min") <= t, F.col("pop"))), F.lit(0.0))
    return cells.filter(F.col(zone) > 0).groupBy(zone).agg(
        F.sum("area_km2").alias("area_km2"),
        F.coalesce(F.sum("pop"), F.lit(0.0)).alias("pop_total"),
        near(60).alias("pop_le60min"),
        near(120).alias("pop_le120min"),
        F.coalesce(F.sum(F.when(F.col("travel_min") > 120, F.col("pop"))), F.lit(0.0)).alias("pop_gt120min"),
        F.coalesce(F.sum(F.col("crop_frac") * F.col("area_km2")), F.lit(0.0)).alias("cropland_km2"),
        mean01("elec").alias("pct_electrified"),
        mean01("rural").alias("pct_rural"),
        mean01("selected").alias("pct_priority"),
        F.avg("rwi").alias("rwi_mean"),
    )


def mode_label(rows: DataFrame, group: str, label: str) -> DataFrame:
    """AGG-9: the most frequent label of each group, the smallest of equals: counts first, so no group meets in one task."""
    n = rows.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.min(F.struct(-F.col("n"), F.col(label).alias("v")))["v"].alias(label))


def cluster_pack(cells: DataFrame, cluster: str = "cluster_id", thresholds=(30, 60, 120, 240), policy: str = "skip", drought_median: float | None = None) -> DataFrame:
    """AGG-8, AGG-32: per cluster the sums, shares, means, centre and main zone; policy `poison`: a missing cell voids a value.

    Drought is percent if its median over the whole grid is above 1; without that median the cells given stand for the grid.
    """
    if drought_median is None:
        drought_median = scalar_quantiles(cells, {"m": ("drought", 0.5)})["m"]
    rows = cells.filter(F.col(cluster).isNotNull()).withColumn("drought", F.col("drought") / (100.0 if (drought_median or 0) > 1 else 1.0))
    rows = rows.withColumn("__crop", F.col("crop_frac") * F.col("area_km2"))
    pct = lambda c: F.avg(flag(F.col(c) > 0.5))
    shares = [F.avg(flag(F.col("travel_min") <= t)).alias(f"share_le_{t:g}m") for t in thresholds]
    out = rows.groupBy(cluster).agg(F.sum("area_km2").alias("area_km2"), _agg("sum", "pop", policy).alias("pop"), _agg("sum", "__crop", policy).alias("cropland_km2"), pct("elec").alias("pct_electrified"), pct("rural").alias("pct_rural"), _agg("mean", "travel_min", policy).alias("mean_travel_min"), _agg("mean", "drought", policy).alias("drought_mean_0_1"), F.sum(flag(F.col("risk") > 0.5)).alias("risk_roadcells"), _agg("mean", "flood_max", policy).alias("flood_depth_mean_m"), _agg("mean", "rwi", policy).alias("rwi_mean"), F.avg("x").alias("centroid_lon"), F.avg("y").alias("centroid_lat"), *shares)
    return out.join(mode_label(rows.filter(F.col("zone_id") > 0), cluster, "zone_id"), cluster, "left")


def flood_summary(cells: DataFrame, depth_m: float = 0.3, fraction_min: float = 0.25, use_fraction: bool = True) -> DataFrame:
    """AGG-19, FLT-10: one row on road cells, those under water, and those near priority cells (near: 0/1)."""
    wet = flag(F.col("flood_frac") >= fraction_min) if use_fraction else flag(F.col("flood_max") >= depth_m)
    rows = cells.select(flag(F.col("road") > 0.5).alias("road"), wet.alias("wet"), flag(F.col("near") > 0.5).alias("near"))
    risk = F.col("road") * F.col("wet")
    g = rows.agg(F.sum("road").alias("total_road_cells"), F.sum(risk).alias("total_risk_cells"), F.sum(risk * F.col("near")).alias("risk_near_priority_cells"))
    pct = lambda a, b: np_round(F.coalesce(safe_div(100.0 * F.col(a), b), F.lit(0.0)), 2)
    return g.select("*", pct("total_risk_cells", "total_road_cells").alias("risk_pct_of_roads"), pct("risk_near_priority_cells", "total_risk_cells").alias("near_prio_pct_of_risk"), F.lit(depth_m).alias("flood_depth_threshold_m"), F.lit(fraction_min).alias("flood_exceed_fraction_min"))


def overlap(a: Column, b: Column) -> dict[str, Column]:
    """AGG-18 as aggregates: share of a's cells in b, and Jaccard; null where there are none."""
    both, either, first = F.count_if(a & b).cast("double"), F.count_if(a | b), F.count_if(a)
    return {"overlap_pct_vs_baseline": safe_div(both, first), "jaccard_vs_baseline": safe_div(both, either)}


def weighted_mean(value: str, weight: str) -> Column:
    """AGG-10, AGG-28: null if the weights sum to 0; missing weights count as 0."""
    w = F.when(F.col(value).isNotNull(), F.coalesce(F.col(weight), F.lit(0.0)))
    return F.when(F.sum(w) > 0, F.sum(F.col(value) * w) / F.when(F.sum(w) > 0, F.sum(w)))


def weighted_medians(rows: DataFrame, value: str, weight: str, keys: tuple[str, ...] = (), out: str = "median") -> DataFrame:
    """AGG-28: per group the median of values repeated by the whole part of their weights; groups without weight have no row."""
    return quantiles(rows, {out: (value, 0.5)}, keys, weight)


def collapse_pairs(flows: DataFrame, order: str | None = None) -> DataFrame:
    """AGG-20: undirected pairs: flows summed, distances averaged, names as the first row of each pair has them."""
    seq = F.col(order) if order else F.struct("oi", "dj")
    g = flows.filter(F.col("oi") != F.col("dj")).groupBy(F.least("oi", "dj").alias("a"), F.greatest("oi", "dj").alias("b"))
    return g.agg(F.sum("flow").alias("flow"), F.avg("dist_km").alias("dist_km"), F.min_by("oi", seq).alias("oi"), F.min_by("dj", seq).alias("dj")).drop("a", "b")


def throughput(flows: DataFrame) -> DataFrame:
    """AGG-21: out, in and total flow of every node; a side that has none is 0."""
    out = flows.select(F.col("oi").alias("node"), F.col("flow").alias("out_flow"), F.lit(0.0).alias("in_flow"))
    into = flows.select(F.col("dj").alias("node"), F.lit(0.0).alias("out_flow"), F.col("flow").alias("in_flow"))
    g = out.unionByName(into).groupBy("node").agg(F.sum("out_flow").alias("out_flow"), F.sum("in_flow").alias("in_flow"))
    return g.withColumn("throughput", F.col("out_flow") + F.col("in_flow"))


def asymmetry(flows: DataFrame) -> DataFrame:
    """AGG-29: mean of |F - F transposed| over all ordered pairs that stand in the table."""
    back = flows.select(F.col("dj").alias("oi"), F.col("oi").alias("dj"), F.col("flow").alias("back"))
    return flows.join(back, ["oi", "dj"], "full").agg(F.avg(F.abs(F.coalesce("flow", F.lit(0.0)) - F.coalesce("back", F.lit(0.0)))).alias("mean_asymmetry"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """AGG-30."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def threshold_pivot(kpis: DataFrame, thresholds, key: str = "site_id", value: str = "pop") -> DataFrame:
    """AGG-24: per site the value at each threshold (0 if missing) and the gain over the threshold before."""
    names = [f"{t:g}" for t in thresholds]
    wide = kpis.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("thresh_min") == float(t), F.col(value))), F.lit(0.0)).alias(f"{value}_{n}") for t, n in zip(thresholds, names, strict=True)))
    return wide.select("*", *((F.col(f"{value}_{b}") - F.col(f"{value}_{a}")).alias(f"gain_{a}_{b}") for a, b in zip(names, names[1:], strict=False)))


def centroids(cells: DataFrame, label: str = "cluster_id") -> DataFrame:
    """AGG-32."""
    return cells.filter(F.col(label).isNotNull()).groupBy(label).agg(F.avg("x").alias("centroid_lon"), F.avg("y").alias("centroid_lat"))
