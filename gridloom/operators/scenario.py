"""Scenario sweeps (JON-19, PRJ-17, AGG-17, AGG-18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import np_round
from gridloom.operators.cluster import remove_small
from gridloom.operators.focal import focal_mean
from gridloom.operators.score import components, eligible, scalars
from gridloom.operators.select import top_area, top_percent
from gridloom.operators.zonal import overlap
from gridloom.params import COMPONENTS, SCENARIOS, Params, Scenario
from gridloom.session import written


def scenario_score(cells: DataFrame, p: Params, s: dict, overlays: bool = False) -> Column:
    """PRJ-17: core components only (unless overlays), weights divided by their sum plus 1e-9."""
    parts = components(cells, p, s)
    on = [k for k, use in zip(COMPONENTS, p.use_components, strict=True) if use and k in parts] + ([k for k in ("pov", "food", "mtt", "rwi") if k in parts] if overlays else [])
    total = sum(p.weights[k] for k in on) + 1e-9
    return eligible(sum((F.lit(p.weights[k] / total) * parts[k] for k in on), F.lit(0.0)), p, s)


def scenario_masks(cells: DataFrame, base: Params = Params(), scenarios: tuple[Scenario, ...] = SCENARIOS) -> DataFrame:
    """One row per scenario and cell: scenario_id, row, col, selected (no data counts as 0).

    One plan for all scenarios: a cell's scores are an array of one projection, the scenario is part of the grid's key from
    then on, so smoothing, selection and the removal of small groups run once each (smoothing once for each radius).
    """
    cells = written(cells, "cells")
    s = scalars(cells)
    params = {sc.scenario_id: sc.params(base) for sc in scenarios}
    keys = ("scenario_id", "aoi")

    def of(figure) -> Column:
        return F.create_map(*(F.lit(x) for k, p in params.items() for x in (k, figure(p))))[F.col("scenario_id")]

    smoothed = []
    for radius in sorted({p.smooth_radius for p in params.values()}):
        each = F.array(*(F.struct(F.lit(k).alias("scenario_id"), scenario_score(cells, p, s).cast("double").alias("score")) for k, p in params.items() if p.smooth_radius == radius))
        smoothed.append(focal_mean(cells.withColumn("__each", F.explode(each)).select("*", "__each.*").drop("__each"), "score", radius, keys=keys))
    scored = written(reduce(DataFrame.unionByName, smoothed), "scored")
    by_area = [k for k, p in params.items() if p.top_km2 is not None]
    parts = []
    if len(by_area) < len(params):
        parts.append(top_percent(scored.filter(~F.col("scenario_id").isin(by_area)), "score", of(lambda p: float(p.top_pct_cells)), null_is_zero=True, keys=keys))
    if by_area:
        parts.append(top_area(scored.filter(F.col("scenario_id").isin(by_area)), "score", of(lambda p: float(p.top_km2 or 0)), null_is_zero=True, keys=keys))
    masks = reduce(DataFrame.unionByName, parts)  # a projection of what is written
    return remove_small(masks, "selected", of(lambda p: int(p.min_cluster_cells)), base.prune_connectivity, keys)


def scenario_metrics(masks: DataFrame, baseline: str | DataFrame = "baseline") -> DataFrame:
    """Cells, area, people, cropland and drought of each scenario's selection, and its overlap with the baseline: a scenario's
    name, or a table of cells with `selected` (the mask of the full score)."""
    source = masks.filter(F.col("scenario_id") == baseline) if isinstance(baseline, str) else baseline
    base = source.select(*[k for k in ("aoi", "row", "col") if k in masks.columns], (F.col("selected") == 1).alias("in_base"))
    keys = [k for k in ("aoi", "row", "col") if k in masks.columns]
    joined = masks.join(base, keys, "left").withColumns({"on": F.col("selected") == 1, "in_base": F.coalesce("in_base", F.lit(False))})
    on = lambda c: F.coalesce(F.sum(F.when(F.col("on"), c)), F.lit(0.0))
    extra = overlap(F.col("on"), F.col("in_base"))
    return joined.groupBy("scenario_id").agg(
        F.count_if("on").alias("selected_cells"),
        on(F.col("area_km2")).alias("selected_km2"),
        on(F.col("pop")).alias("pop_selected"),
        on(F.col("crop_frac") * F.col("area_km2")).alias("ag_km2_selected"),
        F.avg(F.when(F.col("on"), F.col("drought"))).alias("drought_mean_selected"),
        *(c.alias(k) for k, c in extra.items()),
        F.count_if("in_base").alias("baseline_cells"),
    )


def sweep(cells: DataFrame, base: Params = Params(), scenarios: tuple[Scenario, ...] = SCENARIOS, baseline: str | DataFrame = "baseline") -> DataFrame:
    """Q10: metrics joined to the scenarios' parameters; figures rounded as in the published table."""
    rows = [(sc.scenario_id, sc.desc, sc.scenario_id, str(tuple(p.use_components)), *(float(p.weights.get(c, 0.0)) for c in COMPONENTS), p.mask_require_rural, p.mask_min_cropland, p.top_pct_cells / 100, p.top_km2, p.min_cluster_cells, p.smooth_radius) for sc in scenarios for p in [sc.params(base)]]
    table = cells.sparkSession.createDataFrame(rows, "scenario_id string, desc string, id string, USE_COMPONENTS string, W_ACC double, W_POP double, W_VEG double, W_NTL double, W_DRT double, MASK_REQUIRE_RURAL boolean, MASK_MIN_CROPLAND double, TOP_PCT_CELLS double, TOP_KM2 double, MIN_CLUSTER_CELLS int, SMOOTH_RADIUS int")
    m = scenario_metrics(written(scenario_masks(cells, base, scenarios), "masks"), baseline)
    m = m.withColumns({c: np_round(c, 4) for c in ("jaccard_vs_baseline", "drought_mean_selected", "selected_km2", "pop_selected", "ag_km2_selected", "overlap_pct_vs_baseline")})
    return F.broadcast(table).join(m, "scenario_id", "left")
