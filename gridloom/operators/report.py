"""Summary tables and views (S1-S5, quadrants, chapter views): small results over step outputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import haversine_km
from gridloom.functions.numeric import format_site, np_round, poverty_rate, quadrant, safe_div
from gridloom.operators.ordered import scalar_quantiles
from gridloom.operators.select import quantile_band, rank_by, top_n
from gridloom.operators.tabular import one_to_one, with_names
from gridloom.operators.zonal import collapse_pairs, throughput
from gridloom.session import sized

QUADRANTS = ("High score & high poverty", "High score & lower poverty", "Lower score & high poverty", "Lower score & lower poverty")


def totals_from_kpis(kpis: DataFrame) -> DataFrame:
    """AGG-26: an area's totals from the first row whose percentage lies in 0.001..100: total = part * 100 / pct."""
    def total(part: str, pct: str) -> F.Column:
        ok = F.col(pct).between(0.001, 100)
        return F.min_by(F.when(ok, F.col(part) * 100 / F.when(ok, F.col(pct))), F.when(ok, F.col("travel_cut_min")))

    return kpis.agg(total("pop_within", "pop_pct").alias("pop_total"), total("cropland_km2", "cropland_pct").alias("cropland_total_km2"))


def table_s1(clusters: DataFrame | None, totals: DataFrame | None = None, spark=None) -> DataFrame:
    """AGG-33: one row over the clusters; no table gives nulls, an empty one zeros; densities need an area."""
    if clusters is None:
        return spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in (("clusters", "long"), ("area_km2", "double"), ("pop", "double"), ("cropland_km2", "double"), ("pop_per_km2", "double"), ("cropland_share", "double"))))
    g = clusters.agg(F.count("*").alias("clusters"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("area_km2", "pop", "cropland_km2")))
    out = g.select("*", safe_div("pop", "area_km2").alias("pop_per_km2"), safe_div("cropland_km2", "area_km2").alias("cropland_share"))
    if totals is not None:  # both are one row
        t = totals.select(F.lit(1).alias("__one"), F.col("pop_total").alias("__p"), F.col("cropland_total_km2").alias("__c"))
        out = out.withColumn("__one", F.lit(1)).join(t, "__one", "left").withColumns({"pop_pct": safe_div(100 * F.col("pop"), "__p"), "cropland_pct": safe_div(100 * F.col("cropland_km2"), "__c")}).drop("__one", "__p", "__c")
    return out


def table_s2(rank: DataFrame, indicators: DataFrame, n: int = 5, code: str = "ADM2CD_c") -> DataFrame:
    """JON-6, WIN-9, WIN-7: top zones with indicators and their share of all selected area."""
    shared = rank.withColumn("priority_share_pct", safe_div(100.0 * F.col("selected_km2"), F.sum("selected_km2").over(Window.partitionBy())))
    return top_n(one_to_one(shared, indicators, [code]), n, F.desc_nulls_last("score"), code)


def quadrant_stats(rows: DataFrame, score: str = "score", poverty: str = "poverty_rural", rural_pop: str = "rural_pop_est") -> DataFrame:
    """PRJ-29, AGG-25: zones, rural poor and their share by quadrant against the medians, in a fixed order."""
    both = rows.filter(F.col(score).isNotNull() & F.col(poverty).isNotNull())
    found = scalar_quantiles(both, {"score": (score, 0.5), "poverty": (poverty, 0.5), "most": (poverty, 1.0)})
    medians = found["score"], found["poverty"], found["most"]
    if medians[0] is None:
        return rows.limit(0).select(F.lit("").alias("quadrant"), F.lit(0).cast("long").alias("zones"), F.lit(0.0).alias("rural_poor"), F.lit(0.0).alias("share_pct"))
    labelled = rows.withColumn("quadrant", quadrant(score, poverty, F.lit(float(medians[0])), F.lit(float(medians[1]))))
    poor = F.col(rural_pop) * poverty_rate(poverty, F.lit(float(medians[2])))
    g = labelled.filter("quadrant is not null").groupBy("quadrant").agg(F.count("*").alias("zones"), F.coalesce(F.sum(poor), F.lit(0.0)).alias("rural_poor"))
    every = rows.sparkSession.createDataFrame([(q,) for q in QUADRANTS], "quadrant string")
    full = F.broadcast(every).join(g, "quadrant", "left").fillna(0, ["zones", "rural_poor"])
    return full.withColumn("share_pct", np_round(safe_div(100.0 * F.col("rural_poor"), F.sum("rural_poor").over(Window.partitionBy())), 0)).select("quadrant", "zones", np_round("rural_poor", 0).alias("rural_poor"), "share_pct")


def table_s3(catchments: DataFrame, threshold: float = 60.0, n: int = 10, key: str = "site_index") -> DataFrame:
    """FLT-8, WIN-5, WIN-7: best sites by people within one threshold."""
    at = catchments.filter(F.col("thresh_min") == threshold)
    return rank_by(at, "pop", key).filter(F.col("rank") <= n).withColumn("site", format_site(key))


def available_radii(columns: list[str], layer: str = "gov") -> list[int]:
    """PRJ-31: radii in km that a synergy table has counts for."""
    found = (re.fullmatch(rf"count_{layer}_le(\d+)km", c) for c in columns)
    return sorted(int(m[1]) for m in found if m)


def table_s4(synergies: DataFrame, layers: tuple[str, ...] = ("gov", "wb", "oth"), radius: int | None = None, n: int = 10, key: str = "cluster_id") -> DataFrame:
    """WIN-7, JON-10: clusters with most projects within the largest (or a given) radius."""
    r = radius or max(available_radii(synergies.columns, layers[0]))
    total = sum((F.col(f"count_{la}_le{r}km") for la in layers), F.lit(0))
    return top_n(synergies.withColumn("projects", total), n, F.desc("projects"), key)


def table_s5(flows: DataFrame, names: DataFrame | None = None, flags: DataFrame | None = None, n: int = 10, order: str | None = None) -> DataFrame:
    """AGG-20, JON-13, GRV-8, WIN-7: largest undirected flows, named, and whether both ends are priority zones."""
    out = collapse_pairs(flows, order)
    if names is not None:
        out = with_names(with_names(out, names, "oi", "origin"), names, "dj", "destination")
    if flags is not None:
        f = flags.select(F.col("code"), F.col("in_priority_mask").alias("__p"))
        for side in ("oi", "dj"):
            out = out.join(sized(f.withColumnsRenamed({"code": side, "__p": f"__{side}"})), side, "left")
        out = out.withColumn("both_priority", F.coalesce(F.col("__oi") & F.col("__dj"), F.lit(False))).drop("__oi", "__dj")
    return top_n(out, n, F.desc("flow"), "oi", "dj")


def islands(synergies: DataFrame, columns: list[str]) -> DataFrame:
    """FLT-7: sites without any project around."""
    return synergies.filter(sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0)) == 0)


def coverage(rows: DataFrame, key: str, value: str) -> DataFrame:
    """AGG-22: number and sum by key, largest first."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).orderBy(F.desc("n"), F.desc_nulls_last("total"), key)


def threshold_totals(catchments: DataFrame) -> DataFrame:
    """AGG-23: people and cropland by threshold."""
    return catchments.groupBy("thresh_min").agg(F.sum("pop").alias("pop"), F.sum("cropland_km2").alias("cropland_km2"))


def equity_outliers(rows: DataFrame, need: str, score: str) -> DataFrame:
    """FLT-6: zones of high need and low score."""
    return quantile_band(rows, need, score)


def simple_correlation(rows: DataFrame, a: str, b: str) -> float | None:
    """AGG-14: null with a constant column or fewer than two rows."""
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = both.agg(F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)).first()
    return None if not s[1] or not s[2] else s[0] / (s[1] * s[2])


def to_reference_point(rows: DataFrame, lon: float, lat: float, out: str) -> DataFrame:
    """SRC-10: distance to a named point."""
    return rows.withColumn(out, haversine_km(F.lit(float(lon)), F.lit(float(lat)), "lon", "lat"))


def movement_view(flows: DataFrame, attributes: DataFrame, code: str = "code") -> DataFrame:
    """JON-16, AGG-21: node totals with the zones' attributes."""
    return attributes.join(throughput(flows).withColumnRenamed("node", code), code, "left").fillna(0.0, ["out_flow", "in_flow", "throughput"])
