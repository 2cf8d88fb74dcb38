"""Further queries, of single operators over the driver's tables, each beside its SQL.

The SQL says what the surveyed steps compute, in terms of the tables; it is not drawn from the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo, projection
from gridloom.functions import numeric as num
from gridloom.functions.numeric import np_round
from gridloom.operators import cluster, cost, distance, filters, grid, od, profile, raster, report, score, select, tabular, validate, zonal
from gridloom.operators.grid import GridSpec
from gridloom.plans import steps
from gridloom.plans.analogues import SEGMENTS, SPEC, STEP, P, _boxes, _chosen, _wide, cells, indicators, rounded, sites, table, targets, zones
from gridloom.plans.oracles import AREA_G, BOXES, CELLS, EIGHT, FOUR, SCALARS, SITES, TOP, WIDE, WITH, ZONES, _blend, _components, _eligible, _gravity, _grid, _hav, _i, _r, _smoothed
from gridloom.session import remove_at_end, shared_dir, written
from gridloom.sources import geofiles, readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: All five core components, night light with a weight.
ALL_ON = P.with_(use_components=(1, 1, 1, 1, 1))


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def folder(spark: SparkSession) -> str:
    import uuid

    path = f"{shared_dir(spark)}/gridloom/files-{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    return path


# scores ------------------------------------------------------------------------------------------------------------------


@query(f"""with {CELLS}, {SCALARS}, e as (select "row", col, {_eligible(_blend(ALL_ON, True, True, ''), ALL_ON)} as score from g, k) select "row", col, {_r('score')} as score from {_smoothed('e')}""")
def priority_all_components(spark, d):
    return rounded(score.priority_score(cells(spark, d), ALL_ON).select("row", "col", "score"))


@query(f"""with {CELLS}, {SCALARS}, e as (select "row", col, case when crop_frac >= 0.05 then {_blend(P.with_(use_components=(1, 1, 0, 0, 0)), False, True, '')} end as score from g, k) select "row", col, {_r('score')} as score from {_smoothed('e')}""")
def priority_absent_layers(spark, d):
    """No drought column, rural and overlays without any value: left out, the weights of the others sum to 1."""
    c = cells(spark, d).drop("drought", "pov").withColumns({k: F.lit(None).cast("double") for k in ("rural", "food", "mtt", "rwi")})
    return rounded(score.priority_score(c, P).select("row", "col", "score"))


_V1 = f"""0.35 * (1 - least(greatest(travel_min, 0), 240) / 240) + 0.25 * least(pop / pop95, 1) + 0.20 * least(greatest((veg - 0.3) / 0.7, 0), 1)
    + 0.10 * least(ntl, 0.3) / 0.3 + 0.10 * (1 - least(drought, 30) / 30)"""


@query(f"""with {CELLS}, {SCALARS}, s as (select "row", col, case when veg is not null then {_V1} end as score from g, k)
    select "row", col, {_i('score >= (select quantile_cont(score, 0.9) from s)')} as selected from s""")
def priority_v1(spark, d):
    return score.priority_v1(cells(spark, d)).select("row", "col", "selected")


_MASKED = f"""{CELLS}, {SCALARS}, e as (select "row", col, {_eligible(_blend(P, True, True, ''), P)} as score from g, k), sm as {_smoothed('e')}, q as (select quantile_cont(score, 0.9) as q from sm), pick as (
    select "row", col, score, case when score is null then null when score >= q then 1 else 0 end as sel from sm, q), node as (select "row", col, "row" * 40 + col as id from pick where sel = 1), edge as (
    select a.id as a, b.id as b from node a join node b on {FOUR}), reach(id, other) as (select id, id from node union select r.id, e.b from reach r join edge e on r.other = e.a), tiny as (
    select id from reach group by id having count(*) < {P.min_cluster_cells}), m as (
    select "row", col, score, case when sel = 1 and "row" * 40 + col in (select id from tiny) then 0 else sel end as selected from pick)"""


@query(f"{WITH}{_MASKED} select \"row\", col, {_i('selected')} as selected from m")
def priority_mask(spark, d):
    return score.priority_mask(cells(spark, d), P).select("row", "col", "selected")


@query(f"""{WITH}{_MASKED}, a as (select zone_id, avg(score) as score, count(*) filter (selected = 1) as sc, count(*) as tc, coalesce(sum(area_km2) filter (selected = 1), 0) as sk from m join g using ("row", col) where score is not null group by 1)
    select zone_id, {_r('score')} as score, sc as selected_cells, {_r('sk')} as selected_km2, tc as total_cells, {_i('row_number() over (order by score desc, zone_id)')} as rank from a""")
def priority_rank(spark, d):
    """Q07 from layers to ranked zones."""
    masked = written(score.priority_mask(cells(spark, d), P), "masked")
    return rounded(zonal.rank_pack(masked).select("zone_id", "score", "selected_cells", "selected_km2", "total_cells", "rank"))


@query(f"with {CELLS}, k as (select quantile_cont(pop, 0.9) as q from g) select \"row\", col, {_r('least(pop, q)')} as capped from g, k")
def capped_layer(spark, d):
    out, _ = score.percentile_cap(cells(spark, d), "pop", 0.9, "capped")
    return rounded(out.select("row", "col", "capped"))


# clusters ----------------------------------------------------------------------------------------------------------------


@query(f"""{WITH}{_components(EIGHT)}, big as (select root, sum(area_km2) as a, sum(pop) as p, count(*) as c from comp join g using ("row", col) group by 1 having count(*) >= 3 and sum(area_km2) >= 4)
    select {_r('a', 4)} as area_km2, {_r('p', 4)} as pop, {_i('dense_rank() over (order by root)')} as cluster_id, {_i('row_number() over (order by a desc, p desc, root)')} as place from big""")
def cluster_order(spark, d):
    """CLU-2 by area, CLU-4."""
    _, t = steps.priority_clusters(_chosen(spark, d).withColumn("risk", F.lit(0.0)), P.with_(min_cluster_km2=4.0))
    order = [F.desc_nulls_last("area_km2"), F.desc_nulls_last("pop"), "cluster_id"]
    return rounded(select.rank_by(t, "area_km2", *order[1:], out="place").select("area_km2", "pop", "cluster_id", "place"), 4)


@query(f"with {CELLS}, k as (select zone_id as v from g group by 1) select count(*) as n, true as ok from k union all select count(*), false from k where v <> 5")
def contiguous_labels(spark, d):
    k = cells(spark, d).select("zone_id").distinct()
    return select.contiguous(k, "zone_id").unionByName(select.contiguous(k.filter("zone_id <> 5"), "zone_id"))


# grids -------------------------------------------------------------------------------------------------------------------


def _coarse_all(spark, d):
    target = GridSpec(SPEC.x0, SPEC.y0, STEP * 4, STEP * 4, 10, 10)
    src, to = cells(spark, d).select("row", "col", F.col("veg").alias("value")), grid.template_cells(spark, target)
    parts = [grid.align(src, SPEC, to, target, m).withColumn("method", F.lit(m)) for m in ("min", "med", "q1", "q3", "sum", "rms")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, 8)


@query(f"""with {CELLS}, b as (select {_i('"row" // 4')} as "row", {_i('col // 4')} as col, min(veg) as "min", median(veg) as med, quantile_cont(veg, 0.25) as q1, quantile_cont(veg, 0.75) as q3, sum(veg) as "sum", sqrt(avg(veg * veg)) as rms from g group by 1, 2)
    select "row", col, method, {_r('v', 8)} as value from (unpivot b on "min", med, q1, q3, "sum", rms into name method value v)""")
def coarsen_others(spark, d):
    return _coarse_all(spark, d)


_KERNELS = {
    "cubic": "case when abs({x}) < 1 then 1.5 * pow(abs({x}), 3) - 2.5 * pow({x}, 2) + 1 when abs({x}) < 2 then -0.5 * pow(abs({x}), 3) + 2.5 * pow({x}, 2) - 4 * abs({x}) + 2 else 0 end",
    "cubic_spline": "case when abs({x}) < 1 then (4 - 6 * pow({x}, 2) + 3 * pow(abs({x}), 3)) / 6 when abs({x}) < 2 then pow(2 - abs({x}), 3) / 6 else 0 end",
    "lanczos": "case when abs({x}) < 1e-12 then 1 when abs({x}) < 3 then 3 * sin(pi() * {x}) * sin(pi() * {x} / 3) / pow(pi() * {x}, 2) else 0 end",
}


def _kernel_sql() -> str:
    each = " union all ".join(f"""select '{m}' as method, r as "row", c as col, sum(veg * ({k.format(x='(v - "row")')}) * ({k.format(x='(u - col)')})) as a, sum(({k.format(x='(v - "row")')}) * ({k.format(x='(u - col)')})) as w
        from t join g on veg is not null and abs(v - "row") < 3 and abs(u - col) < 3 group by 1, 2, 3""" for m, k in _KERNELS.items())
    return f"""with {CELLS}, t as (select {_i('r')} as r, {_i('c')} as c, 0.25 + (r + 0.5) * 2 - 0.5 as v, 0.25 + (c + 0.5) * 2 - 0.5 as u from (select unnest(range(16)) as r) cross join (select unnest(range(16)) as c)), s as ({each})
        select method, "row", col, {_r('a / w', 6)} as value from s"""


@query(_kernel_sql())
def align_kernels(spark, d):
    target = GridSpec(SPEC.x0 + STEP / 4, SPEC.y0 - STEP / 4, STEP * 2, STEP * 2, 16, 16)
    src, to = cells(spark, d).select("row", "col", F.col("veg").alias("value")), grid.template_cells(spark, target)
    out = None
    for m in _KERNELS:
        part = grid.align(src, SPEC, to, target, m).withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return rounded(out.filter("value is not null"), 6)


@query(f"""with {CELLS} select "row", col, {_r(f"{AREA_G} * {STEP}::double * {STEP}::double * cos(radians(y))", 9)} as degrees, 1.0::double as constant, 0.25::double as metres from g""")
def cell_areas(spark, d):
    metric = GridSpec(0.0, 0.0, 500.0, 500.0, 40, 40, "EPSG:32733")
    return rounded(cells(spark, d).select("row", "col", geo.cell_area("y", SPEC).alias("degrees"), geo.cell_area("y", SPEC, "constant").alias("constant"), geo.cell_area("y", metric).alias("metres")), 9)


_IN_AOI = f"""{CELLS}, {BOXES}, e as (select *, 10.0::double - {STEP}::double / 2 as gx, -10.0::double + {STEP}::double / 2 as gy from box), a as (
    select g.*, exists (select 1 from e where (x1 - gx) / {STEP}::double < col + 1 and (x1 + w - gx) / {STEP}::double >= col and (gy - y1) / {STEP}::double < "row" + 1 and (gy - y1 + h) / {STEP}::double >= "row") as in_aoi from g)"""


@query(f"""with {_IN_AOI} select "row", col, case when in_aoi then veg end as veg, case when in_aoi then ntl end as ntl from a""")
def aoi_applied(spark, d):
    c = cells(spark, d)
    return grid.apply_mask(raster.aoi_mask(c, _boxes(spark, d), SPEC), ["veg", "ntl"]).select("row", "col", "veg", "ntl")


@query(f"with {_IN_AOI} select {_r('avg(in_aoi::int)')} as inside, true as same_shape, false as cut_shape from a")
def aoi_share(spark, d):
    c = raster.aoi_mask(cells(spark, d), _boxes(spark, d), SPEC)
    same, cut = grid.same_cells(c, c.select("col", "row")), grid.same_cells(c, c.filter("row > 0"))
    return rounded(c.agg(grid.overlap_share(c).alias("inside"), F.lit(same).alias("same_shape"), F.lit(cut).alias("cut_shape")))


@query(f"""with {CELLS} select "row", col, case when "row" % 2 = 0 then veg end as a, ntl as b, null::double as c from g""")
def stacked_layers(spark, d):
    c = cells(spark, d)
    return grid.stack_layers(c.select("row", "col"), {"a": c.filter("row % 2 = 0").select("row", "col", F.col("veg").alias("value")), "b": c.select("row", "col", F.col("ntl").alias("value")), "c": None})


# vectors -----------------------------------------------------------------------------------------------------------------


@query(f"with {BOXES} select k::bigint as feature_id, {_r('x1 + w / 2', 7)} as lon, {_r('y1 - h / 2', 7)} as lat from box")
def representative_points(spark, d):
    return rounded(geo.representative_points(_boxes(spark, d)).select("feature_id", "lon", "lat"), 7)


@query(f"""with {SITES} select site_id, case when r between 0 and 19 and c between 0 and 19 then {_i('r')} end as "row", case when r between 0 and 19 and c between 0 and 19 then {_i('c')} end as col
    from (select site_id, floor(((-10.0::double + {STEP}::double / 2) - lat) / {STEP}::double) as r, floor((lon - (10.0::double - {STEP}::double / 2)) / {STEP}::double) as c from p where site_id % 3 <> 0)""")
def point_cells(spark, d):
    """GEO-4, GEO-8: points without a finite place go; a grid of 20 x 20 cells."""
    k = F.col("site_id")
    p = sites(spark, d).withColumn("lon", F.when(k % 3 != 0, F.col("lon")).when(k % 2 == 0, float("nan")))
    r, c = geo.row_col("lon", "lat", GridSpec(SPEC.x0, SPEC.y0, STEP, STEP, 20, 20))
    return geo.finite_points(p).select("site_id", r.alias("row"), c.alias("col"))


def _inverse(pairs: str, turns: int) -> str:
    """CTEs up to `geodesic` (oi, dj, km): the inverse geodesic by its published iteration. pairs: select of oi, dj, x1, y1, x2, y2."""
    angles = """select *, case when c2 = 0 then 0 else cs - 2 * sin(u) * sin(v) / c2 end as cm from (select *, 1 - sa * sa as c2, atan2(ss, cs) as sigma from (select *, case when ss = 0 then 0 else cos(u) * cos(v) * sin(lam) / ss end as sa from (
    select *, sqrt(pow(cos(v) * sin(lam), 2) + pow(cos(u) * sin(v) - sin(u) * cos(v) * cos(lam), 2)) as ss, sin(u) * sin(v) + cos(u) * cos(v) * cos(lam) as cs from turn where {})))"""
    return f"""c as (select 6378137.0::double as a, 1 / 298.257223563::double as f), start as (select oi, dj, radians(((x2 - x1 + 540) % 360) - 180) as l, atan((1 - f) * tan(radians(y1))) as u, atan((1 - f) * tan(radians(y2))) as v, a, f
    from ({pairs}), c), turn(i, oi, dj, l, u, v, a, f, lam) as (select 0, oi, dj, l, u, v, a, f, l from start union all
    select i + 1, oi, dj, l, u, v, a, f, l + (1 - cc) * f * sa * (sigma + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) from (select *, f / 16 * c2 * (4 + f * (4 - 3 * c2)) as cc from ({angles.format(f'i < {turns}')}))),
    last as (select *, c2 * (a * a - pow(a * (1 - f), 2)) / pow(a * (1 - f), 2) as q from ({angles.format(f'i = {turns}')})),
    series as (select *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) as big, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) as small from last), geodesic as (
    select oi, dj, a * (1 - f) * big * (sigma - small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) / 1000 as km from series)"""


@query(f"""with recursive {ZONES}, {_inverse('select o.code as oi, d.code as dj, o.lon as x1, o.lat as y1, d.lon as x2, d.lat as y2 from z o, z d where o.code < d.code', 60)}
    select oi, dj, {_r('km', 5)} as km from geodesic""")
def geodesic_pairs(spark, d):
    z = zones(spark, d)
    a, b = z.select(F.col("code").alias("oi"), F.col("lon").alias("x1"), F.col("lat").alias("y1")), z.select(F.col("code").alias("dj"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    pairs = a.join(b, F.col("oi") < F.col("dj"))
    return rounded(pairs.select("oi", "dj", geo.geodesic_km("x1", "y1", "x2", "y2").alias("km")), 5)


_HIT = f"{BOXES}, {_grid(40, 1)}, hit as (select k, {_i('r')} as \"row\", {_i('c')} as col from fine join box on cx >= x1 and cx < x1 + w and cy < y1 and cy >= y1 - h)"


@query(f"with {_HIT} select \"row\", col, {_i('arg_max(lab, k)')} as zone_id from hit join (select n_nationkey as nk, row_number() over (order by n_name) as lab from nation) on nk = k group by 1, 2")
def zone_burn(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("feature_id"), "n_name")
    return raster.burn_zones(_boxes(spark, d).join(n, "feature_id"), SPEC, "n_name")


@query(f"with {CELLS}, {_HIT} select k::bigint as feature_id, \"row\", col, g.veg from hit join g using (\"row\", col)")
def clipped_cells(spark, d):
    field = raster.pick_field(cells(spark, d), ["VEG_2020", "veg", "ntl"], required=True)
    return raster.clip_cells(cells(spark, d).select("row", "col", field), _boxes(spark, d), SPEC)


_LINES = f"""{BOXES}, ends as (select k, (['motorway', 'track', 'ferry', 'primary'])[k % 4 + 1] as fclass, floor((x1 - (10.0::double - {STEP}::double / 2)) / {STEP}::double) as c1, floor((x1 + w - (10.0::double - {STEP}::double / 2)) / {STEP}::double) as c2,
    floor(((-10.0::double + {STEP}::double / 2) - y1) / {STEP}::double) as r1, floor(((-10.0::double + {STEP}::double / 2) - (y1 - h)) / {STEP}::double) as r2 from box), fast as (
    select {_i('r')} as "row", {_i('c')} as col, max(case fclass when 'motorway' then 90.0::double when 'primary' then 60 else 20 end) as kmh from ends, range(40) a(r), range(40) b(c)
    where fclass <> 'ferry' and ((r in (r1, r2) and c between c1 and c2) or (c = c2 and r between r1 and r2)) group by 1, 2)"""


def _roads(spark, d):
    return _boxes(spark, d).withColumns({"kind": F.lit("line"), "fclass": F.element_at(F.array(*(F.lit(c) for c in ("motorway", "track", "ferry", "primary"))), (F.col("seq") % 4 + 1).cast("int"))})


@query(f"with {_LINES} select \"row\", col, kmh as value from fast")
def road_speeds(spark, d):
    return raster.class_max(_roads(spark, d), SPEC, P.road_speeds)


@query(f"with {CELLS}, {_LINES} select g.\"row\", g.col, {_r('60.0::double / coalesce(greatest(kmh, 4.0), 4.0)', 9)} as friction from g left join fast using (\"row\", col)")
def friction_surface(spark, d):
    return rounded(cost.friction_surface(cells(spark, d), _roads(spark, d), SPEC).select("row", "col", "friction"), 9)


#: Least minutes from the nations' cells: 150 rounds of relaxing all cells with their eight neighbours, which more than settles.
_DY, _DX = f"(110.574::double * {STEP}::double)", f"(111.320::double * cos(radians(-10.0::double + {STEP}::double / 2 - {STEP}::double * 20)) * {STEP}::double)"
def _minutes(seeds: str) -> str:
    """CTEs up to `minutes` (site_id, row, col, minutes) from seeds (site_id, row, col)."""
    return f"""{CELLS}, land as (select "row", col, case when road > 0 then 1.5::double else 15.0::double end as f from g), nb as (
    select a."row" as r0, a.col as c0, b."row", b.col, sqrt(pow((a."row" - b."row") * {_DY}, 2) + pow((a.col - b.col) * {_DX}, 2)) * (a.f + b.f) / 2 as w from land a join land b on {EIGHT}), turn(i, site_id, "row", col, m) as (
    select 0, site_id, "row", col, 0.0::double from ({seeds}) join land using ("row", col) union all
    select any_value(i) + 1, site_id, nb."row", nb.col, min(m + w) from turn join nb on r0 = turn."row" and c0 = turn.col where i < 150 group by site_id, nb."row", nb.col), minutes as (
    select site_id, "row", col, m as minutes from turn where i = 150)"""


_MINUTES = _minutes('select n_nationkey as site_id, n_nationkey * 13 % 40 as "row", n_nationkey * 7 % 40 as col from nation')
#: The suppliers stand on 40 cells.
ORACLES["cost_distance"] = f"""with recursive {_minutes('select k as site_id, k * 13 % 40 as "row", k * 7 % 40 as col from range(40) t(k)')}
    select s_suppkey as site_id, "row", col, {_r('minutes', 4)} as minutes from minutes join supplier on s_suppkey % 40 = site_id where minutes <= 300"""


def _surface(spark, d):
    c = cells(spark, d).withColumn("friction", num.friction(F.when(F.col("road") > 0, 40.0)))
    k = F.col("n_nationkey")
    at = table(spark, d, "nation").select(k.alias("site_id"), (k * 13 % 40).cast("int").alias("row"), (k * 7 % 40).cast("int").alias("col"))
    return written(cost.travel_minutes(at, c, SPEC, 300.0), "minutes")


@query(f"with recursive {_MINUTES} select site_id, \"row\", col, {_r('minutes', 4)} as minutes from minutes where minutes <= 300")
def travel_minutes(spark, d):
    return rounded(_surface(spark, d).select("site_id", "row", "col", "minutes"), 4)


@query(f"""with recursive {_MINUTES}, k as (select site_id, t as thresh_min, g.*, minutes from minutes join g using ("row", col), (select unnest([30.0::double, 60, 120, 240]) as t) where minutes <= t)
    select site_id, thresh_min, {_r('sum(area_km2)', 3)} as area_km2, {_r('sum(pop)', 3)} as pop, {_r('sum(crop_frac * area_km2)', 3)} as cropland_km2, {_r('avg(rwi)', 9)} as rwi_mean, {_r('sum(rwi * pop) / sum(pop)', 5)} as rwi_pop_weighted,
    {_r('avg(minutes)', 3)} as mean_travel_min from k group by 1, 2""")
def catchment_kpis(spark, d):
    k = cost.catchment_kpis(_surface(spark, d), cells(spark, d), P.iso_thresholds)
    digits = {"rwi_mean": 9, "rwi_pop_weighted": 5}  # means of few thousandths end in a 5
    return k.select("site_id", "thresh_min", *(np_round(c, digits.get(c, 3)).alias(c) for c in ("area_km2", "pop", "cropland_km2", "rwi_mean", "rwi_pop_weighted", "mean_travel_min")))


@query(f"""with recursive {_MINUTES}, r as (select t as thresh_min, "row", col, max(case when minutes <= t then 1 else 0 end) as hit from minutes, (select unnest([30.0::double, 60, 120, 240]) as t) group by 1, 2, 3)
    select thresh_min, sum(hit)::bigint as cells, {_r('sum(pop) filter (hit = 1)', 3)} as pop, {_r('sum(crop_frac * area_km2) filter (hit = 1)', 3)} as cropland_km2 from r join g using ("row", col) group by 1""")
def catchment_union(spark, d):
    """CST-3, CST-5, SET-9, AGG-23: what any of the sites reaches, by threshold."""
    every = table(spark, d, "nation").select(F.col("n_nationkey").alias("site_id"))
    u = cost.union_of_catchments(_surface(spark, d), every, P.iso_thresholds).filter("mask = 1").join(cells(spark, d), ["row", "col"])
    u = u.withColumn("cropland_km2", F.col("crop_frac") * F.col("area_km2"))
    return rounded(report.threshold_totals(u).join(u.groupBy("thresh_min").agg(F.count("*").alias("cells")), "thresh_min"), 3)


# flows -------------------------------------------------------------------------------------------------------------------


@query(f"with {CELLS}, {_HIT} select k::bigint as feature_id, {_r('coalesce(sum(pop), 0)', 3)} as pop from box left join hit using (k) left join g using (\"row\", col) group by 1")
def zone_people(spark, d):
    return rounded(od.zone_population(cells(spark, d), _boxes(spark, d), SPEC).select("feature_id", "pop"), 3)


_MASSED = f"""{ZONES}, y as (select *, mass as pop, code % 5 - 2.0::double as rwi_z, greatest(0, mass * (1 + 0.25 * (code % 5 - 2))) as tilted from z)"""
_TILTED = P.with_(rwi_weight=0.25, od_alpha=0.9, od_gamma=1.1, od_impedance="pow")


def _tilted(spark, d):
    z = zones(spark, d).withColumn("pop", F.col("mass")).drop("mass").withColumn("rwi_z", F.col("code") % 5 - F.lit(2.0))
    return od.with_mass(z, _TILTED)


@query(f"""with {_MASSED}, pair as (select a.code as oi, b.code as dj, pow(a.tilted, 0.9) * pow(b.tilted, 1.1) * (case when b.code = a.code + 1 then 2.5::double else 1.0::double end) as m, {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} as dist_km
    from y a, y b where a.pop >= 1000 and b.pop >= 1000), r as (select *, case when dist_km > 1500 then 0 else m * pow(1 + dist_km, -1.5) end as raw from pair)
    select oi, dj, {_r('raw * 1e6 / sum(raw) over ()', 4)} as flow, {_r('dist_km', 4)} as dist_km from r""")
def od_bilateral(spark, d):
    """GRV-7, JON-18: wealth tilt, exponents, pair weights, zones of 1,000 and more."""
    z = _tilted(spark, d)
    w = z.select(F.col("code").alias("oi"), (F.col("code") + 1).alias("dj"), F.lit(2.5).alias("w"))
    return rounded(od.gravity(z, _TILTED, weights=w, min_pop=1000.0), 4)


@query(f"with {_MASSED} select code, n_name, lon, lat, pop, rwi_z, {_r('tilted')} as mass from y")
def od_attributes(spark, d):
    return rounded(od.zone_attributes(_tilted(spark, d)))


@query(f"""with {_gravity()}, u as (select least(oi, dj) as oi, greatest(oi, dj) as dj, sum({_r('flow')}) as flow from f where oi <> dj group by 1, 2 order by flow desc, oi, dj limit 10)
    select oi, dj, {_r('flow', 4)} as flow, oi % 3 = 0 and dj % 3 = 0 as both_priority from u""")
def od_flagged(spark, d):
    """GRV-8, S5: flags from a rank table's share where the zone has none of its own."""
    z = zones(spark, d)
    flags = od.priority_flags(z.withColumn("share_selected", F.when(F.col("code") % 2 == 0, (F.col("code") % 3 == 0).cast("double"))), z.select("code", (F.col("code") % 3 == 0).cast("double").alias("share_selected")))
    flows = od.gravity(z).withColumn("flow", np_round("flow", 6))
    return rounded(report.table_s5(flows, flags=flags).select("oi", "dj", "flow", "both_priority"), 4)


_IPF = P.with_(od_ipf=True, od_cutoff_km=None, od_lambda=0.0002)


@query(f"""with recursive {ZONES}, goal as (select code, mass * 1e6 / sum(mass) over () as t from z), f0 as (select a.code as oi, b.code as dj, {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} as dist_km, a.mass * b.mass * exp(-0.0002::double * dist_km) as w from z a, z b), turn(i, oi, dj, w) as (
    select 0, oi, dj, w from f0 union all select i + 1, oi, dj, case when sc > 0 then w * tc / sc else w end from (select *, sum(w) over (partition by dj) as sc from (
    select i, oi, dj, case when sr > 0 then turn_w * tr / sr else turn_w end as w, tc from (select i, oi, dj, turn.w as turn_w, sum(turn.w) over (partition by oi) as sr, a.t as tr, b.t as tc from turn join goal a on a.code = oi join goal b on b.code = dj where i < 60))))
    select oi, dj, {_r('turn.w', 3)} as flow from turn where i = 60""")
def od_ipf(spark, d):
    """GRV-3 to convergence."""
    return rounded(od.gravity(zones(spark, d), _IPF).select("oi", "dj", "flow"), 3)


@query(f"""with {_gravity()}, o as (select oi as code, sum(flow) as a from f group by 1), i as (select dj as code, sum(flow) as b from f group by 1)
    select code, n_name, {_r('a', 3)} as out_flow, {_r('b', 3)} as in_flow, {_r('a + b', 3)} as throughput from z join o using (code) join i using (code)""")
def movement_view(spark, d):
    z = zones(spark, d)
    return rounded(report.movement_view(od.gravity(z), z.select("code", "n_name")), 3)


# distances ---------------------------------------------------------------------------------------------------------------


@query(f"""{WITH}{_components(EIGHT)}, cen as (select root, avg(x) as cx, avg(y) as cy from comp join g using ("row", col) group by 1 having count(*) >= 3), {SITES}, n as (select site_id, min({_hav('lon', 'lat', 'cx', 'cy')}) as km from p, cen group by 1)
    select site_id, {_r('km')} as km, km <= 2 as within_radius from n""")
def cluster_distance(spark, d):
    c = _chosen(spark, d).filter("selected = 1")
    labelled = cluster.prune(c.join(cluster.connected_components(c, 8), ["aoi", "row", "col"]), 3, 0.0)
    out = distance.within_nearest(sites(spark, d), zonal.centroids(labelled), 2.0, "site_id")
    return rounded(out.select("site_id", F.col("dist_km_nearest_cluster").alias("km"), "within_radius"))


@query(f"with {CELLS}, {SITES} select site_id, p.\"row\", p.col, veg, rwi from p left join g on g.\"row\" = p.\"row\" and g.col = p.col")
def sampled_points(spark, d):
    return distance.sample_points(sites(spark, d), cells(spark, d), ["veg", "rwi"])


@query("select s_suppkey, n_name from supplier left join (select n_name, row_number() over (order by n_nationkey) as k from nation) on k = s_suppkey % 30")
def metadata_by_position(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 30).alias("k"))
    return distance.by_position(s, table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "k").select("s_suppkey", "n_name")


@query(f"""with recursive {SITES}, {_inverse("select site_id as oi, row_number() over () as dj, p.lon as x1, p.lat as y1, q.lon as x2, q.lat as y2 from p, q where layer = 'gov'", 12)}
    select oi as site_id, {_r("min(km)", 1)} as dist_km_nearest_gov, count(*) filter (km <= 1) as count_gov_le1km, {_r(_hav('13.2344::double', '-8.8383::double', 'any_value(lon)', 'any_value(lat)'))} as capital_km from geodesic join p on p.site_id = oi group by 1""")
def synergy_table(spark, d):
    """Q13 by the geodesic, with SRC-10."""
    s = steps.synergies(sites(spark, d), targets(spark, d), ["gov"], P.with_(radii_km=(1.0,)))
    capital = readers.inline_points(spark, [{"name": "capital", "lon": 13.2344, "lat": -8.8383}]).first()
    s = report.to_reference_point(s, capital.lon, capital.lat, "capital_km")
    return s.select("site_id", "dist_km_nearest_gov", "count_gov_le1km", np_round("capital_km", 6).alias("capital_km"))


# tables ------------------------------------------------------------------------------------------------------------------


@query(f"with {WIDE}, x as (select balance__AUTOMOBILE as a, balance__BUILDING as b from w) select {_r('corr(a, b)')} as r, null::double as flat from x where a is not null and b is not null")
def shortlist_correlation(spark, d):
    w = _wide(spark, d).withColumn("one", F.lit(1.0))
    r, flat = report.simple_correlation(w, "balance__AUTOMOBILE", "balance__BUILDING"), report.simple_correlation(w, "balance__AUTOMOBILE", "one")
    return rounded(spark.createDataFrame([(r, flat)], "r double, flat double"))


@query("select c_nationkey as ADM2CD_c, 'x' as theme, c_mktsegment as var, round_even(avg(c_acctbal) * 1e6, 0) / 1e6 as value from customer group by 1, 3")
def duplicates_averaged(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("ADM2CD_c"), F.lit("x").alias("theme"), F.col("c_mktsegment").alias("var"), F.col("c_acctbal").alias("value"))
    return rounded(tabular.mean_of_duplicates(c))


@query(f"with {CELLS}, k as (select sum(pop) as p, sum(crop_frac) as c, sum(pop) filter (travel_min <= 30) as p30, sum(crop_frac) filter (travel_min <= 30) as c30 from g) select {_r('p', 2)} as pop_total, {_r('c', 2)} as cropland_total_km2 from k")
def totals_inverted(spark, d):
    """AGG-26: totals from parts and percentages."""
    return rounded(report.totals_from_kpis(zonal.isochrone_kpis(cells(spark, d), P.iso_thresholds, 1.0)), 2)


@query(f"""with {CELLS}, s as (select count(distinct zone_id) as c, sum(area_km2) as a, sum(pop) as p, sum(crop_frac * area_km2) as f, sum(crop_frac) as t from g)
    select c as clusters, {_r('a', 3)} as area_km2, {_r('p', 3)} as pop, {_r('f', 3)} as cropland_km2, {_r('p / a', 3)} as pop_per_km2, {_r('f / a', 3)} as cropland_share, 100.0::double as pop_pct, {_r('100 * f / t', 3)} as cropland_pct from s""")
def table_s1_totals(spark, d):
    c = zonal.cluster_pack(cells(spark, d).withColumns({"cluster_id": "zone_id", "risk": F.lit(0.0)}))
    return rounded(report.table_s1(c, report.totals_from_kpis(zonal.isochrone_kpis(cells(spark, d), P.iso_thresholds, 1.0))), 3)


@query("select o_orderpriority, count(*) as n from orders group by 1")
def counted_values(spark, d):
    return zonal.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("""select c_nationkey as ADM2CD_c, 'a' as theme, var, max(v) as value from (select c_nationkey, 'bal' as var, null::double as v from customer union all select c_nationkey, 'n', 1.0::double from customer) group by 1, 3
    union all select n_nationkey, 'b', 'region', n_regionkey::double from nation""")
def themes_ingested(spark, d):
    """SRC-8, SET-1, FLT-9, PRJ-22: text that is no number is null; a skipped theme is absent."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("ADM2CD_c")).distinct().withColumns({"bal": F.lit("n/a"), "n": F.lit(" 1.0 ")})
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("ADM2CD_c"), F.col("n_regionkey").alias("region"))
    return tabular.ingest_themes({"a": a, "b": b, "c": b}, skip=("c",), keys=("ADM2CD_c",)).select("ADM2CD_c", "theme", "var", "value")


@query("select n_nationkey as ADM2CD_c, n_regionkey / 100.0::double as share, n_regionkey * 60.0::double as minutes from nation")
def units_normalised(spark, d):
    """PRJ-20, PRJ-21, SET-3: renamed, percent to shares, hours to minutes, unnamed and empty columns dropped."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("ADM2CD_c"), F.col("n_regionkey").cast("string").alias("p"), F.col("n_regionkey").alias("h"), F.lit(None).cast("double").alias("e"), F.lit("x").alias("note"))
    named = tabular.rename_columns(n, {"p": "share", "h": "hours", "e": "empty"}, ("ADM2CD_c",))
    return tabular.drop_empty_columns(tabular.normalize_units(named, ["share"], {"hours": "minutes"}), ("ADM2CD_c",))


@query("""with b as (select n_name as adm2code, n_nationkey as muni_n_af from nation), m as (select c_nationkey as k, avg(c_acctbal) as v from customer group by 1)
    select adm2code, muni_n_af, round_even(v * 1e6, 0) / 1e6 as data1, case when muni_n_af < 3 then 7.0::double end as data2 from b left join m on k = muni_n_af""")
def code_maps(spark, d):
    """JON-7, JON-8: maps put on the codes in numeric order, a code's first row counts."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("adm2code"), F.col("n_nationkey").alias("muni_n_af"))
    base = n.unionByName(n.withColumn("muni_n_af", F.col("muni_n_af") + 100))
    one = table(spark, d, "customer").select(F.col("c_nationkey").alias("muni_n_af"), F.lit("x").alias("variable"), F.col("c_acctbal").cast("string").alias("value"))
    two = n.filter("muni_n_af < 3").select("muni_n_af", F.lit("y").alias("variable"), F.lit("7").alias("value"))
    return rounded(tabular.code_maps(base, {2: two, 1: one}))


@query("select o_custkey, o_orderkey, row_number() over (order by case when o_custkey % 7 <> 0 then o_custkey end desc nulls last, o_orderkey nulls last) as k from orders qualify k <= 100")
def sorted_nulls_last(spark, d):
    """SET-4: the first hundred of a report."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("s"))
    rows = filters.sort_nulls_last(o, ("s", True), ("o_orderkey", False)).limit(100)
    return rows.select("o_custkey", "o_orderkey", (F.monotonically_increasing_id() + 1).alias("k"))


@query("select c_custkey, 'C''s \\ ' || c_mktsegment as q from customer")
def quoted_text(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr(f"concat({num.quote_literal(chr(67) + chr(39) + 's ' + chr(92) + ' ')}, c_mktsegment)").alias("q"))


# checks ------------------------------------------------------------------------------------------------------------------


@query("""select 'orders:required' as "check", true as ok, '' as detail union all select 'orders:required', false, 'o_nothing' union all select 'MAP_3.csv:required', false, 'variable,value' union all select 'base.csv:required', true, ''""")
def column_checks(spark, d):
    """VAL-1, VAL-11."""
    o, n = table(spark, d, "orders"), table(spark, d, "nation")
    raw = n.select(F.col("n_name").alias("adm2code"), F.col("n_nationkey").alias("muni_n_af"))
    out = validate.required_columns(o, ["o_orderkey"], "orders").unionByName(validate.required_columns(o, ["o_orderkey", "o_nothing"], "orders"))
    return out.unionByName(validate.survey_inputs({"MAP_3.csv": raw, "base.csv": raw, "notes.txt": raw}))


@query(f"""with {CELLS} select 'grid:a' as "check", true as ok, '40x40' as detail union all select 'grid:b', false, '80x80' union all select 'layer:veg', true, min(veg)::varchar || '..' || max(veg)::varchar from g""")
def grid_diagnostics(spark, d):
    return validate.grid_checks(spark, {"a": SPEC, "b": SPEC.supersampled(2)}, cells(spark, d), ["veg"])


# sources and sinks: written, found, read back -----------------------------------------------------------------------------

_NATION = "select n_nationkey, n_name, n_regionkey from nation"


@query(_NATION)
def csv_round_trip(spark, d):
    """SNK-3, SNK-7, SRC-4, SRC-5, SRC-6."""
    root = folder(spark)
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.write_csv(n, sinks.out_path(root, "aoi", "nation", ".csv"))
    found = readers.first_existing(spark, [f"{root}/none.csv", *readers.discover(spark, [f"{root}/zzz*", f"{root}/aoi_*.csv"])])
    return readers.read_csv(spark, found, n.schema)


@query("select n_nationkey, n_name from nation")
def sniffed_csv(spark, d):
    """SRC-7: delimiter and encoding told from the file."""
    path = folder(spark) + "/semicolons"
    table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    out = readers.read_csv_auto(spark, readers.discover(spark, [f"{path}/part-*"])[0])
    return out.select(F.col("n_nationkey").cast("int"), "n_name") if dict(table(spark, d, "nation").dtypes)["n_nationkey"] == "int" else out.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("select 'EPSG:4326' as crs, 40::bigint as height, true as there, true as none, 0::bigint as empty_rows")
def sidecar_round_trip(spark, d):
    """SNK-1, SNK-4, SNK-5, SRC-3, SRC-9: a grid's sidecar, an optional table that is missing, an empty table."""
    from gridloom.schema import FEATURES

    root = folder(spark)
    sinks.write_cells(cells(spark, d), f"{root}/cells", SPEC)
    sinks.write_empty(spark, FEATURES, f"{root}/empty")
    side = readers.read_json(spark, f"{root}/cells.geo.json")
    empty = spark.read.option("header", True).csv(f"{root}/empty").count()
    return side.select("crs", F.col("shape")[0].alias("height"), F.lit(readers.exists(spark, f"{root}/cells")).alias("there"), F.lit(readers.read_optional(spark, f"{root}/nothing") is None).alias("none"), F.lit(empty).cast("long").alias("empty_rows"))


@query(f"with {_IN_AOI} select \"row\", col, case when in_aoi then veg end as veg from a")
def masked_round_trip(spark, d):
    """SNK-2, SRC-1: a grid table, masked as it is written."""
    path = folder(spark) + "/masked"
    sinks.write_masked(raster.aoi_mask(cells(spark, d), _boxes(spark, d), SPEC), ["veg"], path, SPEC)
    return readers.read_cells(spark, path, "aoi").select("row", "col", "veg")


@query(f"with {CELLS} select \"row\", col, n::double as value from g")
def ascii_round_trip(spark, d):
    """SRC-1: an ASCII raster."""
    path = folder(spark) + "/grid.asc"
    lines = cells(spark, d).groupBy("row").agg(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.coalesce(F.map_from_entries(F.collect_list(F.struct("col", "n")))[i], F.lit(-9999)).cast("string")), " ").alias("line"))
    head = spark.createDataFrame([(i - 6, x) for i, x in enumerate(("ncols 40", "nrows 40", "xllcorner 10", "yllcorner -10", "cellsize 1", "NODATA_value -9999"))], "row int, line string")
    lines.unionByName(head).repartition(1).sortWithinPartitions("row").select("line").write.text(path)
    out, header = readers.read_ascii_grid(spark, readers.discover(spark, [f"{path}/part-*"])[0])
    return out.filter(F.lit(header["ncols"] == 40))


@query(f"with {CELLS} select \"row\", col, n::double as value, 40 as height, 'EPSG:4326' as crs from g")
def geotiff_round_trip(spark, d):
    """SRC-1, SNK-1: a GeoTIFF file written and read."""
    path = folder(spark) + "/grid.tif"
    geofiles.write_geotiff(cells(spark, d), "n", path, SPEC)
    out, spec = geofiles.read_geotiff(spark, path)
    return out.select("row", "col", "value", F.lit(spec.height).alias("height"), F.lit(spec.crs).alias("crs"))


@query(f"""with {CELLS} select "row", col, {_r('radians(x) * 6378137.0', 3)} as east, {_r('ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0', 3)} as north, {_r('x')} as lon, {_r('y')} as lat from g""")
def projected_cells(spark, d):
    """GEO-3: cell centres in Web Mercator, and taken to a UTM zone and back."""
    c = cells(spark, d)
    east, north = projection.transform_xy("x", "y", "EPSG:4326", "EPSG:3857")
    lon, lat = projection.transform_xy(*projection.transform_xy("x", "y", "EPSG:4326", "EPSG:32635"), "EPSG:32635")
    return c.select("row", "col", np_round(east, 3).alias("east"), np_round(north, 3).alias("north"), np_round(lon, 6).alias("lon"), np_round(lat, 6).alias("lat"))


@query(f"with {BOXES} select k::bigint as feature_id, 'polygon' as kind, 'primary' as fclass, k::double as value, 4 as vertices, {_r('x1', 7)} as x, {_r('y1', 7)} as y from box")
def geojson_round_trip(spark, d):
    """SRC-2: features of a GeoJSON document."""
    path = folder(spark) + "/boxes.geojson"
    ring = F.transform(F.col("parts")[0], lambda v: F.array(v["x"], v["y"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("fclass"), F.col("value").alias("v")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    features = _boxes(spark, d).select(F.col("feature_id"), feature.alias("f")).groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("feature_id", "f"))), lambda x: x["f"]).alias("features"))  # 25 nations
    features.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(path)
    out = readers.read_geojson(spark, readers.discover(spark, [f"{path}/part-*"])[0], "v")
    first = F.col("parts")[0][0]
    return out.select("feature_id", "kind", "fclass", "value", F.size(F.col("parts")[0]).alias("vertices"), np_round(first["x"], 7).alias("x"), np_round(first["y"], 7).alias("y"))


@query("""select 'n_nationkey' as "column", count(*) as "rows", count(distinct n_nationkey) as "distinct" from nation union all select 'n_name', count(*), count(distinct n_name) from nation""")
def profile_round_trip(spark, d):
    """SNK-8."""
    path = folder(spark) + "/profile"
    sinks.write_profile(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.json(path).select("column", "rows", "distinct")

