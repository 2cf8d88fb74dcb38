"""Queries that run whole steps of the workload over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.numeric import np_round
from gridloom.operators import grid, raster, scenario, validate
from gridloom.operators.grid import GridSpec
from gridloom.params import COMPONENTS
from gridloom.plans import oracles, steps
from gridloom.plans.analogues import SPEC, STEP, SWEEP, P, _boxes, cells, rounded, sites, table
from gridloom.plans.oracles import BOXES, CELLS, SITES, _hav, _i, _r
from gridloom.plans.pieces import _LINES, _MASSED, _TILTED, _minutes, _roads, _tilted, folder
from gridloom.sources import geofiles, readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


_X0, _Y0 = f"(10.0::double - {STEP}::double / 2)", f"(-10.0::double + {STEP}::double / 2)"
_BIG = GridSpec(SPEC.x0, SPEC.y0, STEP * 5, STEP * 5, 8, 8)


def _inside(share: int) -> str:
    """Centres of the 8 x 8 grid's cells, or of their parts, that lie in a box: box k, row, col of the part."""
    return f"""select k, r, c from box, range({8 * share}) a(r), range({8 * share}) b(c) where {_X0} + (c + 0.5) * ({STEP}::double * 5 / {share}) >= x1 and {_X0} + (c + 0.5) * ({STEP}::double * 5 / {share}) < x1 + w
        and {_Y0} - (r + 0.5) * ({STEP}::double * 5 / {share}) < y1 and {_Y0} - (r + 0.5) * ({STEP}::double * 5 / {share}) >= y1 - h"""


@query(f"""with {CELLS}, {BOXES}, cell as (select r, c from range(8) a(r), range(8) b(c)), flood as (select "row" // 5 as r, col // 5 as c, max(flood_max) as hi, sum((flood_max >= 0.3)::int)::double / count(*) as wet from g group by 1, 2),
    crop as (select r // 10 as r, c // 10 as c, count(*) / 100.0::double as share from (select distinct r, c from ({_inside(10)}) where k % 2 = 0) group by 1, 2), hit as ({_inside(1)}),
    top as (select r, c, max(k) filter (k % 3 = 1) as elec, max(k) filter (k % 3 = 2) as urban, max(k) filter (k % 3 = 0) as rural, arg_max(lab, k) as zone from hit join (select n_nationkey as nk, row_number() over (order by n_name) as lab from nation) on nk = k group by 1, 2)
    select {_i('cell.r')} as "row", {_i('cell.c')} as col, g.pop, g.veg, flood.hi as flood_max, {_r('flood.wet')} as flood_frac, coalesce(crop.share, 0) as crop_frac, case when top.elec is not null then 1.0::double else 0.0::double end as elec,
        case when top.urban is not null then 1.0::double else 0.0::double end as urban, case when top.rural is not null then 1.0::double else 0.0::double end as rural, {_i('top.zone')} as zone_id
    from cell left join g on g."row" = cell.r * 5 + 2 and g.col = cell.c * 5 + 2 left join flood using (r, c) left join crop using (r, c) left join top using (r, c)""")
def build_base(spark, d):
    """Q00: layers of the fine grid and polygons of all kinds on cells five times as wide."""
    c = cells(spark, d)
    layer = lambda name: c.select("row", "col", F.col(name).alias("value"))
    boxes = _boxes(spark, d)
    k = F.col("feature_id")
    polygons = {"cropland": boxes.filter(k % 2 == 0), "elec": boxes.withColumn("value", F.when(k % 3 == 1, 1.0).otherwise(0.0)), "urban": boxes.withColumn("value", F.when(k % 3 == 2, 2.0).when(k % 3 == 0, 0.0).otherwise(1.0))}
    named = boxes.join(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("feature_id"), F.col("n_name").alias("adm2")), "feature_id")
    base, _ = steps.build_base(spark, _BIG, {"pop": (layer("pop"), SPEC, "nearest"), "veg": (layer("veg"), SPEC, "nearest"), "flood": (layer("flood_max"), SPEC, "max")}, polygons, named)
    return rounded(base.select("row", "col", "pop", "veg", "flood_max", "flood_frac", "crop_frac", "elec", "urban", "rural", "zone_id"))


@query(f"""with {CELLS}, {SITES}, spot as (select site_id, lon, lat, {_i(f'floor(({_Y0} - lat) / {STEP}::double)')} as r, {_i(f'floor((lon - {_X0}) / {STEP}::double)')} as c from p),
    disk as (select site_id, sum((crop_frac > 0)::int) as crop_cells, sum(crop_frac) as crop_km2, sum((elec > 0.5)::int) as elec_cells, count(*) as held from spot join g on pow("row" - r, 2) + pow(col - c, 2) <= 25 where r between 0 and 39 and c between 0 and 39 group by 1)
    select site_id, {_r('lon', 9)} as lon, {_r('lat', 9)} as lat, r as "row", c as col, travel_min, veg as veg_index, ntl, drought as drought_pct, coalesce(crop_cells, 0)::bigint as cropland_cells_5km, {_r('coalesce(crop_km2, 0)')} as cropland_km2_5km,
        coalesce(elec_cells, 0)::bigint as electrified_cells_5km, {_r('elec_cells / nullif(held, 0)')} as electrified_share_5km, {_i('(road > 0.5)::int')} as near_road_flag
    from spot left join g on g."row" = r and g.col = c left join disk using (site_id) where r between 0 and 39 and c between 0 and 39""")
def site_audit(spark, d):
    """Q05."""
    out = steps.site_audit(sites(spark, d), cells(spark, d), SPEC)
    out = out.select(*(np_round(c, 9).alias(c) if c in ("lon", "lat") else F.col(c) for c in out.columns))
    return out.withColumns({"cropland_km2_5km": np_round("cropland_km2_5km", 6), "electrified_share_5km": np_round("electrified_share_5km", 6), "cropland_cells_5km": F.col("cropland_cells_5km").cast("long"), "electrified_cells_5km": F.col("electrified_cells_5km").cast("long")})


#: Themes: what customers of a nation hold (poverty), how its suppliers stand (traveltime).
_THEMES = """long as (select c_nationkey as ADM2CD_c, 'poverty' as theme, 'rural' as var, avg(c_acctbal) as value from customer group by 1 union all select c_nationkey, 'poverty', 'people', count(*)::double from customer group by 1
    union all select s_nationkey, 'traveltime', 'market', avg(s_acctbal) from supplier group by 1), wide as (select ADM2CD_c, max(value) filter (var = 'rural') as rural, max(value) filter (var = 'people') as people, max(value) filter (var = 'market') as market from long group by 1)"""


def _ingested(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    people = c.groupBy("c_nationkey").agg(F.count("*").cast("double").alias("people"))
    # balances stand in many rows a nation, which the step averages
    poverty = c.select(F.col("c_nationkey").alias("ADM2CD_c"), F.col("c_acctbal").cast("string").alias("rural")).unionByName(people.select(F.col("c_nationkey").alias("ADM2CD_c"), F.col("people")), allowMissingColumns=True)
    time = s.select(F.col("s_nationkey").alias("ADM2CD_c"), F.col("s_acctbal").alias("market"), F.lit(None).cast("double").alias("nothing"))
    return steps.muni_ingest({"poverty": poverty, "traveltime": time, "left_out": time}, "poverty__rural", ("left_out",))


@query(f"""with {_THEMES} select 'poverty' as theme, 'people' as var, {_r('corr(people, rural)')} as r, count(*) filter (people is not null and rural is not null) as n from wide
    union all select 'traveltime', 'market', {_r('corr(market, rural)')}, count(*) filter (market is not null and rural is not null) from wide""")
def muni_ingest(spark, d):
    """Q06, its correlations."""
    _, corr, _ = _ingested(spark, d)
    return rounded(corr.select("theme", "var", "r", "n"))


@query(f"""with {_THEMES}, ranked as (select *, row_number() over (order by rural nulls last, ADM2CD_c) as k, count(rural) over () as n from wide)
    select ADM2CD_c, {_r('rural')} as poverty__rural, {_r('people')} as poverty__people, {_r('market')} as traveltime__market, case when rural is not null then {_i('least(5, greatest(1, ceil((k - 1) * 5.0 / (n - 1))))')} end as poverty_quintile from ranked""")
def muni_profiles(spark, d):
    """Q06, its profiles: indicators and the quintile of poverty."""
    _, _, profiles = _ingested(spark, d)
    return rounded(profiles.select("ADM2CD_c", "poverty__rural", "poverty__people", "traveltime__market", "poverty_quintile"))


_RADII = (2.0, 5.0)
_METRICS = {"denom_cells": "count(*)", "pop": "sum(pop)", "hh": "sum(pop / 5.0)", "poorest_hh": "sum(pop / 5.0 * pov)", "ag_km2": "sum(crop_frac * area_km2)", "pct_electrified": "1.0::double * count(*) filter (elec > 0.5) / count(*)", "pct_rural": "1.0::double * count(*) filter (rural > 0.5) / count(*)", "pct_priority": "1.0::double * count(*) filter (veg > 0.9) / count(*)", "risk_roadcells": "count(*) filter (road * flood_frac > 0.5)"}
_COUNTS = ("denom_cells", "risk_roadcells")


@query(f"""with {CELLS}, {SITES}, d as (select site_id, g.*, {_hav('p.lon', 'p.lat', 'g.x', 'g.y')} as d from p, g), k as (select site_id, r, {', '.join(f"{v if m in _COUNTS else _r(v, 3)} as {m}" for m, v in _METRICS.items())} from d, (select unnest([2.0::double, 5.0]) as r) where d <= r group by 1, 2)
    select site_id as project_id, {', '.join(f"max({m}) filter (r = {r}) as {m}_{r:g}km" for r in _RADII for m in _METRICS)}, {_r(_hav('13.2344::double', '-8.8383::double', 'any_value(lon)', 'any_value(lat)'), 3)} as dist_km_to_capital from p left join k using (site_id) group by 1""")
def project_kpis(spark, d):
    """Q08: all metrics at all radii, one row a project."""
    c = cells(spark, d).select("x", "y", "area_km2", "pop", "crop_frac", F.col("pov").alias("poverty"), "elec", "rural", F.when(F.col("veg") > 0.9, 1.0).alias("priority"), F.when(F.col("road") * F.col("flood_frac") > 0.5, 1.0).alias("risk"))
    projects = sites(spark, d).select(F.col("site_id").alias("project_id"), "lon", "lat")
    return rounded(steps.project_kpis(projects, c, P.with_(radii_km=_RADII), ("capital", 13.2344, -8.8383)).drop("lon", "lat"), 3)


def _parameters() -> str:
    rows = []
    for sc in SWEEP:
        p = sc.params(P)
        figures = [f"{float(p.weights.get(c, 0.0))}::double" for c in COMPONENTS] + [str(p.mask_require_rural).lower(), f"{p.mask_min_cropland}::double", f"{p.top_pct_cells / 100}::double", "null::double" if p.top_km2 is None else f"{p.top_km2}::double", str(p.min_cluster_cells), str(p.smooth_radius)]
        rows.append(f"('{sc.scenario_id}', '{sc.desc}', '{sc.scenario_id}', '{tuple(p.use_components)}', {', '.join(figures)})")
    return f"(values {', '.join(rows)}) t(scenario_id, \"desc\", id, USE_COMPONENTS, W_ACC, W_POP, W_VEG, W_NTL, W_DRT, MASK_REQUIRE_RURAL, MASK_MIN_CROPLAND, TOP_PCT_CELLS, TOP_KM2, MIN_CLUSTER_CELLS, SMOOTH_RADIUS)"


@query(f"select * from ({oracles._sweep(4)}) join {_parameters()} using (scenario_id)")
def sweep_table(spark, d):
    """Q10: the published table, metrics beside parameters."""
    return scenario.sweep(cells(spark, d), P, SWEEP)


_STEP_MINUTES = _minutes('select n_nationkey as site_id, n_nationkey * 13 % 40 as "row", n_nationkey * 7 % 40 as col from nation').replace('select "row", col, case when road > 0 then 1.5::double else 15.0::double end as f from g', 'select "row", col, 60.0::double / coalesce(greatest(kmh, 4.0), 4.0) as f from g left join fast using ("row", col)').replace(", land as (", f", {_LINES}, land as (", 1)


@query(f"""with recursive {_STEP_MINUTES}, k as (select site_id, t as thresh_min, g.*, minutes from minutes join g using ("row", col), (select unnest([30.0::double, 60, 120, 240]) as t) where minutes <= t)
    select site_id, thresh_min, {_r('sum(area_km2)', 3)} as area_km2, {_r('sum(pop)', 3)} as pop, {_r('sum(crop_frac * area_km2)', 3)} as cropland_km2, {_r('avg(rwi)', 9)} as rwi_mean, {_r('sum(rwi * pop) / sum(pop)', 5)} as rwi_pop_weighted,
    {_r('avg(minutes)', 3)} as mean_travel_min from k group by 1, 2""")
def catchments(spark, d):
    """Q12: roads to friction, minutes from each site, catchment table."""
    k = F.col("n_nationkey")
    at = table(spark, d, "nation").select(k.alias("site_id"), (F.lit(10.0) + (k * 7 % 40) * STEP).alias("lon"), (F.lit(-10.0) - (k * 13 % 40) * STEP).alias("lat"))
    _, out = steps.catchments(at, cells(spark, d), _roads(spark, d), SPEC, P)
    digits = {"rwi_mean": 9, "rwi_pop_weighted": 5}
    return out.select("site_id", "thresh_min", *(np_round(c, digits.get(c, 3)).alias(c) for c in ("area_km2", "pop", "cropland_km2", "rwi_mean", "rwi_pop_weighted", "mean_travel_min")))


@query(f"""with {_MASSED}, pair as (select a.code as oi, b.code as dj, pow(a.tilted, 0.9) * pow(b.tilted, 1.1) as m, {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} as dist_km, a.tilted as o_mass from y a, y b),
    r as (select *, case when dist_km > 1500 then 0 else m * pow(1 + dist_km, -1.5) end as raw from pair)
    select oi, dj, {_r('raw * 1e6 / sum(raw) over ()', 4)} as flow, {_r('dist_km', 4)} as dist_km, {_r('o_mass', 4)} as o_mass, n as agents from r, (select count(*) * count(*) as n from nation)""")
def od_model(spark, d):
    """Q14: mass, flows, attributes and agents from one call."""
    z = _tilted(spark, d).drop("mass")
    flows, attributes, agents = steps.od_model(z, _TILTED)
    out = flows.join(attributes.select(F.col("code").alias("oi"), F.col("mass").alias("o_mass")), "oi")
    return rounded(out.withColumn("agents", F.lit(agents.count()).cast("long")).select("oi", "dj", "flow", "dist_km", "o_mass", "agents"), 4)


@query(f"""with {CELLS}, v as (select n_nationkey + 1 as zone_id, n_regionkey::double as region, avg(c_acctbal) as balance from nation left join customer on c_nationkey = n_nationkey group by 1, 2)
    select "row", col, zone_id, case when region < 4 then region end as region, {_r('balance')} as balance from g left join v using (zone_id)""")
def zone_indicators(spark, d):
    """RST-7: indicators of zones as layers; NaN is no value."""
    n = table(spark, d, "nation").join(table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("balance")), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    values = n.select((F.col("n_nationkey") + 1).cast("int").alias("zone_id"), F.when(F.col("n_regionkey") == 4, float("nan")).otherwise(F.col("n_regionkey").cast("double")).alias("region"), "balance")
    return rounded(raster.indicator_layers(cells(spark, d).select("row", "col", "zone_id"), values, ["region", "balance"]).select("row", "col", "zone_id", "region", "balance"))


@query(f"""with {CELLS} select {_i('"row" * 2 + i')} as "row", {_i('col * 2 + j')} as col, veg, {_r(f'{_X0} + (col * 2 + j + 0.5) * {STEP}::double / 2', 9)} as x, 1.0::double as area_km2, false as same, true as alike from g, range(2) a(i), range(2) b(j) where veg is not null""")
def supersampled_grid(spark, d):
    """GRD-4, GRD-6, GRD-8: a layer on cells half as wide, each of the constant area estimate; whether the specs agree."""
    fine = SPEC.supersampled(2)
    c = grid.template_cells(spark, fine, "constant")
    values = grid.align(cells(spark, d).select("row", "col", F.col("veg").alias("value")), SPEC, c, fine, "nearest").filter("value is not null")
    near = GridSpec(SPEC.x0 + 1e-12, SPEC.y0, STEP, STEP, 40, 40, "epsg:4326")
    out = values.join(c.select("row", "col", "x", "area_km2"), ["row", "col"]).select("row", "col", F.col("value").alias("veg"), "x", "area_km2")
    return rounded(out.withColumns({"same": F.lit(SPEC.same_grid(fine)), "alike": F.lit(SPEC.same_grid(near))}), 9)


_MENU = ("region", "nation", "supplier", "part", "customer")


@query(" union all ".join([*(f"select '{t}' as theme, true as \"exists\", true as has_bytes, (select string_agg(column_name, ',' order by column_index) from duckdb_columns() where table_name = '{t}' and not internal) as variables, count(*) as \"rows\" from {t}" for t in _MENU), "select 'nowhere', false, false, null, null"]))
def file_inventory(spark, d):
    """VAL-7, VAL-9: the data menu: which tables are there, what they hold and how much."""
    menu = validate.data_menu(spark, {t: f"{d}/{t}.parquet" for t in (*_MENU, "nowhere")})
    return menu.select("theme", "exists", (F.col("bytes") > 0).alias("has_bytes"), "variables", "rows")


_FILE = "case p_partkey % 4 when 0 then 'MAP_' || p_size || '.csv' when 1 then 'adm2_' || p_size || '.csv' when 2 then 'Base ' || p_brand || '.csv' else 'notes ' || p_size || '.txt' end"


@query(f"""select {_FILE} as file, case p_partkey % 4 when 0 then 'map' when 1 then 'adm2' when 2 then 'base' else 'other' end as kind, case when p_partkey % 4 = 0 then {_i('p_size')} end as number, count(*) as parts from part group by all""")
def file_kinds(spark, d):
    """VAL-12 over names made of the parts' attributes."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("MAP_"), "p_size", F.lit(".csv"))).when(k == 1, F.concat(F.lit("adm2_"), "p_size", F.lit(".csv"))).when(k == 2, F.concat(F.lit("Base "), "p_brand", F.lit(".csv"))).otherwise(F.concat(F.lit("notes "), "p_size", F.lit(".txt")))
    files = table(spark, d, "part").groupBy(name.alias("file")).agg(F.count("*").alias("parts"))
    return validate.classify_files(files).select("file", "kind", "number", "parts")


@query("select n_name || ' é ü' as name, 'a|b;c' as note, n_nationkey::bigint as k, sep from nation, (select unnest([';', chr(9), '|']) as sep)")
def sniffed_encodings(spark, d):
    """SRC-7: three delimiters, in Latin-1, which is no UTF-8."""
    root = folder(spark)
    n = table(spark, d, "nation").select(F.concat("n_name", F.lit(" é ü")).alias("name"), F.lit("a|b;c").alias("note"), F.col("n_nationkey").alias("k"))
    out = None
    for i, sep in enumerate((";", "\t", "|")):
        n.coalesce(1).write.option("header", True).option("sep", sep).option("encoding", "ISO-8859-1").option("quoteAll", True).csv(f"{root}/{i}")
        part = readers.read_csv_auto(spark, readers.discover(spark, [f"{root}/{i}/part-*"])[0]).select("name", "note", F.col("k").cast("long").alias("k"), F.lit(sep).alias("sep"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"with {BOXES} select k::bigint as feature_id, 'polygon' as kind, k::double as value, {_r('x1', 7)} as x, {_r('y1', 7)} as y, {_r('x1 + w', 7)} as x2, {_r('y1 - h', 7)} as y2 from box")
def shapefile_round_trip(spark, d):
    """SRC-2: boxes written as a shapefile and read."""
    path = folder(spark) + "/boxes.shp"
    geofiles.write_shapefile(_boxes(spark, d).select("feature_id", "kind", "value", "parts"), path, ["feature_id", "value"])
    out = geofiles.read_shapefile(spark, path, "value")
    x, y = F.transform(F.col("parts")[0], lambda v: v["x"]), F.transform(F.col("parts")[0], lambda v: v["y"])
    return rounded(out.select(F.get_json_object("properties", "$.feature_id").cast("double").cast("long").alias("feature_id"), "kind", "value", F.array_min(x).alias("x"), F.array_max(y).alias("y"), F.array_max(x).alias("x2"), F.array_min(y).alias("y2")), 7)


@query("select c_custkey::bigint as site_id, case when c_acctbal > 0 then c_acctbal end as lon, 0.0::double as lat from customer")
def locked_schema(spark, d):
    """SET-10: a result brought to its schema: order, types, a missing column's default, text that is no number."""
    from gridloom.schema import _schema, enforce_schema

    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("extra"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("lon"), F.col("c_custkey").cast("string").alias("site_id"))
    return enforce_schema(c, _schema("site_id bigint, lon double, lat double"), {"lat": 0.0})


_REPORT = ("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"""select 'json' as part, c as "column", n::varchar as figure from (select count(distinct o_orderkey) as o_orderkey, count(distinct o_orderstatus) as o_orderstatus, count(distinct o_totalprice) as o_totalprice from orders) unpivot (n for c in ({', '.join(_REPORT)}))
    union all select 'columns', c, (row_number() over ())::varchar from (select unnest({list(_REPORT)}) as c) union all select 'text', 'rows', 'rows: ' || count(*) from orders""")
def profile_report(spark, d):
    """SNK-8: the report's JSON, column list and text."""
    path = folder(spark) + "/report"
    sinks.write_report(table(spark, d, "orders").select(*_REPORT), path)
    as_json = spark.read.json(f"{path}/profile.json").select(F.lit("json").alias("part"), "column", F.col("distinct").cast("string").alias("figure"))
    names = spark.read.option("header", True).csv(f"{path}/columns.csv").select(F.lit("columns").alias("part"), "column", F.col("place").alias("figure"))
    text = spark.read.text(f"{path}/profile.txt").filter(F.col("value").startswith("rows:")).select(F.lit("text").alias("part"), F.lit("rows").alias("column"), F.col("value").alias("figure"))
    return as_json.unionAll(names).unionAll(text)




@query(f"""with {BOXES} select k::bigint as feature_id, true as inside from box""")
def inner_points(spark, d):
    """GEO-2: points inside U-shaped polygons with a hole, whose centre lies outside."""
    from gridloom.functions.geo import representative_points

    b = _boxes(spark, d)
    v = lambda i: F.col("parts")[0][i]
    x1, y1, x2, y2 = v(0)["x"], v(0)["y"], v(1)["x"], v(2)["y"]
    at = lambda fx, fy: F.struct((x1 + (x2 - x1) * fx).alias("x"), (y1 + (y2 - y1) * fy).alias("y"))
    u = F.array(*(at(*p) for p in ((0, 0), (0.3, 0), (0.3, 0.7), (0.7, 0.7), (0.7, 0), (1, 0), (1, 1), (0, 1))))
    hole = F.array(*(at(*p) for p in ((0.05, 0.1), (0.25, 0.1), (0.25, 0.9), (0.05, 0.9))))
    out = representative_points(b.withColumn("parts", F.array(u, hole))).join(b.select("feature_id", x1.alias("a"), y1.alias("b"), x2.alias("c"), y2.alias("d")), "feature_id")
    fx, fy = (F.col("lon") - F.col("a")) / (F.col("c") - F.col("a")), (F.col("lat") - F.col("b")) / (F.col("d") - F.col("b"))
    in_u = fx.between(0, 1) & fy.between(0, 1) & ~(fx.between(0.3, 0.7) & (fy < 0.7))
    return out.select("feature_id", (in_u & ~(fx.between(0.05, 0.25) & fy.between(0.1, 0.9))).alias("inside"))


def _maps(spark: SparkSession, d: str, path: str) -> DataFrame:
    c = cells(spark, d)
    from gridloom.sources import figures

    figures.write_map(c, "veg", path, SPEC, 0.0, 1.0)
    return c


@query(f"""with {CELLS} select r::int as "row", c::int as col, case when veg is null then 0 else 1 + least(254, floor(veg * 255))::int end as shade from range(40) a(r) cross join range(40) b(c) left join g on g."row" = r and g.col = c""")
def png_map(spark, d):
    """SNK-6: a map as a PNG file, decoded again."""
    from gridloom.sources import figures

    path = folder(spark) + "/veg.png"
    _maps(spark, d, path)
    return figures.read_png(spark, path)


