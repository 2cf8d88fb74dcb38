"""DuckDB SQL that gives the same results as gridloom.plans.analogues."""

from __future__ import annotations

from gridloom.params import COMPONENTS, Params
from gridloom.plans.analogues import SWEEP, P

STEP = "0.0083333333"


def _r(x: str, digits: int = 6) -> str:
    return f"round_even(({x}) * 1e{digits}, 0) / 1e{digits}"


def _i(x: str) -> str:
    return f"cast({x} as integer)"


def _b(x: str) -> str:
    return f"cast({x} as bigint)"


CELLS = f"""
raw as (
    select {_i("o_custkey % 40")} as "row", {_i("(o_orderkey // 7) % 40")} as col, {_b("sum(cast(round(o_totalprice * 100) as bigint))")} as s, count(*) as n
    from orders group by 1, 2
), g as (
    select "row", col, n, s, 10.0::double + col * {STEP}::double as x, -10.0::double - "row" * {STEP}::double as y, s / 100.0::double as pop,
        (s % 24000) / 100.0::double as travel_min, case when (s // 43) % 17 <> 0 then ((s // 7) % 1000) / 1000.0::double end as veg,
        ((s // 11) % 500) / 1000.0::double as ntl, ((s // 13) % 10000) / 100.0::double as drought,
        case when (s // 43) % 17 <> 0 then ((s // 17) % 4000) / 1000.0::double - 2.0::double end as rwi,
        ((s // 19) % 1000) / 1000.0::double as crop_frac, ((s // 23) % 2)::double as elec, case when (s // 29) % 10 = 0 then 0.0::double else 1.0::double end as rural,
        case when (s // 31) % 3 = 0 then 1.0::double else 0.0::double end as road, ((s // 37) % 150) / 100.0::double as flood_max,
        ((s // 41) % 1000) / 1000.0::double as flood_frac, ((s // 47) % 1000) / 1000.0::double as pov, ((s // 53) % 1000) / 1000.0::double as food,
        ((s // 59) % 500) / 100.0::double as mtt, {_i('("row" // 8) * 5 + col // 8 + 1')} as zone_id,
        111.32::double * {STEP}::double * 111.32::double * {STEP}::double * cos(radians(-10.0::double - "row" * {STEP}::double)) as area_km2
    from raw
)"""

TOP = CELLS + """, cut as (select quantile_cont(veg, 0.9) as q from g), t as (
    select g.*, case when veg is null then null when veg >= q then 1 else 0 end as selected from g, cut
)"""

CHOSEN = CELLS + """, cut as (select quantile_cont(veg, 0.85) as q from g), t as (
    select g.*, case when veg is null then null when veg >= q then 1 else 0 end as selected from g, cut
)"""

NODES = CHOSEN.replace(CELLS, CELLS, 1)


def _components(neighbour: str) -> str:
    return f"""{NODES}, node as (select "row", col, "row" * 40 + col as id from t where selected = 1), edge as (
    select a.id as a, b.id as b from node a join node b on {neighbour}
), reach(id, other) as (select id, id from node union select r.id, e.b from reach r join edge e on r.other = e.a), label as (
    select id, min(other) as root from reach group by id
), comp as (select node.*, root, {_i("dense_rank() over (order by root)")} as cluster_id from node join label using (id))"""


EIGHT = "abs(a.\"row\" - b.\"row\") <= 1 and abs(a.col - b.col) <= 1"
FOUR = "abs(a.\"row\" - b.\"row\") + abs(a.col - b.col) <= 1"
#: As the engine's recursion needs WITH RECURSIVE at the front.
WITH = "with recursive "

PRUNED = _components(EIGHT) + f""", big as (
    select root, {_i("dense_rank() over (order by root)")} as cluster_id from comp group by root having count(*) >= 3
)"""

ZONES = """
mass as (select c_nationkey, greatest(sum(cast(round(c_acctbal * 100) as bigint)), 0) as m from customer group by 1), z as (
    select n_nationkey as code, n_name, -170.0::double + 14.0 * n_nationkey as lon, -60.0::double + 5.0 * n_nationkey as lat, coalesce(m, 0) / 100.0::double as mass
    from nation left join mass on n_nationkey = c_nationkey
)"""


def _hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * 6371.0088::double * asin(least(1.0::double, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))"


def _gravity(decay: str = "exp(-0.015::double * dist_km)", cutoff: float = 1500.0) -> str:
    return f"""{ZONES}, pair as (
    select a.code as oi, b.code as dj, a.mass as om, b.mass as dm, {_hav("a.lon", "a.lat", "b.lon", "b.lat")} as dist_km from z a, z b
), f0 as (select oi, dj, dist_km, case when dist_km > {cutoff} then 0.0::double else om * dm * {decay} end as raw from pair), f as (
    select oi, dj, raw * (1000000.0::double / sum(raw) over ()) as flow, dist_km from f0
)"""


def _clamp(v: str, lo: str, hi: str) -> str:
    return f"(case when {v} is null then null when {v} < {lo} then {lo} when {v} > {hi} then {hi} else {v} end)"


def _mm(v: str, lo: str, hi: str, invert: bool = False) -> str:
    out = f"(({_clamp(v, f'({lo})::double', f'({hi})::double')} - ({lo})) / (({hi}) - ({lo}) + 1e-9::double))"
    return f"(1 - {out})" if invert else out


#: One row of scalars that every score needs.
SCALARS = """k as (select quantile_cont(pop, 0.95) as pop95, median(drought) as dm, median(mtt) as mm, quantile_cont(rwi, 0.05) as r5, quantile_cont(rwi, 0.95) as r95,
    quantile_cont(rwi, 0.01) as r1, quantile_cont(rwi, 0.99) as r99 from g)"""


def _parts(p: Params) -> dict[str, str]:
    return {
        "access": _mm("travel_min", "0.0", "240.0", True), "pop": _mm("pop", "0.0", "pop95"), "veg": _mm("veg", str(p.veg_min), "1.0"), "ntl": _mm("ntl", "0.0", str(p.ntl_cap)),
        "drought": _mm("(case when dm > 1 then drought / 100 else drought end)", "0.0", "0.30", True), "pov": _clamp("pov", "0.0", "1.0"), "food": _clamp("food", "0.0", "1.0"),
        "mtt": _mm("(mtt * case when mm < 6 then 60.0::double else 1.0::double end)", "0.0", "240.0", True), "rwi": _mm("rwi", "r5", "r95", True),
    }


def _eligible(score: str, p: Params) -> str:
    return f"case when rural > 0.5 and crop_frac >= {p.mask_min_cropland} then {score} end"


def _smoothed(source: str, value: str = "score") -> str:
    return f"""(select a."row", a.col, sum(b.{value}) / nullif(count(b.{value}), 0) as {value} from {source} a
        join {source} b on abs(a."row" - b."row") <= 1 and abs(a.col - b.col) <= 1 group by a."row", a.col)"""


def _blend(p: Params, overlays: bool, clamp: bool, epsilon: str) -> str:
    parts = _parts(p)
    on = [c for c, u in zip(COMPONENTS, p.use_components, strict=True) if u] + (["pov", "food", "mtt", "rwi"] if overlays else [])
    total = sum(p.weights[c] for c in on)
    out = " + ".join(f"({p.weights[c]}::double / ({total}::double{epsilon})) * {parts[c]}" for c in on)
    return _clamp(f"({out})", "0.0", "1.0") if clamp else f"({out})"


def _sweep(digits: int = 3) -> str:
    ctes, unions = [CELLS, SCALARS], []
    for i, sc in enumerate(SWEEP):
        p = sc.params(P)
        ctes.append(f"""e{i} as (select g."row", g.col, {_eligible(_blend(p, False, False, ' + 1e-9'), p)} as score from g, k), s{i} as {_smoothed(f'e{i}')}""")
        if p.top_km2 is not None:
            ctes.append(f"""m{i} as (select "row", col, case when score is not null and cum - area_km2 < {p.top_km2} then 1 else 0 end as sel from (
                select s{i}."row", s{i}.col, score, area_km2, sum(area_km2) over (order by score desc nulls last, s{i}."row", s{i}.col rows unbounded preceding) as cum from s{i} join g using ("row", col)))""")
        else:
            ctes.append(f"""m{i} as (select "row", col, case when score >= (select quantile_cont(score, 0.9) from s{i}) then 1 else 0 end as sel from s{i})""")
        ctes.append(f"""n{i} as (select "row", col, "row" * 40 + col as id from m{i} where sel = 1), x{i} as (
            select a.id as a, b.id as b from n{i} a join n{i} b on {FOUR}), r{i}(id, other) as (select id, id from n{i} union select r.id, e.b from r{i} r join x{i} e on r.other = e.a), c{i} as (
            select id from r{i} group by id having count(*) < {p.min_cluster_cells}), f{i} as (
            select '{sc.scenario_id}' as scenario_id, "row", col, case when sel = 1 and "row" * 40 + col in (select id from c{i}) then 0 else sel end = 1 as sel from m{i})""")
        unions.append(f"select * from f{i}")
    return WITH + ", ".join(ctes) + f""", every as ({' union all '.join(unions)}), base as (select "row", col, sel as in_base from every where scenario_id = 'baseline')
    select scenario_id, count(*) filter (sel) as selected_cells, {_r('coalesce(sum(area_km2) filter (sel), 0)', digits)} as selected_km2, {_r('coalesce(sum(pop) filter (sel), 0)', digits)} as pop_selected,
        {_r('coalesce(sum(crop_frac * area_km2) filter (sel), 0)', digits)} as ag_km2_selected, {_r('avg(drought) filter (sel)', digits)} as drought_mean_selected,
        {_r('(count(*) filter (sel and in_base))::double / nullif(count(*) filter (sel), 0)', digits)} as overlap_pct_vs_baseline,
        {_r('(count(*) filter (sel and in_base))::double / nullif(count(*) filter (sel or in_base), 0)', digits)} as jaccard_vs_baseline, count(*) filter (in_base) as baseline_cells
    from every join base using ("row", col) join g using ("row", col) group by scenario_id"""


WIDE = """
ind as (select c_nationkey, c_mktsegment as var, sum(cast(round(c_acctbal * 100) as bigint))::double / count(*) / 100.0::double as v from customer group by 1, 2), w as (
    select c_nationkey as ADM2CD_c, max(v) filter (var = 'AUTOMOBILE') as balance__AUTOMOBILE, max(v) filter (var = 'BUILDING') as balance__BUILDING, max(v) filter (var = 'FURNITURE') as balance__FURNITURE,
        max(v) filter (var = 'HOUSEHOLD') as balance__HOUSEHOLD, max(v) filter (var = 'MACHINERY') as balance__MACHINERY from ind group by 1
), long as (select * from w unpivot include nulls (value for var in (balance__AUTOMOBILE, balance__BUILDING, balance__FURNITURE, balance__HOUSEHOLD, balance__MACHINERY)))"""

SITES = f"""
p as (select s_suppkey as site_id, 10.0::double + (s_suppkey * 7 % 400) * ({STEP}::double / 10) as lon, -10.0::double - (s_suppkey * 13 % 400) * ({STEP}::double / 10) as lat,
    {_i("(s_suppkey * 13) % 40")} as "row", {_i("(s_suppkey * 7) % 40")} as col from supplier), q as (
    select case p_partkey % 3 when 0 then 'gov' when 1 then 'wb' else 'oth' end as layer, 10.0::double + (p_partkey * 11 % 1000) * ({STEP}::double / 20) as lon,
        -10.0::double - (p_partkey * 17 % 1000) * ({STEP}::double / 20) as lat from part
), near as (select site_id, layer, {_hav("p.lon", "p.lat", "q.lon", "q.lat")} as d from p, q), counts as (
    select site_id, {', '.join(f"{_r(f'''min(d) filter (layer = '{la}')''')} as dist_km_nearest_{la}" for la in ("gov", "wb", "oth"))},
        {', '.join(f"count(*) filter (layer = '{la}' and d <= {r}) as count_{la}_le{r}km" for la in ("gov", "wb", "oth") for r in (1, 3))}
    from near group by site_id
)"""

BOXES = f"""
box as (select n_nationkey as k, 10.0::double + (n_nationkey * 7 % 33) * {STEP}::double + {STEP}::double * 0.23::double as x1, -10.0::double - (n_nationkey * 5 % 31) * {STEP}::double - {STEP}::double * 0.23::double as y1,
    {STEP}::double * 3.1::double as w, {STEP}::double * 2.3::double as h from nation)"""

AREA_G = "111.32::double * 111.32::double"


def _grid(n: int, k: int) -> str:
    """Centres of n x n cells, k to a base cell."""
    return f"""fine as (select r, c, 10.0::double - {STEP}::double / 2 + (c + 0.5) * ({STEP}::double / {k}) as cx, -10.0::double + {STEP}::double / 2 - (r + 0.5) * ({STEP}::double / {k}) as cy
        from (select unnest(range({n})) as r) cross join (select unnest(range({n})) as c))"""


def _pack() -> str:
    return f"""select cluster_id, {_r('sum(area_km2)', 4)} as area_km2, {_r('case when count(pop) = count(*) then sum(pop) end', 4)} as pop,
        {_r('case when count(crop_frac) = count(*) then sum(crop_frac * area_km2) end', 4)} as cropland_km2, {_r('avg(case when elec > 0.5 then 1 else 0 end)', 4)} as pct_electrified,
        {_r('avg(case when rural > 0.5 then 1 else 0 end)', 4)} as pct_rural, {_r('case when count(travel_min) = count(*) then avg(travel_min) end', 8)} as mean_travel_min,
        {_r('case when count(drought) = count(*) then avg(drought / case when (select median(drought) from t) > 1 then 100.0::double else 1.0::double end) end', 8)} as drought_mean_0_1, {_b('sum(case when road * (flood_frac >= 0.25)::int > 0.5 then 1 else 0 end)')} as risk_roadcells,
        {_r('case when count(flood_max) = count(*) then avg(flood_max) end', 8)} as flood_depth_mean_m, {_r('case when count(rwi) = count(*) then avg(rwi) end', 8)} as rwi_mean,
        {_r('avg(x)', 8)} as centroid_lon, {_r('avg(y)', 8)} as centroid_lat, {', '.join(f"{_r(f'avg(case when travel_min <= {t} then 1 else 0 end)', 4)} as share_le_{t}m" for t in (30, 60, 120, 240))}"""


def _shortlist_part(c: str, invert: bool = False) -> str:
    top = f"max({c}) over () - {c}" if invert else f"{c} - min({c}) over ()"
    return f"(case when {c} is null or max({c}) over () = min({c}) over () then 0.0::double else ({top}) / (max({c}) over () - min({c}) over ()) end)"


PROFILE_COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"}


def _profile() -> str:
    out = []
    for c, kind in PROFILE_COLUMNS.items():
        num = kind != "string"
        s = lambda f, c=c, num=num: _r(f.format(c=f"{c}::double"), 4) if num else "null::double"
        out.append(f"""select '{c}' as "column", '{kind}' as "type", {_r(f"100.0::double * (count(*) - count({c})) / count(*)", 4)} as null_pct, {_r(f"100.0::double * count(distinct {c}) / count(*)", 4)} as distinct_pct, count(*) as "rows", count(*) - count({c}) as nulls, count(distinct {c}) as "distinct", {s('min({c})')} as "min", {s('max({c})')} as "max", {s('avg({c})')} as mean,
            {s('median({c})')} as median, {s('stddev_samp({c})')} as std, concat_ws(',', case when count(distinct {c}) = count(*) and count(*) > 0 then 'id_like' end, case when count(distinct {c}) <= 1 then 'constant' end,
            case when 100.0 * count(distinct {c}) / count(*) > 90 and count(distinct {c}) < count(*) then 'mostly_unique' end, case when count({c}) * 2 < count(*) then 'mostly_null' end{f", case when 2 * count(*) filter ({c} = 0) > count(*) then 'mostly_zero' end" if num else ''}) as insights from orders""")
    return " union all ".join(out)


_mun = lambda c: _r(f"avg(case when {c} > 0.5 then 1 else 0 end)", 4)

ORACLES: dict[str, str] = {
    "zone_shortlist": f"""with g as (select s_nationkey as zone_id, sum(l_quantity) as qty, sum(cast(round(l_discount * 100) as bigint)) / count(*)::double as mean_discount,
        (count(*) filter (l_returnflag = 'R'))::double / count(*) as returned_share from lineitem join supplier on l_suppkey = s_suppkey group by 1), s as (
        select *, {_r(f"({_shortlist_part('qty')} + {_shortlist_part('mean_discount')} + {_shortlist_part('returned_share', True)}) / 3", 9)} as sc from g)
        select zone_id, n_name as name, {_r('qty')} as qty, {_r('mean_discount')} as mean_discount, {_r('returned_share')} as returned_share, {_r('sc')} as score,
            {_i('row_number() over (order by sc desc, zone_id)')} as rank from s join nation on zone_id = n_nationkey""",
    "masked_sum": f"with {CELLS} select {_r('sum(pop) filter (travel_min <= 60)', 2)} as total from g",
    "zonal_means": f"with {CELLS} select zone_id, {_r('avg(rwi)')} as rwi, {_r('case when count(veg) = count(*) then sum(veg) end')} as veg from g group by 1",
    "isochrone_masks": f"with {CELLS} select \"row\", col, t as thresh_min, {_i('travel_min <= t')} as mask from g, (select unnest([30.0::double, 60, 120, 240]) as t)",
    "isochrone_kpis": f"""with {CELLS}, k as (select t as travel_cut_min, coalesce(sum(pop) filter (travel_min <= t), 0) as pop_within, count(*) filter (travel_min <= t) as cells_within,
        coalesce(sum(crop_frac) filter (travel_min <= t), 0) as crop, count(*) filter (travel_min <= t and elec > 0.5) as el, sum(pop) as pt, sum(crop_frac) as ct, count(*) filter (elec > 0.5) as et
        from g, (select unnest([30.0::double, 60, 120, 240]) as t) group by 1)
        select travel_cut_min, {_r('pop_within', 4)} as pop_within, cells_within, cells_within::double as area_km2_within, {_r('100 * pop_within / nullif(pt, 0)', 4)} as pop_pct, {_r('crop', 4)} as cropland_km2,
        {_r('100 * crop / nullif(ct, 0)', 4)} as cropland_pct, el as electrified_cells, {_r('100.0::double * el / nullif(et, 0)', 4)} as electrified_pct, {_r('pt', 4)} as pop_total, {_r('ct', 4)} as cropland_total_km2,
        et as electrified_total_cells, et = 0 as note_electrification_denominator_zero from k""",
    "score_v1": f"""with {CELLS}, {SCALARS} select "row", col, {_r(f"0.35 * (1 - {_clamp('travel_min', '0.0', '240.0')} / 240.0) + 0.25 * {_clamp('(pop / pop95)', '0.0', '1.0')} + 0.20 * {_clamp('((veg - 0.3) / 0.7)', '0.0', '1.0')} + 0.10 * {_clamp('(ntl / 0.3)', '0.0', '1.0')} + 0.10 * (1 - {_clamp('(drought / 30.0)', '0.0', '1.0')})")} as score from g, k""",
    "priority_score": f"""with {CELLS}, {SCALARS}, e as (select "row", col, {_eligible(_blend(P, True, True, ''), P)} as score from g, k) select "row", col, {_r('score')} as score from {_smoothed('e')}""",
    "rwi_equity": f"with {CELLS}, {SCALARS} select \"row\", col, {_r(_mm('rwi', 'r1', 'r99', True))} as equity from g, k",
    "top_pct_mask": f"with {TOP} select \"row\", col, {_i('selected')} as selected from t",
    "top_area_mask": f"""with {CELLS} select "row", col, {_i('case when veg is not null and cum - area_km2 < 50.0 then 1 else 0 end')} as selected from (
        select *, sum(area_km2) over (order by veg desc nulls last, "row", col rows unbounded preceding) as cum from g)""",
    "zone_rank_pack": f"""with {TOP}, a as (select zone_id, avg(veg) as score, count(*) filter (selected = 1) as sc, coalesce(sum(area_km2) filter (selected = 1), 0) as sk, count(*) as tc, sum(area_km2) as tk from t where veg is not null group by 1)
        select zone_id, {_r('score')} as score, sc as selected_cells, {_r('sk')} as selected_km2, tc as total_cells, {_r('tk')} as total_km2, {_r('sc::double / tc')} as share_selected, sc > 0 as selected,
        {_i('row_number() over (order by score desc, zone_id)')} as rank from a""",
    "municipality_pack": f"""with {TOP} select zone_id, {_r('sum(area_km2)', 4)} as area_km2, {_r('sum(pop)', 4)} as pop_total, {_r('coalesce(sum(pop) filter (travel_min <= 60), 0)', 4)} as pop_le60min,
        {_r('coalesce(sum(pop) filter (travel_min <= 120), 0)', 4)} as pop_le120min, {_r('coalesce(sum(pop) filter (travel_min > 120), 0)', 4)} as pop_gt120min, {_r('sum(crop_frac * area_km2)', 4)} as cropland_km2,
        {_mun('elec')} as pct_electrified, {_mun('rural')} as pct_rural, {_mun('selected')} as pct_priority, {_r('avg(rwi)', 4)} as rwi_mean from t group by 1""",
    "muni_shortlist": f"""with {TOP}, a as (select zone_id, sum(pop) as pop, sum(crop_frac * area_km2) as crop, avg(case when elec > 0.5 then 1 else 0 end) as el, avg(case when rural > 0.5 then 1 else 0 end) as ru,
        avg(case when selected > 0.5 then 1 else 0 end) as pr, avg(rwi) as rwi, sum(cast(pov * 1000 as bigint))::double / count(*) / 1000.0::double as pov, sum(cast(mtt * 100 as bigint))::double / count(*) / 100.0::double as mtt from (
            select * replace (trunc(pov * 1000) / 1000 as pov, trunc(mtt * 100) / 100 as mtt) from t) group by 1)
        select zone_id, {_r('pop * ru', 5)} as rural_pop_est, {_r('pr', 5)} as pct_priority, {_r('pov', 5)} as poverty_rural,
        {_r(f"({_shortlist_part('pov')} + {_shortlist_part('mtt')} + {_shortlist_part('pr')} + {_shortlist_part('crop')} + {_shortlist_part('el', True)} + {_shortlist_part('rwi', True)}) / 6", 5)} as score from a""",
    "focal_mean": f"with {CELLS} select \"row\", col, {_r('veg')} as veg from {_smoothed('g', 'veg')}",
    "dilate_near_priority": f"""with {TOP} select a."row", a.col, {_i('max(coalesce(b.selected, 0))')} as near from t a join t b on abs(a."row" - b."row") <= 1 and abs(a.col - b.col) <= 1 group by 1, 2""",
    "disk_sum_sites": f"""with {CELLS}, {SITES} select site_id, count(g.n) as cells, coalesce(sum(g.n), 0)::bigint as orders from p left join g on pow(g."row" - p."row", 2) + pow(g.col - p.col, 2) <= 25 group by 1""",
    "flood_summary": f"""with {TOP}, near as (select a."row", a.col, max(coalesce(b.selected, 0)) as near from t a join t b on abs(a."row" - b."row") <= 1 and abs(a.col - b.col) <= 1 group by 1, 2), s as (
        select count(*) filter (road > 0.5) as r, count(*) filter (road > 0.5 and flood_frac >= 0.25) as w, count(*) filter (road > 0.5 and flood_frac >= 0.25 and near = 1) as n from t join near using ("row", col))
        select {_b('r')} as total_road_cells, {_b('w')} as total_risk_cells, {_b('n')} as risk_near_priority_cells, {_r('coalesce(100.0::double * w / nullif(r, 0), 0)', 2)} as risk_pct_of_roads,
        {_r('coalesce(100.0::double * n / nullif(w, 0), 0)', 2)} as near_prio_pct_of_risk, 0.3::double as flood_depth_threshold_m, 0.25::double as flood_exceed_fraction_min from s""",
    "components": f"{WITH}{_components(EIGHT)} select \"row\", col, cluster_id from comp",
    "component_prune": f"{WITH}{PRUNED} select \"row\", col, big.cluster_id from comp join big using (root)",
    "remove_small": f"""{WITH}{_components(FOUR)}, small as (select root from comp group by 1 having count(*) < 3) select t."row", t.col, {_i('case when small.root is not null then 0 else selected end')} as selected
        from t left join comp using ("row", col) left join small using (root)""",
    "cluster_kpis": f"""{WITH}{PRUNED}, c as (select t.*, big.cluster_id from comp join big using (root) join t using ("row", col)), m as (
        select cluster_id, zone_id from (select cluster_id, zone_id, row_number() over (partition by cluster_id order by count(*) desc, zone_id) as nth from c group by 1, 2) where nth = 1)
        select a.*, m.zone_id from ({_pack()} from c group by cluster_id) a join m using (cluster_id)""",
    "scenario_sweep": _sweep(),
    "indicator_wide": f"with {WIDE} select ADM2CD_c, {', '.join(f'{_r(c)} as {c}' for c in ('balance__AUTOMOBILE', 'balance__BUILDING', 'balance__FURNITURE', 'balance__HOUSEHOLD', 'balance__MACHINERY'))} from w",
    "indicator_long": f"with {WIDE} select ADM2CD_c, var, {_r('value')} as value from long",
    # p: without correlation, the angle whose sine is r has a density like cos to the n - 3: Simpson's rule in 2,000 steps
    "indicator_corr": f"""with {WIDE}, k as (select 'balance' as theme, substr(var, 10) as var, corr(value, balance__BUILDING) as r, count(*) as n from long join w using (ADM2CD_c)
        where var <> 'balance__BUILDING' and value is not null and balance__BUILDING is not null group by var having count(*) >= 3), i as (
        select i, case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end as w from range(2001) t(i))
        select theme, var, {_r('r')} as r, n, {_r('(pi() / 2 - asin(abs(r))) * sum(i.w * pow(cos(asin(abs(r)) + i * (pi() / 2 - asin(abs(r))) / 2000), n - 3)) / (pi() / 2 * sum(i.w * pow(cos(i * pi() / 2 / 2000), n - 3)))')} as p
        from k, i group by theme, var, r, n""",
    "poverty_quintile": f"""with {WIDE}, k as (select ADM2CD_c, balance__BUILDING as v, row_number() over (order by balance__BUILDING nulls last, ADM2CD_c) as k, count(balance__BUILDING) over () as n from w)
        select ADM2CD_c, {_i('case when v is not null then greatest(1, (5 * (k - 1) + n - 2) // greatest(n - 1, 1)) end')} as quintile from k""",
    "od_gravity": f"with {_gravity()} select oi, dj, {_r('flow', 4)} as flow, {_r('dist_km', 4)} as dist_km from f",
    "od_cutoff": f"with {_gravity('pow(1 + dist_km, -1.5::double)', 3000.0)} select oi, dj, {_r('flow', 4)} as flow, {_r('dist_km', 4)} as dist_km from f",
    "od_pairs_top": f"""with {_gravity()}, u as (select min(oi) as a, max(dj) as b, least(oi, dj) as oi, greatest(oi, dj) as dj, sum({_r('flow')}) as flow, avg(dist_km) as dist_km from f where oi <> dj group by least(oi, dj), greatest(oi, dj))
        select oi, dj, {_r('flow', 4)} as flow, {_r('dist_km', 4)} as dist_km, o.n_name as origin, d.n_name as destination from u join nation o on oi = o.n_nationkey join nation d on dj = d.n_nationkey order by u.flow desc, oi, dj limit 10""",
    "od_throughput": f"""with {_gravity()}, o as (select oi as node, sum(flow) as a from f group by 1), i as (select dj as node, sum(flow) as b from f group by 1)
        select node, {_r('a', 3)} as out_flow, {_r('b', 3)} as in_flow, {_r('a + b', 3)} as throughput from o join i using (node)""",
    "od_ipf_step": f"""with {_gravity()}, goal as (select code, mass / sum(mass) over () * 1e6 as target from z), r as (select oi, sum(flow) as s from f group by 1), f1 as (
        select f.oi, dj, dist_km, flow * case when s > 0 then target / s else 1 end as flow from f join r using (oi) join goal on code = f.oi), c as (select dj, sum(flow) as s from f1 group by 1)
        select oi, dj, {_r('flow * case when s > 0 then target / s else 1 end', 3)} as flow, {_r('dist_km', 3)} as dist_km from f1 join c using (dj) join goal on code = dj""",
    "od_diagnostics": f"""with {_gravity()}, o as (select * from f where oi <> dj), e as (select dist_km from o, range(cast(floor(flow) as bigint)))
        select {_r('sum(dist_km * flow) / sum(flow)', 4)} as mean_km, {_r('(select median(dist_km) from e)', 4)} as median_km, {_r('sum(case when dist_km <= 3000 then flow else 0 end) / sum(flow)', 4)} as share_within from o""",
    "od_asymmetry": f"with {_gravity()} select {_r('avg(abs(a.flow - b.flow))', 4)} as mean_asymmetry from f a join f b on a.oi = b.dj and a.dj = b.oi",
    "equity_mass": f"with {CELLS} select \"row\", col, {_r('greatest(0.0::double, pop * (1 + 0.25 * coalesce(rwi, 0) / 2))')} as mass, {_r('pow(1 + travel_min, -1.5::double)')} as decay, {_r('60.0::double / case when road > 0 then 30.0::double else 4.0::double end')} as friction from g",
    "nearest_counts": f"with {SITES} select * from counts",
    "radius_kpis": f"""with {CELLS}, {SITES}, d as (select site_id, g.*, {_hav('p.lon', 'p.lat', 'g.x', 'g.y')} as d from p, g)
        select site_id as project_id, r as radius_km, count(*) as denom_cells, {_r('sum(pop)', 3)} as pop, {_r('sum(pop / 5.0)', 3)} as hh, {_r('sum(pop / 5.0 * pov)', 3)} as poorest_hh, {_r('sum(crop_frac * area_km2)', 3)} as ag_km2,
        {_r('1.0::double * count(*) filter (elec > 0.5) / count(*)', 3)} as pct_electrified, {_r('1.0::double * count(*) filter (rural > 0.5) / count(*)', 3)} as pct_rural,
        {_r('1.0::double * count(*) filter (veg > 0.9) / count(*)', 3)} as pct_priority, count(*) filter (road * flood_frac > 0.5) as risk_roadcells from d, (select unnest([2.0::double, 5.0]) as r) where d <= r group by 1, 2""",
    "haversine_pairs": f"with {ZONES} select a.code as oi, b.code as dj, {_r(_hav('a.lon', 'a.lat', 'b.lon', 'b.lat'))} as dist_km from z a, z b",
    "weighted_mean_median": f"""with e as (select l_returnflag, l_discount from lineitem, range(cast(floor(l_quantity) as bigint))), m as (select l_returnflag, median(l_discount) as md from e group by 1)
        select l_returnflag, {_r('sum(l_discount * l_quantity) / sum(l_quantity)')} as mean_discount, {_r('any_value(md)')} as median_discount from lineitem join m using (l_returnflag) group by 1""",
    "quadrant_stats": f"""with {WIDE}, r as (select balance__BUILDING as sc, abs(balance__MACHINERY) / 100.0::double as po from w), k as (select median(sc) as ms, median(po) as mp, max(po) as top from r where sc is not null and po is not null), l as (
        select case when sc >= ms then 'High' else 'Lower' end || ' score & ' || case when po >= mp then 'high' else 'lower' end || ' poverty' as quadrant,
        1000.0::double * {_clamp('(case when top <= 1.5 then po when top <= 100 then po / 100 end)', '0.0', '1.0')} as poor from r, k where sc is not null and po is not null), s as (
        select q as quadrant, count(l.quadrant) as zones, coalesce(sum(poor), 0) as rp from (select unnest(['High score & high poverty', 'High score & lower poverty', 'Lower score & high poverty', 'Lower score & lower poverty']) as q) left join l on quadrant = q group by 1)
        select quadrant, zones, {_r('rp', 0)} as rural_poor, {_r('100.0 * rp / nullif(sum(rp) over (), 0)', 0)} as share_pct from s""",
    "site_gains_pivot": f"""with {CELLS}, k as (select zone_id as site_id, {', '.join(f'coalesce(sum(n) filter (travel_min <= {t}), 0)::double as pop_{t}' for t in (30, 60, 120, 240))} from g group by 1)
        select *, pop_60 - pop_30 as gain_30_60, pop_120 - pop_60 as gain_60_120, pop_240 - pop_120 as gain_120_240 from k""",
    "equity_outliers": f"with {CELLS} select \"row\", col, zone_id from g where pov >= (select quantile_cont(pov, 0.75) from g) and veg <= (select quantile_cont(veg, 0.25) from g)",
    "coverage_by_zone": f"with {CELLS} select zone_id, count(*) as n, {_b('sum(n)')} as total from g group by 1",
    "table_s1": f"""with {CELLS}, s as (select count(distinct zone_id) as c, sum(area_km2) as a, sum(pop) as p, sum(crop_frac * area_km2) as f from g)
        select c as clusters, {_r('a', 3)} as area_km2, {_r('p', 3)} as pop, {_r('f', 3)} as cropland_km2, {_r('p / a', 3)} as pop_per_km2, {_r('f / a', 3)} as cropland_share from s""",
    "table_s2": f"""with {TOP}, {WIDE}, a as (select zone_id, {_r('avg(veg)', 9)} as score, coalesce(sum(area_km2) filter (selected = 1), 0) as sk from t where veg is not null group by 1)
        select a.zone_id as ADM2CD_c, {_r('score', 4)} as score, {_r('sk', 4)} as selected_km2, {_r('100.0 * sk / (select sum(sk) from a)', 4)} as priority_share_pct, {_r('balance__BUILDING', 4)} as balance__BUILDING
        from a left join w on w.ADM2CD_c + 1 = a.zone_id order by a.score desc, a.zone_id limit 5""",
    "table_s3": f"""with {CELLS}, k as (select zone_id as site_index, sum(n)::double as pop from g where travel_min <= 60 group by 1), r as (select *, row_number() over (order by pop desc, site_index) as rank from k)
        select site_index, pop, 60.0::double as thresh_min, {_i('rank')} as rank, 'site_' || site_index as site from r where rank <= 10""",
    "table_s4": f"with {SITES} select site_id, count_gov_le3km + count_wb_le3km + count_oth_le3km as projects from counts order by 2 desc, 1 limit 10",
    "islands": f"with {SITES} select site_id from counts where count_gov_le1km + count_wb_le1km = 0",
    "table_profile_orders": _profile(),
    "top_values": " union all ".join(f"""(select '{c}' as "column", {c}::varchar as value, count(*) as n, {_i(f"row_number() over (order by count(*) desc, {c}::varchar)")} as rank from orders where {c} is not null group by {c} order by 3 desc, 2 limit 5)""" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")),
    "profile_rows": f"with u as (select user_id, event_type, count(*) as n from events group by 1, 2) select {_b('sum(n)')} as \"rows\", {_b('sum(n - 1)')} as duplicate_rows, {_b('sum(n) filter (user_id is not null and event_type is not null)')} as complete_rows from u",
    "key_set_checks": """with a as (select count(*) as n from (select c_custkey from customer except select o_custkey from orders)), b as (select count(*) as n from (select o_custkey from orders except select c_custkey from customer))
        select 'keys:left_only' as "check", n = 0 as ok, n::varchar as detail from a union all select 'keys:right_only', n = 0, n::varchar from b""",
    "monotone_checks": f"""with {CELLS}, d as (select pop - lag(pop) over (partition by "row" order by col) as d from g) select 'monotone:pop' as "check", count(*) filter (d < -1e-6) = 0 as ok, (count(*) filter (d < -1e-6))::varchar as detail from d""",
    "range_checks": f"with {CELLS} " + " union all ".join(f"""select 'range:{c}' as "check", count(*) filter ({c} < {lo} or {c} > {hi}) = 0 as ok, (count(*) filter ({c} < {lo} or {c} > {hi}))::varchar as detail from g""" for c, lo, hi in (("rwi", -1, 1), ("veg", 0, 1), ("drought", 0, 50))),
    "unique_checks": """with a as (select count(*) - count(distinct (l_orderkey, l_linenumber)) as n from lineitem), b as (select count(*) - count(distinct o_custkey) as n from orders)
        select 'key:unique' as "check", n = 0 as ok, n::varchar as detail from a union all select 'cust:unique', n = 0, n::varchar from b""",
    "flow_checks": f"""with {_gravity()}, s as (select count(*) filter (flow < 0) as bad, sum(flow) as total, sum(dist_km * flow) / sum(flow) as km from f), k as (select avg(abs(a.flow - b.flow)) as skew from f a join f b on a.oi = b.dj and a.dj = b.oi)
        select 'flow:non_negative' as "check", bad = 0 as ok, bad::varchar as detail from s union all select 'flow:total', abs(total - 1e6) <= 1, printf('%.4f', {_r('total', 4)}) from s
        union all select 'flow:mean_km', km is not null, printf('%.4f', {_r('km', 4)}) from s union all select 'flow:asymmetry', true, printf('%.4f', {_r('skew', 4)}) from k""",
    "mode_zone": "select o_custkey, o_orderpriority from (select o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by count(*) desc, o_orderpriority) as k from orders group by 1, 2) where k = 1",
    "dominant_source": """with c as (select user_id, count(*) filter (event_type = 'click') as a, count(*) filter (event_type = 'view') as b, count(*) filter (event_type = 'purchase') as c from events group by 1)
        select user_id, case when greatest(a, b, c) <= 0 then 'none' when (a = greatest(a, b, c))::int + (b = greatest(a, b, c))::int + (c = greatest(a, b, c))::int > 1 then 'mixed'
        when a = greatest(a, b, c) then 'click' when b = greatest(a, b, c) then 'view' else 'purchase' end as dominant from c""",
    "road_class": f"""select p_partkey, case when p_size % 12 < 6 then 'major' when p_size % 12 < 10 then 'collector' else 'local' end as bucket, {_i("nullif(regexp_extract(p_name, '([0-9]+)', 1), '')")} as number from part""",
    "share_and_scale": f"""with {CELLS}, k as (select zone_id, {_b('sum(n)')} as n from g group by 1) select zone_id, n, {_r('100.0::double * n / sum(n) over ()')} as share_pct, {_r('n::double / max(n) over ()')} as of_max,
        {_r('case when max(n) over () = min(n) over () then 0 else (n - min(n) over ())::double / (max(n) over () - min(n) over ()) end')} as scaled from k""",
    "dedupe_first": "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) where k = 1",
    "first_values": """select o_custkey, arg_min(o_orderstatus, o_orderkey) filter (o_orderstatus <> 'F') as status,
        arg_min(o_orderpriority, o_orderkey) filter (cast(round(o_totalprice * 100) as bigint) % 2 = 0) as priority from orders group by 1""",
    "reclass_and_flags": f"""with {CELLS} select "row", col, {_i('veg <= 0.5')} as low_veg, {_i('coalesce(veg > 0.5, false)')} as high_veg, {_r(_clamp('(drought / 30.0)', '0.0', '1.0'))} as drought01, {_r(_mm('rwi', '-1.0', '1.0', True))} as poor,
        {_r('case when drought * 1.2 between -1e-6 and 100 + 1e-6 then drought * 1.2 end')} as guarded from g""",
    "align_nearest": f"""with {CELLS}, t as (select {_i('r')} as r, {_i('c')} as c from (select unnest(range(16)) as r) cross join (select unnest(range(16)) as c))
        select r as "row", c as col, g.n as value from t left join g on g."row" = cast(floor((r + 0.5) * 2.5) as int) and g.col = cast(floor((c + 0.5) * 2.5) as int)""",
    "align_bilinear": f"""with {CELLS}, t as (select {_i('r')} as r, {_i('c')} as c, 0.25 + (r + 0.5) * 2 - 0.5 as v, 0.25 + (c + 0.5) * 2 - 0.5 as u from (select unnest(range(16)) as r) cross join (select unnest(range(16)) as c)), s as (
        select r, c, sum(veg * greatest(0, 1 - abs(v - "row")) * greatest(0, 1 - abs(u - col))) as a, sum(greatest(0, 1 - abs(v - "row")) * greatest(0, 1 - abs(u - col))) as w
        from t join g on veg is not null and "row" in (floor(v), floor(v) + 1) and col in (floor(u), floor(u) + 1) group by 1, 2)
        select t.r as "row", t.c as col, {_r('case when w > 1e-9 then a / w end', 8)} as value from t left join s using (r, c)""",
    "coarsen_max": f"with {CELLS} select {_i('\"row\" // 4')} as \"row\", {_i('col // 4')} as col, {_r('max(veg)', 8)} as value from g group by 1, 2",
    "coarsen_avg": f"with {CELLS} select {_i('\"row\" // 4')} as \"row\", {_i('col // 4')} as col, {_r('avg(veg)', 8)} as value from g group by 1, 2",
    "coarsen_mode": f"""with {CELLS}, k as (select {_i('"row" // 4')} as r, {_i('col // 4')} as c, veg, row_number() over (partition by "row" // 4, col // 4 order by count(*) desc, veg) as nth from g where veg is not null group by "row" // 4, col // 4, veg)
        select r as "row", c as col, {_r('veg', 8)} as value from k where nth = 1""",
    "block_sum": f"with {CELLS} select {_i('\"row\" // 3')} as \"row\", {_i('col // 3')} as col, {_b('sum(n)')} as value from g where \"row\" < 39 and col < 39 group by 1, 2",
    "scanline_burn": f"with {BOXES}, {_grid(40, 1)} select {_i('r')} as \"row\", {_i('c')} as col, max(k)::double as value from fine join box on cx >= x1 and cx < x1 + w and cy < y1 and cy >= y1 - h group by 1, 2",
    "polygon_fraction": f"""with {BOXES}, {_grid(400, 10)}, hit as (select distinct r, c from fine join box on cx >= x1 and cx < x1 + w and cy < y1 and cy >= y1 - h)
        select {_i('r // 10')} as "row", {_i('c // 10')} as col, {_r('count(*) / 100.0::double')} as value from hit group by 1, 2""",
    "box_centroids": f"with {BOXES} select k::bigint as feature_id, {_r('x1 + w / 2', 7)} as lon, {_r('y1 - h / 2', 7)} as lat from box",
    "zone_labels": f"select n_name as code, {_i('row_number() over (order by n_name)')} as zone_id, {_i('row_number() over (order by n_nationkey)')} as file_id from nation",
    "cell_filters": f"with {CELLS} select \"row\", col, zone_id from g where zone_id > 0 and veg is not null and rwi is not null and drought between 20 and 60 and road = 1",
    "zone_quantiles": f"with {CELLS} select {_r('quantile_cont(rwi, 0.25)')} as p25, {_r('quantile_cont(rwi, 0.5)')} as p50, {_r('quantile_cont(rwi, 0.75)')} as p75 from g",
    "off_diagonal": "select a.n_nationkey as oi, b.n_nationkey as dj from nation a, nation b where a.n_nationkey <> b.n_nationkey",
    "aoi_cells": f"""with {CELLS}, {BOXES}, e as (select *, 10.0::double - {STEP}::double / 2 as gx, -10.0::double + {STEP}::double / 2 as gy from box)
        select "row", col, exists (select 1 from e where (x1 - gx) / {STEP}::double < col + 1 and (x1 + w - gx) / {STEP}::double >= col and (gy - y1) / {STEP}::double < "row" + 1 and (gy - y1 + h) / {STEP}::double >= "row") as in_aoi from g""",
    "line_burn": f"""with {BOXES}, e as (select k, floor((x1 - (10.0::double - {STEP}::double / 2)) / {STEP}::double) as c1, floor((x1 + w - (10.0::double - {STEP}::double / 2)) / {STEP}::double) as c2,
        floor(((-10.0::double + {STEP}::double / 2) - y1) / {STEP}::double) as r1, floor(((-10.0::double + {STEP}::double / 2) - (y1 - h)) / {STEP}::double) as r2 from box)
        select k::bigint as feature_id, {_i('r')} as "row", {_i('c')} as col from e, range(40) a(r), range(40) b(c) where (r in (r1, r2) and c between c1 and c2) or (c in (c1, c2) and r between r1 and r2)""",
}
