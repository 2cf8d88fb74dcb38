"""Operators on small hand-made inputs."""

import heapq
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo, numeric
from gridloom.operators import cluster, cost, distance, focal, grid, od, profile, raster, report, scenario, score, select, tabular, validate, zonal
from gridloom.operators.grid import GridSpec
from gridloom.params import Params, Scenario, sanitize_radii
from gridloom.plans import steps
from gridloom.schema import CLUSTERS, empty_table, enforce_schema
from gridloom.sources import readers, sinks


def one(df):
    return df.first()


def test_nan_and_rounding(spark):
    df = numeric.nan_to_null(spark.createDataFrame([(1, float("nan")), (2, 2.675)], "i int, v double"))
    assert [r.v for r in df.orderBy("i").collect()] == [None, 2.675]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in (0.125, 2.675, -0.5, 2.5)], "v double").select(numeric.np_round("v", 2)).collect()] == [round(float(np.round(x, 2)), 2) for x in (0.125, 2.675, -0.5, 2.5)]


def test_clamps_keep_nulls(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.4,), (9.0,)], "v double")
    assert [r[0] for r in df.select(numeric.clamp("v", 0.0, 1.0)).collect()] == [None, 0.0, 0.4, 1.0]
    assert [r[0] for r in df.select(numeric.normalize_linear("v", 2.0, 2.0)).collect()] == [None, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(numeric.reclass_le("v", 0.4)).collect()] == [None, 1, 1, 0]
    assert [r[0] for r in df.select(numeric.flag(F.col("v") > 0.3)).collect()] == [0, 0, 1, 1]


def test_text_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,), ("inf",)], "t string")
    assert [r[0] for r in df.select(numeric.to_number("t")).collect()] == [1.5, None, None, None, None]


@pytest.mark.parametrize("n", [2, 4, 5, 7, 9, 10, 11, 23, 57])
def test_quintiles_equal_quantile_cuts(spark, n):
    import pandas as pd

    df = spark.createDataFrame([(i, float(i)) for i in range(n)], "k int, v double")
    got = [r.q for r in select.add_quintile(df, "v", "k", "q").orderBy("k").collect()]
    assert got == [int(x) + 1 for x in pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False)]


def test_haversine_and_geodesic(spark):
    df = spark.createDataFrame([(13.0, -12.0, 14.0, -12.5), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    h = [r[0] for r in df.select(geo.haversine_km("a", "b", "c", "d")).collect()]
    g = [r[0] for r in df.select(geo.geodesic_km("a", "b", "c", "d")).collect()]
    assert h[1] == g[1] == 0.0 and abs(h[2] - 111.195) < 1e-3 and abs(g[2] - 111.31949) < 1e-4 and abs(h[0] - g[0]) < 0.5


def test_inner_point_lies_inside():
    ring = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (3, 1), (3, 3), (1, 3)]
    x, y = geo.inner_point([ring, hole], "polygon")
    assert 0 < x < 4 and 0 < y < 4 and not (1 < x < 3 and 1 < y < 3)
    assert geo.inner_point([[(0, 0), (2, 0)]], "line") == (1, 0) and geo.inner_point([], "line") is None


SPEC = GridSpec(0.0, 4.0, 1.0, 1.0, 4, 4, "EPSG:3857")


def square(spark, x1, y1, x2, y2, fid=1, value=1.0, kind="polygon", fclass="primary"):
    return readers.features_table(spark, [("l", fid, fid, kind, fclass, value, [[(x1, y1), (x2, y1), (x2, y2), (x1, y2)]])])


def test_template_and_areas(spark):
    cells = grid.template_cells(spark, SPEC)
    assert cells.count() == 16 and one(cells.filter("row = 0 and col = 0").select("x", "y"))[:] == (0.5, 3.5)
    geographic = GridSpec(0.0, 0.0, 0.5, 0.5, 1, 1)
    assert abs(one(grid.template_cells(spark, geographic)).area_km2 - 111.32**2 * 0.25 * math.cos(math.radians(0.25))) < 1e-9
    assert one(grid.template_cells(spark, geographic, "constant")).area_km2 == 1.0


def test_resampling_names():
    assert grid.resampling("continuous") == "bilinear" and grid.resampling("mode") == "mode"
    with pytest.raises(ValueError):
        grid.resampling("fancy")


@pytest.mark.parametrize("method,want", [("max", [6, 8, 14, 16]), ("average", [3.5, 5.5, 11.5, 13.5]), ("sum", [14, 22, 46, 54]), ("nearest", [6, 8, 14, 16]), ("bilinear", [3.5, 5.5, 11.5, 13.5]), ("min", [1, 3, 9, 11]), ("med", [3.5, 5.5, 11.5, 13.5])])
def test_resample_two_to_one(spark, method, want):
    src = spark.createDataFrame([(r, c, float(4 * r + c + 1)) for r in range(4) for c in range(4)], "row int, col int, value double")
    target = GridSpec(0.0, 4.0, 2.0, 2.0, 2, 2, "EPSG:3857")
    got = grid.align(src, SPEC, grid.template_cells(spark, target), target, method).orderBy("row", "col")
    assert [r.value for r in got.collect()] == pytest.approx(want)


@pytest.mark.parametrize("method", ["cubic", "cubic_spline", "lanczos"])
def test_kernels_keep_constants(spark, method):
    src = spark.createDataFrame([(r, c, 7.0) for r in range(4) for c in range(4)], "row int, col int, value double")
    target = GridSpec(0.5, 3.5, 1.0, 1.0, 3, 3, "EPSG:3857")
    assert [r.value for r in grid.align(src, SPEC, grid.template_cells(spark, target), target, method).collect()] == pytest.approx([7.0] * 9)


def test_block_sum_drops_remainders(spark):
    src = spark.createDataFrame([(r, c, 1.0) for r in range(5) for c in range(5)], "row int, col int, value double")
    assert sorted(r.value for r in grid.block_sum(src, 2, 5, 5).collect()) == [4.0] * 4


def test_mask_policy(spark):
    cells = grid.template_cells(spark, SPEC).withColumns({"v": F.lit(1.0), "in_aoi": F.col("row") < 2})
    assert grid.apply_mask(cells, ["v"]).filter("v is null").count() == 8
    assert grid.apply_mask(cells, ["v"], "none").filter("v is null").count() == 0
    assert grid.apply_mask(cells, ["v"], "none", force=True).filter("v is null").count() == 8
    assert grid.apply_mask(cells, ["v"], min_overlap=0.9).filter("v is null").count() == 0


def test_polygon_burn_centres_and_order(spark):
    both = square(spark, 0.0, 4.0, 2.0, 2.0, 1, 5.0).unionByName(square(spark, 1.0, 3.0, 3.0, 1.0, 2, 9.0))
    got = {(r.row, r.col): r.value for r in raster.burn(both, SPEC).collect()}
    assert got == {(0, 0): 5.0, (0, 1): 5.0, (1, 0): 5.0, (1, 1): 9.0, (1, 2): 9.0, (2, 1): 9.0, (2, 2): 9.0}
    assert raster.burn(both, SPEC, "value > 100").count() == 0


def test_hole_and_touch(spark):
    f = readers.features_table(spark, [("l", 1, 1, "polygon", None, 1.0, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]])])
    assert raster.polygon_cells(f, SPEC).count() == 12
    small = square(spark, 1.6, 2.4, 2.4, 1.6)
    assert raster.polygon_cells(small, SPEC).count() == 0 and raster.touched_cells(small, SPEC).count() == 4


def test_coverage_is_exact_on_quarters(spark):
    got = {(r.row, r.col): r.value for r in raster.coverage_fraction(square(spark, 0.5, 3.5, 1.5, 2.5), SPEC).collect()}
    assert got == pytest.approx({(0, 0): 0.25, (0, 1): 0.25, (1, 0): 0.25, (1, 1): 0.25})


def test_line_supercover_and_classes(spark):
    line = lambda fid, cls, pts: ("roads", fid, fid, "line", cls, 1.0, [pts])
    f = readers.features_table(spark, [line(1, "primary", [(0.5, 3.5), (3.5, 3.5)]), line(2, "path", [(0.5, 3.5), (0.5, 0.5)]), line(3, "moat", [(3.5, 3.5), (3.5, 0.5)])])
    got = {(r.row, r.col): r.value for r in raster.class_max(f, SPEC, {"primary": 60.0, "path": 5.0}).collect()}
    assert got == {(0, 0): 60.0, (0, 1): 60.0, (0, 2): 60.0, (0, 3): 60.0, (1, 0): 5.0, (2, 0): 5.0, (3, 0): 5.0}


def test_focal_mean_fills_and_preserves(spark):
    v = [[1.0, 2.0, 3.0], [4.0, None, 6.0], [7.0, 8.0, None]]
    cells = spark.createDataFrame([("a", r, c, v[r][c]) for r in range(3) for c in range(3)], "aoi string, row int, col int, v double")
    for dense in (False, True):
        got = {(r.row, r.col): r.v for r in focal.focal_mean(cells, "v", 1, dense=dense).collect()}
        assert got[1, 1] == pytest.approx(31 / 7) and got[2, 2] == pytest.approx(7.0) and got[0, 0] == pytest.approx(7 / 3)
    assert focal.focal_mean(cells, "v", 1, preserve_nulls=True).filter("v is null").count() == 2
    assert focal.focal_max(cells, "v", 1, "m").filter("row = 2 and col = 2").first().m == 8.0


def test_focal_mean_without_all_cells(spark):
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, 3.0)], "aoi string, row int, col int, v double")
    assert [r.v for r in focal.focal_mean(cells, "v", 1).collect()] == [2.0, 2.0]


def test_disk_has_81_cells():
    assert len(focal.disk_offsets(5)) == 81


def blob_cells(spark):
    at = {(0, 0), (1, 1), (3, 3), (4, 3), (4, 4), (0, 4)}
    return spark.createDataFrame([("a", r, c, int((r, c) in at), 1.0) for r in range(5) for c in range(5)], "aoi string, row int, col int, m int, area_km2 double")


def plain_components(cells, k):
    """Flood fill, numbered by first cells."""
    left, number = sorted(cells), {}
    for at in left:
        if at not in number:
            stack, n = [at], max(number.values(), default=0) + 1
            while stack:
                r, c = stack.pop()
                if (r, c) in cells and (r, c) not in number:
                    number[r, c] = n
                    stack += [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (k == 8 or not (i and j))]
    return number


@pytest.mark.parametrize("options", [{}, {"tile": 2}, {"tile": 3, "local_edges": 0}, {"tile": 2, "local_groups": 1}])
def test_components_all_ways(spark, options):
    chosen = blob_cells(spark).filter("m = 1")
    got = lambda k: {(r.row, r.col): r.cluster_id for r in cluster.connected_components(chosen, k, **options).collect()}
    assert got(8) == {(0, 0): 1, (1, 1): 1, (0, 4): 2, (3, 3): 3, (4, 3): 3, (4, 4): 3}
    assert got(4) == {(0, 0): 1, (0, 4): 2, (1, 1): 3, (3, 3): 4, (4, 3): 4, (4, 4): 4}


@pytest.mark.parametrize("connectivity, options", [(4, {"tile": 4}), (8, {"tile": 5, "local_edges": 3}), (8, {"tile": 7, "local_groups": 2})])
def test_components_by_flood_fill(spark, connectivity, options):
    draw = np.random.default_rng(connectivity)
    spots = {k: {(int(r), int(c)) for r, c in zip(*np.nonzero(draw.random((30, 33)) < share), strict=True)} for k, share in (("a", 0.5), ("b", 0.3))}
    df = spark.createDataFrame([(k, r, c) for k, cells in spots.items() for r, c in cells] + [("a", *next(iter(spots["a"])))], "aoi string, row int, col int")
    got = cluster.connected_components(df, connectivity, **options).collect()
    assert {(r.aoi, r.row, r.col): r.cluster_id for r in got} == {(k, *at): n for k, cells in spots.items() for at, n in plain_components(cells, connectivity).items()}
    assert len(got) == sum(map(len, spots.values()))


def test_snake_is_one_component(spark):
    rows = [(0, c) for c in range(30)] + [(1, 29)] + [(2, c) for c in range(30)] + [(3, 0)] + [(4, c) for c in range(30)]
    df = spark.createDataFrame([("a", r, c) for r, c in rows], "aoi string, row int, col int")
    assert cluster.connected_components(df, 4, tile=3, local_edges=0).agg(F.max("cluster_id")).first()[0] == 1


def test_long_arms_are_one_component(spark):
    arms = [(r, c) for r in range(150) for c in (0, 2)] + [(149, 1)]
    alone = [(r, 4) for r in range(3)]
    df = spark.createDataFrame([("a", r, c) for r, c in arms + alone] + [("b", 7, 7)], "aoi string, row int, col int")
    got = {(r.aoi, r.row, r.col): r.cluster_id for r in cluster.connected_components(df, 8, tile=4, local_edges=0).collect()}
    assert got == {("a", *x): 1 for x in arms} | {("a", *x): 2 for x in alone} | {("b", 7, 7): 1}


def test_prune_and_small_groups(spark):
    cells = blob_cells(spark)
    labelled = cells.filter("m = 1").join(cluster.connected_components(cells.filter("m = 1"), 8), ["aoi", "row", "col"])
    assert {r.cluster_id for r in cluster.prune(labelled, 2, 0.0).collect()} == {1, 2} and cluster.prune(labelled, 2, 2.5).count() == 3
    assert cluster.remove_small(cells, "m", 3, 4).agg(F.sum("m")).first()[0] == 3
    assert cluster.remove_small(cells, "m", 1, 4) is cells


def least_minutes(f, start, dy, dx, cutoff=math.inf):
    """Least minutes from a cell, one cell at a time."""
    best, heap = {}, [(0.0, start)] if np.isfinite(f[start]) else []
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if (r, c) in best:
            continue
        best[r, c] = d
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                y, x = r + i, c + j
                if (i or j) and 0 <= y < f.shape[0] and 0 <= x < f.shape[1] and np.isfinite(f[y, x]) and (y, x) not in best:
                    new = d + math.hypot(i * dy, j * dx) * (f[r, c] + f[y, x]) / 2
                    if new <= cutoff:
                        heapq.heappush(heap, (new, (y, x)))
    return best


def test_uniform_cost_and_barriers():
    c = np.ones((5, 5))
    solve = lambda at, cutoff=math.inf: cost.solve_tile(c, [(np.array([at[0] * 5 + at[1]]), np.zeros(1))], 1.0, 1.0, cutoff)[0]
    assert solve((2, 2))[2, 4] == 2.0 and solve((2, 2))[0, 0] == pytest.approx(2 * math.sqrt(2))
    assert solve((2, 2), 1.2)[2, 3] == 1.0 and np.isinf(solve((2, 2), 1.2)[2, 4])
    c[:, 2] = np.nan
    assert np.isinf(solve((0, 0))[:, 3]).all() and np.isinf(solve((1, 2))).all()


@pytest.mark.parametrize("options, cutoff", [({}, math.inf), ({"tile": 4}, math.inf), ({"tile": 5, "together": 1, "most": 1}, 14.0)])
def test_tiles_equal_one_grid(spark, options, cutoff):
    rng = np.random.default_rng(1)
    f = rng.uniform(1, 9, (13, 17))
    f[rng.random(f.shape) < 0.25] = np.nan
    f[6, 1:] = np.nan  # the way round this wall leads through many tiles
    spec = GridSpec(10.0, -10.0, 0.01, 0.01, 13, 17)
    cells = spark.createDataFrame([(r, c, float(f[r, c]) if np.isfinite(f[r, c]) else None) for r in range(13) for c in range(17)], "row int, col int, friction double")
    starts = {"s0": (0, 0), "s1": (3, 4), "s2": (12, 16), "s3": (6, 5), "s4": (4, 8)}
    sites = spark.createDataFrame([(k, *rc) for k, rc in starts.items()] + [("off", 99, 0), ("none", None, 3)], "site_id string, row int, col int")
    got = {(r.site_id, r.row, r.col): r.minutes for r in cost.travel_minutes(sites, cells, spec, cutoff, **options).collect()}
    want = {(k, *rc): m for k, start in starts.items() for rc, m in least_minutes(f, start, *cost.sampling_km(spec), cutoff).items()}
    assert got == pytest.approx(want) and len(got) > 30


def test_top_percent_keeps_ties(spark):
    cells = spark.createDataFrame([(0, i, v, 1.0) for i, v in enumerate([1.0, 2.0, 3.0, 9.0, 9.0, None])], "row int, col int, v double, area_km2 double")
    got = [r.selected for r in select.top_percent(cells, "v", 25.0).orderBy("col").collect()]
    assert got == [0, 0, 0, 1, 1, None]


@pytest.mark.parametrize("target,want", [(2.5, [3, 4, 5]), (0.0, [5]), (99.0, [0, 1, 2, 3, 4, 5])])
def test_top_area_crossing_cell(spark, target, want):
    cells = spark.createDataFrame([("a", 0, i, float(i), 1.0) for i in range(6)] + [("a", 1, 0, None, 1.0)], "aoi string, row int, col int, v double, area_km2 double")
    got = sorted(r.col for r in select.top_area(cells, "v", target).filter("selected = 1").collect())
    assert got == want and select.top_area(cells, "v", target).filter("selected is null").count() == 1


def test_poison_and_skip(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0)], "zone_id int, v double")
    assert {r.zone_id: r.v for r in zonal.zonal(rows, "v", "sum").collect()} == {1: 1.0, 2: 3.0}
    assert {r.zone_id: r.v for r in zonal.zonal(rows, "v", "sum", policy="poison").collect()} == {1: None, 2: 3.0}
    with pytest.raises(ValueError):
        zonal.zonal(rows, "v", "mode")


def test_mode_takes_smallest_of_equals(spark):
    rows = spark.createDataFrame([(1, 5), (1, 4), (1, None), (2, 7)], "g int, z int")
    assert {r.g: r.z for r in zonal.mode_label(rows, "g", "z").collect()} == {1: 4, 2: 7}


def test_rank_pack_options(spark):
    cells = spark.createDataFrame([(1, 0.5, 1, 2.0), (1, 0.7, 0, 2.0), (3, None, 0, 2.0)], "zone_id int, score double, selected int, area_km2 double")
    zones = spark.createDataFrame([(1,), (2,), (3,)], "zone_id int")
    assert zonal.rank_pack(cells).count() == 1 and zonal.rank_pack(cells, zones=zones).count() == 3
    assert zonal.rank_pack(cells, zones=zones, legacy_max_label=True).count() == 1


def base_cells(spark, n=6):
    rng = np.random.default_rng(3)
    rows = [("a", r, c, 10 + c * 0.01, -10 - r * 0.01, 1.0, *(float(x) for x in (rng.uniform(0, 200), rng.uniform(0, 50), rng.uniform(0, 1), rng.uniform(0, 0.5), rng.uniform(0, 40), rng.uniform(0, 1))), 1.0, int(r // 3) + 1) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "aoi string, row int, col int, x double, y double, area_km2 double, travel_min double, pop double, veg double, ntl double, drought double, crop_frac double, rural double, zone_id int")


def test_scores_lie_in_unit_range(spark):
    out = score.priority_score(base_cells(spark), Params(mask_min_cropland=0.0)).agg(F.min("score"), F.max("score")).first()
    assert 0 <= out[0] <= out[1] <= 1
    assert sum(score.effective_weights(["access", "pop", "drought", "pov"]).values()) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        score.effective_weights(["veg"])


def test_units_by_median(spark):
    percent = base_cells(spark)
    share = percent.withColumn("drought", F.col("drought") / 100)
    p = Params(mask_min_cropland=0.0, smooth_radius=0)
    a, b = ({(r.row, r.col): r.score for r in score.priority_score(c, p).collect()} for c in (percent, share))
    assert a == pytest.approx(b)


def test_sweep_overlaps(spark):
    p = Params(mask_min_cropland=0.0, min_cluster_cells=1, smooth_radius=0)
    rows = {r.scenario_id: r for r in scenario.sweep(base_cells(spark), p, (Scenario("baseline"), Scenario("half", "", {"top_pct_cells": 50.0}))).collect()}
    assert rows["baseline"].jaccard_vs_baseline == 1.0 and rows["half"].jaccard_vs_baseline < 1 and rows["half"].overlap_pct_vs_baseline <= 1
    assert rows["half"].USE_COMPONENTS == "(1, 1, 0, 0, 1)"


def test_isochrones_grow(spark):
    k = steps.isochrone_kpis(base_cells(spark).withColumn("elec", F.lit(0.0)))
    assert validate.monotone(k, [], "travel_cut_min", "pop_within").first().ok
    r = k.orderBy("travel_cut_min").collect()[-1]
    assert r.pop_pct == pytest.approx(100.0) and r.electrified_pct is None and r.note_electrification_denominator_zero


def zones3(spark):
    return spark.createDataFrame([("A", 10.0, -10.0, 5.0, 1.0), ("B", 10.5, -10.0, 5.0, -1.0), ("C", 60.0, 40.0, 5.0, None)], "code string, lon double, lat double, pop double, rwi_z double")


def test_gravity_total_symmetry_cutoff(spark):
    z = od.with_mass(zones3(spark), Params(rwi_weight=0.0))
    f = {(r.oi, r.dj): r.flow for r in od.gravity(z).collect()}
    assert sum(f.values()) == pytest.approx(1e6) and f["A", "B"] == pytest.approx(f["B", "A"]) and f["A", "C"] == 0
    with pytest.raises(ValueError):
        od.gravity(z.withColumn("mass", F.lit(0.0)))
    with pytest.raises(ValueError):
        numeric.impedance("d", "none")


def test_gravity_within_the_cutoff(spark):
    rows = [(f"z{k}", -180.0 + k * 47 % 361, -60.0 + k * 31 % 121, 1.0 + k % 7) for k in range(60)] + [("none", None, 3.0, 1.0), ("east", 179.9, 0.0, 2.0), ("west", -179.9, 0.0, 3.0)]
    z = spark.createDataFrame(rows, "code string, lon double, lat double, mass double")
    for km in (30.0, 1500.0, 9000.0):
        p = Params(od_cutoff_km=km)
        whole = [r for r in od.gravity(z, p).collect() if r.dist_km is not None and r.dist_km <= km]
        near = od.gravity(z, p, beyond_cutoff=False).collect()
        assert len(near) == len(whole) and {(r.oi, r.dj): (r.flow, r.dist_km) for r in near} == {(r.oi, r.dj): (pytest.approx(r.flow, rel=1e-9), r.dist_km) for r in whole}
        assert any((r.oi, r.dj) == ("east", "west") for r in near)


def test_tilt_sign(spark):
    m = lambda s: {r.code: r.mass for r in od.with_mass(zones3(spark), Params(tilt_sign=s)).collect()}
    assert m(1)["A"] > m(1)["C"] == 5.0 > m(1)["B"] and m(-1)["A"] < 5.0


def test_balancing_meets_both_margins(spark):
    z = od.with_mass(zones3(spark)).withColumn("mass", F.when(F.col("code") == "A", 3.0).otherwise(F.col("mass")))
    p = Params(od_ipf=True, od_cutoff_km=None)
    f = od.gravity(z, p).collect()
    total = sum(r.mass for r in z.collect())
    for side in ("oi", "dj"):
        for r in z.collect():
            assert sum(x.flow for x in f if x[side] == r.code) == pytest.approx(r.mass / total * 1e6, rel=1e-6)
    start = {(r.oi, r.dj): r.flow for r in od.gravity(z, p.with_(od_ipf=False)).collect()}
    goal = {r.code: r.mass / total * 1e6 for r in z.collect()}
    for _ in range(200):  # cell by cell
        for side in (0, 1):
            sums = {c: sum(v for k, v in start.items() if k[side] == c) for c in goal}
            start = {k: v * goal[k[side]] / sums[k[side]] if sums[k[side]] else v for k, v in start.items()}
    assert {(r.oi, r.dj): r.flow for r in f} == pytest.approx(start, rel=1e-6)
    with pytest.warns(UserWarning, match="margins"):
        od.ipf(od.gravity(z, p.with_(od_ipf=False)), z, p, rounds=1)


def test_agents_are_the_generators(spark):
    z = od.with_mass(zones3(spark))
    flows = od.gravity(z)
    got = [(r.oi, r.dj) for r in od.agents_exact(flows, z).orderBy("agent").collect()]
    m = np.zeros((3, 3))
    for r in flows.collect():
        m["ABC".index(r.oi), "ABC".index(r.dj)] = r.flow
    draws = np.random.default_rng(42).choice(9, size=9, replace=True, p=m.ravel() / m.sum())
    assert got == [(int(d) // 3, int(d) % 3) for d in draws]
    with pytest.raises(ValueError):
        od.agents_exact(flows, z, most_zones=2)


def test_agents_of_any_number(spark):
    z = od.with_mass(zones3(spark))
    flows = od.gravity(z)
    got = sorted(tuple(r) for r in od.agents_drawn(flows, z, 70_000).select("agent", "o_code", "d_code").collect())
    assert [a for a, _, _ in got] == list(range(70_000))
    assert got == sorted(tuple(r) for r in od.agents_drawn(flows.repartition(7, "dj"), z, 70_000).select("agent", "o_code", "d_code").collect())
    assert got != sorted(tuple(r) for r in od.agents_drawn(flows, z, 70_000, seed=1).select("agent", "o_code", "d_code").collect())
    want = {(r.oi, r.dj): r.flow / 1e6 * 70_000 for r in flows.collect()}
    drawn = Counter((o, d) for _, o, d in got)
    assert all(abs(drawn[k] - v) < 6 * math.sqrt(v + 1) for k, v in want.items())


def test_pairs_and_asymmetry(spark):
    f = spark.createDataFrame([(1, "A", "B", 2.0, 5.0), (2, "B", "A", 3.0, 5.0), (3, "A", "A", 9.0, 0.0)], "n int, oi string, dj string, flow double, dist_km double")
    r = zonal.collapse_pairs(f, "n").collect()
    assert len(r) == 1 and (r[0].oi, r[0].dj, r[0].flow) == ("A", "B", 5.0)
    assert zonal.asymmetry(f).first()[0] == pytest.approx(2 / 3)


def test_nearest_is_true_pairwise(spark):
    p = spark.createDataFrame([("s1", 10.0, -10.0), ("s2", 10.2, -10.0)], "site_id string, lon double, lat double")
    t = spark.createDataFrame([("gov", 10.2, -10.0), ("gov", 10.0, -10.1)], "layer string, lon double, lat double")
    r = {x.site_id: x for x in steps.synergies(p, t, ["gov", "oth"]).collect()}
    assert r["s1"].dist_km_nearest_gov == pytest.approx(11.1) and r["s2"].dist_km_nearest_gov == 0.0
    assert r["s1"].count_gov_le30km == 2 and r["s1"].count_gov_le5km == 0 and r["s1"].dist_km_nearest_oth is None and r["s1"].count_oth_le30km == 0


def test_far_targets_are_found(spark):
    p = spark.createDataFrame([("s", 10.0, -10.0)], "site_id string, lon double, lat double")
    t = spark.createDataFrame([("gov", -120.0, 50.0)], "layer string, lon double, lat double")
    assert distance.nearest_and_counts(p, t, (5.0,)).first().dist_km_nearest_gov > 10_000


def test_correlation_constant_and_p(spark):
    rows = [(i, float(i), 2.0 * i + (i % 3), 4.0, None if i > 1 else 1.0) for i in range(8)]
    w = spark.createDataFrame(rows, "ADM2CD_c int, t__y double, t__x double, t__const double, t__few double")
    got = {r["var"]: r for r in tabular.correlations(w, "t__y", ("ADM2CD_c",)).collect()}
    assert set(got) == {"x", "const"} and got["const"].r is None and got["const"].p is None
    assert got["x"].r == pytest.approx(np.corrcoef([r[1] for r in rows], [r[2] for r in rows])[0, 1]) and 0 < got["x"].p < 1e-5


@pytest.mark.parametrize("r,n,p", [(0.5, 10, 0.14111), (0.9, 5, 0.03739), (0.0, 7, 1.0), (1.0, 4, 0.0)])
def test_p_values(r, n, p):
    assert tabular._p_value(r, n) == pytest.approx(p, abs=2e-5)


def test_ingest_to_wide(spark):
    a = spark.createDataFrame([("z1", "50", "x")], "ADM2CD_c string, data1 string, data2 string")
    a = tabular.normalize_units(tabular.rename_columns(a, {"data1": "rate", "data2": "hours"}), ["rate"], {"hours": "minutes"})
    wide = tabular.wide_table(tabular.mean_of_duplicates(tabular.ingest_themes({"p": a, "climevents": a}, skip=("climevents",))))
    row = wide.first().asDict()
    assert row["p__rate"] == 0.5 and row["p__minutes"] is None
    assert tabular.drop_empty_columns(wide).columns == ["ADM2CD_c", "p__rate"]


def test_raw_maps(spark):
    base = spark.createDataFrame([("c1", 1), ("c1", 2), ("c2", 3)], "adm2code string, muni_n_af int")
    m = {k: spark.createDataFrame([(1, "v", str(k))], "muni_n_af int, variable string, value string") for k in (2, 10)}
    out = tabular.code_maps(base, m)
    assert out.columns == ["adm2code", "muni_n_af", "data2", "data10"] and out.filter("adm2code = 'c1'").first().data10 == 10.0


def test_one_to_one_refuses_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        tabular.one_to_one(a, a.distinct(), ["k"])


def test_names_fall_back_to_codes(spark):
    n = spark.createDataFrame([("A", "Alpha")], "code string, name string")
    df = spark.createDataFrame([("A",), ("B",)], "c string")
    assert {r.c: r.n for r in tabular.with_names(df, n, "c", "n").collect()} == {"A": "Alpha", "B": "B"}


def test_tables_without_clusters(spark):
    assert report.table_s1(None, spark=spark).first().clusters is None
    r = report.table_s1(empty_table(spark, CLUSTERS)).first()
    assert r.clusters == 0 and r.area_km2 == 0 and r.pop_per_km2 is None
    assert report.available_radii(["count_gov_le5km", "count_gov_le30km", "count_wb_le9km"]) == [5, 30]


def test_totals_from_first_valid_row(spark):
    k = spark.createDataFrame([(30.0, 5.0, 0.0, 0.0, 0.0), (60.0, 10.0, 20.0, 3.0, 50.0)], "travel_cut_min double, pop_within double, pop_pct double, cropland_km2 double, cropland_pct double")
    assert report.totals_from_kpis(k).first()[:] == (50.0, 6.0)


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.0), (3, None, 5.0)], "k int, t string, v double")
    rows = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert rows["k"].insights == "id_like" and rows["t"].insights == "constant" and rows["v"].insights == "mostly_zero" and rows["t"].nulls == 1
    assert profile.profile_rows(df.unionByName(df.limit(1))).first().duplicate_rows == 1


def test_profile_counts_by_plain_python(spark):
    import statistics

    rows = [(k * k % 97 if k % 10 else None, float(k % 13) - 6 if k % 4 else -0.0, f"t{k % 31}", (1 << 60) + k % 3) for k in range(400)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d long").repartition(7)
    got = {r["column"]: r for r in profile.profile_columns(df).collect()}
    for i, c in enumerate("abcd"):
        held = [r[i] for r in rows if r[i] is not None]
        assert (got[c].rows, got[c].nulls, got[c].distinct) == (400, 400 - len(held), len(set(held)))
        assert got[c].median == (statistics.median(float(x) for x in held) if c != "c" else None)
    none = {r["column"]: r for r in profile.profile_columns(df.limit(0)).collect()}
    assert set(none) == set("abcd") and none["a"].distinct == 0 and none["a"].median is None and none["a"].null_pct is None
    wide = {r["column"]: r for r in profile.profile_columns(spark.createDataFrame([(1.0,), (2.0,)], "`x.y` double")).collect()}
    assert wide["x.y"].median == 1.5


def test_validation(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 2], [2, 3, 4]))
    assert {r["check"]: r.detail for r in validate.same_keys(a, b, "k").collect()} == {"keys:left_only": "1", "keys:right_only": "2"}
    assert validate.required_columns(a, ["k", "z"]).first().detail == "z" and not validate.unique_key(a.unionByName(a), ["k"]).first().ok
    files = spark.createDataFrame([("map_12.csv",), ("adm2_x.csv",), ("base.csv",), ("z",)], "file string")
    assert [(r.kind, r.number) for r in validate.classify_files(files).collect()] == [("map", 12), ("adm2", None), ("base", None), ("other", None)]
    assert select.contiguous(spark.createDataFrame([(1,), (2,)], "i int"), "i").first().ok and not select.contiguous(spark.createDataFrame([(1,), (3,)], "i int"), "i").first().ok


def test_schema_lock(spark):
    df = spark.createDataFrame([("3", 1.23456)], "cluster_id string, area_km2 double")
    out = enforce_schema(df, CLUSTERS, {"pop": 0.0}, {"area_km2": 2})
    assert out.columns == CLUSTERS.names and out.first().cluster_id == 3 and out.first().area_km2 == 1.23 and out.first().pop == 0.0


@pytest.mark.parametrize("body,sep,encoding", [("a;b\n1;2\n", ";", "utf-8"), ("a\tb\n1\t2\n", "\t", "utf-8"), ("a|b\nç|2\n", "|", "latin-1"), ("a,b\n\"x;y\",2\n", ",", "utf-8")])
def test_sniffed_csv(spark, tmp_path, body, sep, encoding):
    (tmp_path / "t.csv").write_bytes(body.encode(encoding))
    df = readers.read_csv_auto(spark, f"file://{tmp_path}/t.csv")
    assert df.columns == ["a", "b"] and df.first().b == "2"
    if encoding == "latin-1":
        assert df.first().a == "ç"


def test_sources_and_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert readers.read_optional(spark, f"{root}/none.parquet") is None and readers.first_existing(spark, [f"{root}/x", root]) == root
    cells = grid.template_cells(spark, GridSpec(0.0, 0.0, 0.1, 0.1, 2, 2))
    sinks.write_cells(cells, f"{root}/cells", GridSpec(0.0, 0.0, 0.1, 0.1, 2, 2))
    assert readers.read_cells(spark, f"{root}/cells", "aoi").count() == 4
    assert readers.read_json(spark, f"{root}/cells.geo.json").first()["shape"] == [2, 2]
    with pytest.raises(ValueError):
        sinks.write_cells(cells, f"{root}/no", GridSpec(0.0, 0.0, 0.1, 0.1, 2, 2, ""))
    sinks.write_csv(spark.createDataFrame([(True, [1, 0], None)], "b boolean, t array<int>, v double"), f"{root}/csv")
    assert readers.read_csv(spark, f"{root}/csv").first()[:] == ("True", "(1, 0)", None)
    sinks.write_empty(spark, CLUSTERS, f"{root}/empty")
    (tmp_path / "g.json").write_text('{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0,0],[2,0],[2,2],[0,2],[0,0]]]}, "properties": {"v": 3}}, {"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {}}]}')
    f = readers.read_geojson(spark, f"{root}/g.json", "v").orderBy("seq").collect()
    assert f[0].kind == "polygon" and f[0].value == 3.0 and f[1].kind == "point" and f[1].parts[0][0].y == 2.0
    (tmp_path / "r.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9\n1 -9\n3 4\n")
    values, head = readers.read_ascii_grid(spark, f"{root}/r.asc")
    assert {(r.row, r.col): r.value for r in values.collect()} == {(0, 0): 1.0, (1, 0): 3.0, (1, 1): 4.0} and head["ncols"] == 2
    assert [(r.exists) for r in validate.inventory(spark, [f"{root}/g.json", f"{root}/nope"]).collect()] == [True, False]
    assert validate.provenance(spark, f"{root}/g.json").first().bytes > 100


def test_clusters_end_to_end(spark):
    cells = base_cells(spark, 8).withColumns({"elec": F.lit(1.0), "risk": F.lit(0.0), "flood_max": F.lit(0.1), "rwi": F.lit(0.2), "selected": (F.col("row") < 3).cast("int")})
    _, table = steps.priority_clusters(cells, Params(min_cluster_cells=2, min_cluster_km2=0.0))
    r = table.collect()
    assert len(r) == 1 and r[0].area_km2 == 24.0 and r[0].zone_id == 1 and r[0].pct_electrified == 1.0


def test_catchments_are_nested(spark):
    spec = GridSpec(10.0, -10.0, 0.05, 0.05, 8, 8)
    cells = grid.template_cells(spark, spec).withColumns({"pop": F.lit(1.0), "crop_frac": F.lit(0.5), "rwi": F.lit(0.1)})
    roads = readers.features_table(spark, [("r", 1, 1, "line", "primary", 1.0, [[(10.01, -10.2), (10.39, -10.2)]])])
    sites = spark.createDataFrame([(1, 10.1, -10.2), (2, 50.0, 50.0)], "site_id int, lon double, lat double")
    surface, table = steps.catchments(sites, cells, roads, spec)
    assert {r.site_id for r in table.collect()} == {1} and validate.monotone(table, ["site_id"], "thresh_min", "area_km2").first().ok
    assert cost.union_of_catchments(surface, sites, (60.0,)).filter("mask = 1").count() == table.filter("thresh_min = 60").join(surface, "site_id").filter("minutes <= 60").count()


def test_project_and_site_steps(spark):
    spec = GridSpec(9.995, -9.995, 0.01, 0.01, 6, 6)
    cells = base_cells(spark).withColumns({"elec": F.lit(1.0), "poverty": F.lit(0.5), "priority": F.lit(0.0), "risk": F.lit(1.0), "road": F.lit(1.0)})
    p = spark.createDataFrame([("p1", 10.0, -10.0), ("far", 40.0, 40.0)], "project_id string, lon double, lat double")
    r = {x.project_id: x for x in steps.project_kpis(p, cells, Params(radii_km=(2.0, 50.0)), ("hub", 10.0, -10.0)).collect()}
    assert r["p1"].denom_cells_50km == 36 and r["p1"].pct_electrified_50km == 1.0 and r["far"].denom_cells_2km is None and r["p1"].dist_km_to_hub == 0
    s = steps.site_audit(p.select(F.lit(1).alias("site_id"), "lon", "lat"), cells, spec).collect()
    assert len(s) == 1 and s[0].electrified_share_5km == 1.0 and s[0].near_road_flag == 1


def test_build_base(spark):
    spec = GridSpec(0.0, 4.0, 1.0, 1.0, 4, 4)
    fine = GridSpec(0.0, 4.0, 0.5, 0.5, 8, 8)
    layer = lambda s, v: grid.template_cells(spark, s).select("row", "col", F.lit(v).alias("value"))
    zones = square(spark, 0.0, 4.0, 2.0, 0.0, 1).withColumn("adm2", F.lit("B")).unionByName(square(spark, 2.0, 4.0, 4.0, 0.0, 2).withColumn("adm2", F.lit("A")))
    cells, labelled = steps.build_base(spark, spec, {"travel_min": (layer(spec, 5.0), spec, "nearest"), "flood": (layer(fine, 0.5), fine, "max")}, {"cropland": square(spark, 0.0, 4.0, 1.0, 3.0), "aoi": square(spark, 0.0, 4.0, 4.0, 2.0), "elec": square(spark, 0.0, 4.0, 1.0, 3.0, 1, 1.0), "urban": square(spark, 0.0, 4.0, 1.0, 3.0, 1, 2.0)}, zones)
    r = {(x.row, x.col): x for x in cells.collect()}
    assert r[0, 0].crop_frac == 1.0 and r[0, 0].flood_frac == 1.0 and r[0, 0].elec == 1.0 and r[0, 0].urban == 1.0 and r[0, 0].zone_id == 2 and r[0, 3].zone_id == 1 and r[3, 3].travel_min is None
    assert {x.adm2: x.zone_id for x in labelled.collect()} == {"A": 1, "B": 2}


def test_radii():
    assert sanitize_radii([30, 5, 5, -1, None, 0]) == (5.0, 30.0)
