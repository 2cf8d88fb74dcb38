"""Distances anywhere on the Earth: missing places, 180 degrees, poles, antipodes."""

import math
import random

import numpy as np
import pytest

from gridloom.functions.geo import antipodal_km, geodesic_km, haversine_km, inverse_km, vincenty_km
from gridloom.operators import distance, od
from gridloom.params import Params
from gridloom.plans import steps


def arc(a, b):
    (x1, y1), (x2, y2) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def ellipsoid(a, b):
    return float(inverse_km(*(np.array([v]) for v in (*a, *b)))[0])


def test_missing_places_have_no_distance(spark):
    rows = [(1.0, 2.0, 3.0, 4.0), (None, 2.0, 3.0, 4.0), (1.0, None, 3.0, 4.0), (1.0, 2.0, None, 4.0), (1.0, 2.0, 3.0, None), (float("nan"), 2.0, 3.0, 4.0), (0.0, 0.0, 180.0, 0.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double").select(haversine_km("a", "b", "c", "d").alias("h"), geodesic_km("a", "b", "c", "d").alias("g")).collect()
    assert [r.h is None for r in got] == [r.g is None for r in got] == [False, True, True, True, True, True, False]
    assert got[-1].h == pytest.approx(math.pi * 6371.0088)


def test_zones_without_a_place(spark):
    z = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, None, 1.0, 3.0), (3, 1.0, 1.0, 2.0)], "code int, lon double, lat double, mass double")
    flows = {(r.oi, r.dj): r for r in od.gravity(z).collect()}
    assert all(r.dist_km is None and not r.flow for (a, b), r in flows.items() if 2 in (a, b)) and flows[1, 3].flow > 0
    assert {(r.oi, r.dj) for r in od.gravity(z, Params(od_cutoff_km=500.0), beyond_cutoff=False).collect()} == {(1, 1), (1, 3), (3, 1), (3, 3)}
    d = od.diagnostics(od.gravity(z)).first()
    assert d.mean_km == pytest.approx(arc((0, 0), (1, 1)))


@pytest.mark.parametrize("lon1, lat1, lon2, lat2, km", [(0, 0, 180, 0, 20003.931459), (0, 0, 179.5, 0.5, 19936.288579), (0, 0, 179.7, 0.5, 19944.127421), (0, -90, 77, 90, 20003.931459), (30, 40, 30, 40, 0.0), (0, 0, 90, 0, 10018.754171)])
def test_known_geodesics(lon1, lat1, lon2, lat2, km):
    assert ellipsoid((lon1, lat1), (lon2, lat2)) == pytest.approx(km, abs=1e-6)


def test_geodesics_near_antipodes():
    draw = np.random.default_rng(4)
    lon1, lat1 = draw.uniform(-180, 180, 300), draw.uniform(-89, 89, 300)
    lon2, lat2 = lon1 + 180 + draw.uniform(-0.7, 0.7, 300), -lat1 + draw.uniform(-0.7, 0.7, 300)
    got = inverse_km(lon1, lat1, lon2, lat2)
    assert np.isfinite(got).all()
    settled = vincenty_km(lon1, lat1, lon2, lat2)
    here = np.isfinite(settled)
    assert 0 < here.sum() < 300 and np.abs(settled - antipodal_km(lon1, lat1, lon2, lat2))[here].max() < 1e-6
    # the way round is the shortest over a place half-way, each half of which settles
    for i in np.flatnonzero(~here)[:12]:
        best = math.inf
        centre, spread = np.array([0.0, 0.0]), 180.0
        for _ in range(12):
            x, y = np.meshgrid(centre[0] + spread * np.linspace(-1, 1, 61), np.clip(centre[1] + spread / 2 * np.linspace(-1, 1, 61), -90, 90))
            x, y = x.ravel(), y.ravel()
            n = np.ones(len(x))
            a, b = vincenty_km(lon1[i] * n, lat1[i] * n, x, y), vincenty_km(x, y, lon2[i] * n, lat2[i] * n)
            total = np.where(np.abs(a - b) < 4000, a + b, np.inf)
            k = int(np.nanargmin(total))
            best, centre, spread = min(best, total[k]), np.array([x[k], y[k]]), spread / 4
        assert got[i] == pytest.approx(best, abs=0.01)


def places(seed, n):
    draw = random.Random(seed)
    at = [lambda: (draw.uniform(-180, 180), draw.uniform(-90, 90)), lambda: (draw.choice([-1, 1]) * draw.uniform(179.9, 180), draw.uniform(-1, 1)), lambda: (draw.uniform(-180, 180), draw.choice([-1, 1]) * draw.uniform(89.7, 90)), lambda: (draw.uniform(10, 10.5), draw.uniform(-10, -9.5))]
    return [draw.choice(at)() for _ in range(n)]


@pytest.mark.parametrize("measure, plain", [(haversine_km, arc), (geodesic_km, ellipsoid)])
def test_nearest_and_counts_around_the_earth(spark, measure, plain):
    p, t = places(1, 60), [(draw, xy) for draw, xy in zip(random.Random(2).choices(["a", "b"], [4, 1], k=90), places(3, 90), strict=True)]
    p += [(179.99, 0.0), (0.0, 90.0), (-180.0, 0.0)]
    t += [("a", (-179.99, 0.0)), ("a", (179.0, 0.0)), ("c", (33.0, 89.99))]
    points = spark.createDataFrame([(k, *xy) for k, xy in enumerate(p)] + [(900, None, 1.0), (901, 1.0, float("nan"))], "site_id int, lon double, lat double")
    goals = spark.createDataFrame([(la, *xy) for la, xy in t] + [("a", None, 2.0), ("b", 2.0, None), ("a", float("nan"), 2.0)], "layer string, lon double, lat double")
    got = {r.site_id: r for r in distance.nearest_and_counts(points, goals, (5.0, 30.0), layers=["a", "b", "c", "d"], distance=measure).collect()}
    assert len(got) == len(p) + 2
    for k, xy in enumerate(p):
        for la in "abc":
            d = [plain(xy, other) for name, other in t if name == la]
            assert got[k][f"dist_km_nearest_{la}"] == pytest.approx(min(d), abs=1e-6), (k, la)
            assert [got[k][f"count_{la}_le{r}km"] for r in (5, 30)] == [sum(x <= r for x in d) for r in (5, 30)]
        assert got[k].dist_km_nearest_d is None and got[k].count_d_le5km == 0
    for k in (900, 901):
        assert got[k].dist_km_nearest_a is None and got[k].count_a_le30km == 0
    assert got[len(p) - 3].dist_km_nearest_a == pytest.approx(plain((179.99, 0), (-179.99, 0)))


@pytest.mark.parametrize("km", [3.0, 700.0, 9000.0, 21000.0])
def test_radius_pairs_around_the_earth(spark, km):
    p, t = places(5, 50), places(6, 50)
    a = spark.createDataFrame([(k, *xy) for k, xy in enumerate(p)], "i int, p_lon double, p_lat double")
    b = spark.createDataFrame([(k, *xy) for k, xy in enumerate(t)], "j int, t_lon double, t_lat double")
    got = [(r.i, r.j) for r in distance.radius_pairs(a, b, km).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, x in enumerate(p) for j, y in enumerate(t) if arc(x, y) <= km}


def test_projects_across_180_degrees(spark):
    cells = spark.createDataFrame([(-179.99, 0.0, 1.0, 10.0, 0.5, 0.2, 1.0, 1.0, 1.0, 0.0), (179.0, 0.0, 1.0, 99.0, 0.5, 0.2, 1.0, 1.0, 1.0, 0.0)], "x double, y double, area_km2 double, pop double, crop_frac double, poverty double, elec double, rural double, priority double, risk double")
    k = distance.radius_kpis(spark.createDataFrame([("p", 179.99, 0.0)], "project_id string, lon double, lat double"), cells, (5.0,)).first()
    assert k.denom_cells == 1 and k["pop"] == 10.0


def test_synergies_by_the_geodesic(spark):
    p = spark.createDataFrame([("s", 10.0, 0.0)], "site_id string, lon double, lat double")
    t = spark.createDataFrame([("gov", 10.0, 50.0)], "layer string, lon double, lat double")
    assert steps.synergies(p, t, ["gov"]).first().dist_km_nearest_gov == pytest.approx(round(ellipsoid((10, 0), (10, 50)), 1))
    assert steps.synergies(p, t, ["gov"], measure=haversine_km).first().dist_km_nearest_gov == pytest.approx(round(arc((10, 0), (10, 50)), 1))
