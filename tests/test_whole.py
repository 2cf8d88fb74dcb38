"""Queries over all rows of their tables, against brute force."""

import math
import os

import pytest

from gridloom.operators import cost, distance
from gridloom.operators.grid import GridSpec
from gridloom.plans.analogues import QUERIES, cells, sites, targets

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@needs_tables
def test_all_targets_take_part(spark):
    assert targets(spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_nearest_and_counts_by_brute_force(spark):
    p = [(k, 10.0 + k * 7 % 40 * 0.001, -10.0 - k * 13 % 40 * 0.001) for k in range(12)]
    t = [("gov" if k % 3 else "wb", 10.0 + k * 11 % 100 * 0.0005, -10.0 - k * 17 % 100 * 0.0005) for k in range(60)]
    points, goals = spark.createDataFrame(p, "site_id int, lon double, lat double"), spark.createDataFrame(t, "layer string, lon double, lat double")
    pairs = points.crossJoin(goals.toDF("layer", "t_lon", "t_lat")).select("site_id", "layer", distance.haversine_km("lon", "lat", "t_lon", "t_lat").alias("d")).collect()
    for r in distance.nearest_and_counts(points, goals, (1.0, 3.0), layers=["gov", "wb"]).collect():
        for la in ("gov", "wb"):
            d = [x.d for x in pairs if x.site_id == r.site_id and x.layer == la]
            assert r[f"dist_km_nearest_{la}"] == pytest.approx(min(d)) and [r[f"count_{la}_le{k}km"] for k in (1, 3)] == [sum(x <= k for x in d) for k in (1, 3)]


def test_pairs_are_between_distinct_places(spark, monkeypatch):
    """Copies of a place are counted, not measured again; copies at the far end search the tree once."""
    p = [(k, 10.0 + k % 3 * 0.01, -10.0) for k in range(90)] + [(90, None, -10.0), (91, None, -10.0)]
    t = [("gov" if k % 2 else "wb", 10.0 + k % 5 * 0.01, -10.0) for k in range(400)] + [("oth", 40.0, 20.0)] * 7
    points, goals = spark.createDataFrame(p, "site_id int, lon double, lat double"), spark.createDataFrame(t, "layer string, lon double, lat double")
    rows, pairs, search = [], distance.radius_pairs, distance.nearest

    def counted(*args):
        out = pairs(*args)
        rows.append(out.count())
        return out

    def searched(far, targets, measure):
        rows.append(far.count())
        return search(far, targets, measure)

    monkeypatch.setattr(distance, "radius_pairs", counted)
    monkeypatch.setattr(distance, "nearest", searched)
    got = {r.site_id: r for r in distance.nearest_and_counts(points, goals, (2.0, 9.0), layers=["gov", "wb", "oth"]).collect()}
    assert len(got) == 92 and rows == [3 * 10, 4]
    for k, lon, _ in p[:90]:
        for la in ("gov", "wb"):
            assert [got[k][f"count_{la}_le{r}km"] for r in (2, 9)] == [sum(x == la and abs(at - lon) < w for x, at, _ in t) for w in (0.015, 1.0)]
            assert got[k][f"dist_km_nearest_{la}"] == 0.0
        assert got[k].dist_km_nearest_oth > 1000 and got[k].count_oth_le9km == 0
    assert got[90].count_gov_le9km == got[91].count_gov_le9km == 0 and got[91].dist_km_nearest_oth is None


@needs_tables
def test_table_s4_of_copies(spark, monkeypatch, tmp_path):
    """Six copies of both tables with keys shifted by a multiple of all moduli: the same places, six times the projects."""
    for name, key in (("supplier", "s_suppkey"), ("part", "p_partkey")):
        copies = spark.read.parquet(f"{SF}/{name}.parquet").crossJoin(spark.range(6).toDF("copy"))
        copies.withColumn(key, copies[key] + copies["copy"] * 600_000).drop("copy").write.parquet(f"{tmp_path}/{name}.parquet")
    rows, pairs = [], distance.radius_pairs

    def counted(*args):
        out = pairs(*args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(distance, "radius_pairs", counted)
    one, six = (distance.nearest_and_counts(sites(spark, d), targets(spark, d), (3.0,), layers=["gov", "wb", "oth"]) for d in (SF, str(tmp_path)))
    most = sorted(((-r.count_gov_le3km - r.count_wb_le3km - r.count_oth_le3km, r.site_id) for r in one.collect()))
    assert rows[0] == rows[1] > 0
    want = sorted((6 * n, k + 600_000 * i) for n, k in most for i in range(6))[:10]
    assert [(-r.projects, r.site_id) for r in QUERIES["table_s4"](spark, str(tmp_path)).collect()] == want and six.count() == 6 * len(most)


@needs_tables
def test_table_s4_counts_without_searching(spark, monkeypatch):
    """The table needs the counts within 3 km alone: nothing is searched beyond, nothing written."""
    want = sorted((-r.count_gov_le3km - r.count_wb_le3km - r.count_oth_le3km, r.site_id) for r in distance.nearest_and_counts(sites(spark, SF), targets(spark, SF), (1.0, 3.0), layers=["gov", "wb", "oth"]).collect())[:10]

    def refused(*args):
        raise AssertionError("table_s4 searched or wrote")

    monkeypatch.setattr(distance, "nearest", refused)
    monkeypatch.setattr(distance, "written", refused)
    assert [(-r.projects, r.site_id) for r in QUERIES["table_s4"](spark, SF).collect()] == want


def test_counts_alone_are_those_beside_the_distances(spark):
    """Copies, layers without targets near or at all, points far off or without a place."""
    points = spark.createDataFrame([(k, 10.0 + k % 4 * 0.01, -10.0) for k in range(12)] + [(12, 60.0, 60.0), (13, None, -10.0)], "site_id int, lon double, lat double")
    goals = spark.createDataFrame([("gov" if k % 2 else "wb", 10.0 + k % 5 * 0.01, -10.0) for k in range(40)] + [("oth", 40.0, 20.0), ("gov", None, 1.0), ("else", 10.0, -10.0)], "layer string, lon double, lat double")
    layers = ["gov", "wb", "oth", "none"]
    got = distance.counts_within(points, goals, (2.0, 9.0), layers=layers)
    both = distance.nearest_and_counts(points, goals, (2.0, 9.0), layers=layers).select(*got.columns)
    assert got.columns == ["site_id", "lon", "lat", *(f"count_{la}_le{r}km" for la in layers for r in (2, 9))]
    rows = sorted(got.collect(), key=lambda r: r.site_id)
    assert rows == sorted(both.collect(), key=lambda r: r.site_id) and len(rows) == 14 and rows[0].count_gov_le9km == 20 and rows[12].count_gov_le9km == rows[13].count_gov_le9km == 0
    assert "count_else_le2km" in distance.counts_within(points, goals, (2.0,)).columns


def relaxed(f, start, dy, dx, cutoff):
    """Least minutes by relaxing all pairs of neighbours until nothing falls."""
    best = {start: 0.0} if start in f else {}
    while True:
        old = dict(best)
        for (r, c), m in old.items():
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    to = (r + i, c + j)
                    if (i or j) and to in f and (new := m + math.hypot(i * dy, j * dx) * (f[r, c] + f[to]) / 2) <= cutoff:
                        best[to] = min(best.get(to, math.inf), new)
        if best == old:
            return best


def test_travel_minutes_of_many_sites_by_brute_force(spark):
    spec = GridSpec(10.0, -10.0, 0.01, 0.01, 7, 7)
    f = {(r, c): 1.0 + (r * 5 + c * 3) % 7 for r in range(7) for c in range(7) if (r, c) not in {(3, 1), (3, 2), (3, 3)}}
    starts = {k: (k * 13 % 7, k * 3 % 7) for k in range(9)} | {9: (3, 2)}
    land = spark.createDataFrame([(r, c, v) for (r, c), v in f.items()], "row int, col int, friction double")
    got = cost.travel_minutes(spark.createDataFrame([(k, *rc) for k, rc in starts.items()], "site_id int, row int, col int"), land, spec, 15.0).collect()
    want = {(k, *rc): m for k, s in starts.items() for rc, m in relaxed(f, s, *cost.sampling_km(spec), 15.0).items()}
    assert {(r.site_id, r.row, r.col): r.minutes for r in got} == pytest.approx(want)


@needs_tables
def test_all_sites_travel(spark):
    land = {(r.row, r.col) for r in cells(spark, SF).select("row", "col").collect()}
    want = {r.site_id for r in sites(spark, SF).collect() if (r.row, r.col) in land}
    assert {r.site_id for r in QUERIES["cost_distance"](spark, SF).select("site_id").distinct().collect()} == want and len(want) > 3
