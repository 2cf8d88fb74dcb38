"""Exact selection by counted slices against sorting, and maps as PNG files."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import ordered, raster, select
from gridloom.operators.grid import GridSpec
from gridloom.sources import figures


def draws(n=1500):
    r = random.Random(1)
    value = lambda: r.choice([None, 0.0, -1.5, r.gauss(0, 1), 10 ** r.uniform(-300, 300), -(10 ** r.uniform(-5, 5)), 3.0, 3.0, float("inf")])
    return [(r.choice("ab"), value(), float(r.randint(0, 5)), r.choice([1.0, 2.0, None])) for _ in range(n)]


@pytest.mark.parametrize("most", [200_000, 20, 0])
def test_quantiles_with_ties_weights_and_groups(spark, most):
    df = spark.createDataFrame(draws(), "k string, v double, w double, u double").repartition(5)
    want = {"a": ("v", 0.25), "b": ("v", 0.5), "c": ("u", 0.9), "d": ("u", 1.0), "e": ("v", 0.0), "f": ("u", 0.5)}
    plain = [F.percentile(c, p).alias(n) for n, (c, p) in want.items()]
    assert sorted(map(tuple, ordered.quantiles(df, want, ["k"], most=most).collect())) == sorted(map(tuple, df.groupBy("k").agg(*plain).collect()))
    assert tuple(ordered.quantiles(df, want, most=most).first()) == tuple(df.agg(*plain).first())
    weighted = ordered.quantiles(df, {"m": ("v", 0.5)}, ["k"], "w", most=most).collect()
    assert sorted(map(tuple, weighted)) == sorted(map(tuple, df.groupBy("k").agg(F.expr("percentile(v, 0.5, cast(w as bigint))")).collect()))
    assert ordered.scalar_quantiles(df.limit(0), want) == dict.fromkeys(want)


@pytest.mark.parametrize("most", [200_000, 7, 0])
@pytest.mark.parametrize("tied", [False, True])
def test_top_area_stops_at_its_cell(spark, most, tied):
    r = random.Random(3)
    rows = [(k, i // 12, i % 12, 5.0 if tied else r.choice([None, 1.0, 2.0, r.random()]), r.choice([0.5, 1.0, 1.5])) for k in "ab" for i in range(144)]
    df = spark.createDataFrame(rows, "aoi string, row int, col int, v double, area_km2 double").repartition(4)
    for target in (0.0, 0.7, 31.0, 1e6):
        got = {(x.aoi, x.row, x.col): x.selected for x in select.top_area(df, "v", target, most=most).collect()}
        for k in "ab":
            total, first = 0.0, True
            for row in sorted((x for x in rows if x[0] == k and x[3] is not None), key=lambda x: (-x[3], x[1], x[2])):
                assert got[k, row[1], row[2]] == int(total < target or first), (target, row)
                total, first = total + row[4], False
            assert all(got[k, x[1], x[2]] is None for x in rows if x[0] == k and x[3] is None)


def test_percent_by_a_column(spark):
    df = spark.createDataFrame([(k, i, 0, float(i)) for k in ("a", "b") for i in range(100)], "aoi string, row int, col int, v double")
    p = F.when(F.col("aoi") == "a", 10.0).otherwise(50.0)
    assert {r.aoi: r.n for r in select.top_percent(df, "v", p).groupBy("aoi").agg(F.sum("selected").alias("n")).collect()} == {"a": 10, "b": 50}


def test_joined_checksums():
    r = random.Random(2)
    for n in (0, 1, 70_000):
        a, b = r.randbytes(r.randint(0, 100_000)), r.randbytes(n)
        assert figures.joined_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_maps(spark, tmp_path):
    spec = GridSpec(0.0, 0.0, 1.0, 1.0, 2100, 1000)
    rows = [(0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (0, 3, -1.0), (0, 4, None), (0, 5, float("nan")), (2099, 999, 0.5), (5000, 1, 1.0)]
    path = f"file://{tmp_path}/map.png"
    figures.write_map(spark.createDataFrame(rows, "row int, col int, v double"), "v", path, spec, 0.0, 1.0)
    data = (tmp_path / "map.png").read_bytes()
    shades = figures.png_shades(data)
    want = np.zeros((2100, 1000), np.uint8)
    want[0, :4], want[2099, 999] = (1, 255, 255, 1), 128
    assert (shades == want).all() and data.count(b"IDAT") == 5
    assert figures.read_png(spark, path).filter("shade > 0").count() == 5
    with pytest.raises(ValueError):
        figures.png_shades(data[:60] + bytes([data[60] ^ 1]) + data[61:])
    assert figures.palette()[0] == (255, 255, 255) and figures.palette()[1] == figures.RAMP[0] and figures.palette()[255] == figures.RAMP[-1]


def test_indicators_of_zones(spark):
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, None)], "row int, col int, zone_id int")
    values = spark.createDataFrame([(1, 5.0, "x"), (2, float("nan"), "y")], "zone_id int, a double, b string")
    got = {r.col: r.a for r in raster.indicator_layers(cells, values, ["a"]).collect()}
    assert got == {0: 5.0, 1: None, 2: None}
