"""GeoJSON documents in all layouts."""

import json

import pytest

from gridloom.sources import readers


def document(n):
    shapes = [("Point", [1.5, 2.5]), ("LineString", [[0, 0], [1, 1], [2, 0]]), ("Polygon", [[[0, 0], [2, 0], [2, 2], [0, 0]], [[0.5, 0.2], [1, 0.2], [1, 0.5]]]), ("MultiPoint", [[1, 2], [3, 4]]), None]
    out = []
    for k in range(n):
        s = shapes[k % len(shapes)]
        out.append({"type": "Feature", "properties": {"fclass": f"class, {k} }},", "v": k * 1.5, "features": "no"}, "geometry": s and {"type": s[0], "coordinates": s[1]}})
    return out


def layouts(features):
    head = '{"type": "FeatureCollection",\n"name": "x",\n"crs": { "type": "name", "properties": { "name": "urn:ogc:def:crs:OGC:1.3:CRS84" } },\n"features": [\n'
    return {
        "lines": head + ",\n".join(json.dumps(f) for f in features) + "\n]\n}\n",
        "one": json.dumps({"type": "FeatureCollection", "features": features}),
        "pretty": json.dumps({"type": "FeatureCollection", "features": features}, indent=2),
        "joined": '{"type": "FeatureCollection", "features": [' + ",\n".join(json.dumps(f) for f in features) + "]}",
    }


@pytest.mark.parametrize("layout", ["lines", "one", "pretty", "joined"])
def test_features_in_any_layout(spark, tmp_path, layout):
    features = document(12)
    (tmp_path / "a.geojson").write_text(layouts(features)[layout])
    got = readers.read_geojson(spark, f"file://{tmp_path}/a.geojson", "v").orderBy("feature_id").collect()
    assert [r.feature_id for r in got] == list(range(12))
    for r, f in zip(got, features, strict=True):
        g = f["geometry"]
        assert (r.fclass, r.value) == (f["properties"]["fclass"], f["properties"]["v"])
        if g is None:
            assert r.parts is None
        elif g["type"] == "Polygon":
            assert [[(v.x, v.y) for v in ring] for ring in r.parts] == [[tuple(map(float, p)) for p in ring] for ring in g["coordinates"]] and r.kind == "polygon"


def test_lines_are_read_in_blocks(spark, tmp_path):
    features = document(400)
    (tmp_path / "b.geojson").write_text(layouts(features)["lines"])
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        out = readers.read_geojson(spark, f"file://{tmp_path}/b.geojson", "v")
        assert readers._feature_texts(spark, f"file://{tmp_path}/b.geojson").select("f").distinct().count() == 400
        assert {(r.feature_id, r.value) for r in out.collect()} == {(k, k * 1.5) for k in range(400)}
    finally:
        spark.conf.set(key, before)
