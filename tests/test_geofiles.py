"""GeoTIFF and shapefile decoding, reference systems."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import projection
from gridloom.operators.grid import GridSpec
from gridloom.sources import geofiles

SHORT, LONG, TEXT, DOUBLE = 3, 4, 2, 12
FORMS = {SHORT: "H", LONG: "I", DOUBLE: "d"}


def tiff(order, grid, rows, compress, method, predictor=1, tile=None, extra=()):
    """A file of one band in strips of `rows` rows, or in square tiles, built field by field."""
    h, w = grid.shape
    kind = {"u": 1, "i": 2, "f": 3}[grid.dtype.kind]
    if tile:
        padded = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), grid.dtype)
        padded[:h, :w] = grid
        blocks = [padded[r : r + tile, c : c + tile] for r in range(0, h, tile) for c in range(0, w, tile)]
    else:
        blocks = [grid[r : r + rows] for r in range(0, h, rows)]
    raw = []
    for b in blocks:
        if predictor == 2:
            b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(grid.dtype)
        data = b.astype(grid.dtype.newbyteorder(order)).tobytes()
        if predictor == 3:
            out = b""
            for row in b.astype(grid.dtype.newbyteorder(">")):
                plane = np.frombuffer(row.tobytes(), np.uint8).reshape(-1, grid.dtype.itemsize).T.ravel()
                out += np.concatenate([plane[:1], np.diff(plane)]).astype(np.uint8).tobytes()
            data = out
        raw.append(compress(data))
    fields = [(256, LONG, [w]), (257, LONG, [h]), (258, SHORT, [grid.dtype.itemsize * 8]), (259, SHORT, [method]), (262, SHORT, [1]), (277, SHORT, [1]), (317, SHORT, [predictor]), (339, SHORT, [kind]), *extra]
    fields += [(322, LONG, [tile]), (323, LONG, [tile])] if tile else [(278, LONG, [rows])]
    n = len(fields) + 2
    at = 8 + 2 + 12 * n + 4
    body, offsets = b"", []
    for b in raw:
        offsets.append(at + len(body))
        body += b
    fields += [(324 if tile else 273, LONG, offsets), (325 if tile else 279, LONG, [len(b) for b in raw])]
    entries = b""
    for tag, t, v in sorted(fields):
        data = v.encode() + b"\0" if t == TEXT else struct.pack(f"{order}{len(v)}{FORMS[t]}", *v)
        count = len(data) if t == TEXT else len(v)
        if len(data) > 4:
            place = struct.pack(order + "I", at + len(body))
            body += data
        else:
            place = data.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, t, count) + place
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, n) + entries + struct.pack(order + "I", 0) + body


def lzw_encode(data):
    codes, table, word = [(256, 9)], {bytes([i]): i for i in range(256)}, b""
    nxt, width = 258, 9
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        codes.append((table[word], width))
        table[longer] = nxt
        nxt += 1
        word = bytes([b])
        if nxt == 4095:
            codes.append((table[word], 12))
            codes.append((256, 12))
            table, nxt, width, word = {bytes([i]): i for i in range(256)}, 258, 9, b""
        else:
            width = 9 if nxt <= 511 else 10 if nxt <= 1023 else 11 if nxt <= 2047 else 12
    if word:
        codes.append((table[word], width))
        nxt += 1
        width = 9 if nxt <= 511 else 10 if nxt <= 1023 else 11 if nxt <= 2047 else 12
    codes.append((257, width))
    bits = "".join(f"{c:0{n}b}" for c, n in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_lzw():
    rng = np.random.default_rng(5)
    for data in (b"", b"a", b"ab" * 5000, rng.integers(0, 256, 20_000).astype(np.uint8).tobytes(), rng.integers(0, 3, 30_000).astype(np.uint8).tobytes()):
        assert geofiles.lzw_decode(lzw_encode(data)) == data


def test_packbits():
    assert geofiles.packbits_decode(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])).hex() == "aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa"


FRAME = [(33550, DOUBLE, [0.5, 0.25, 0.0]), (33922, DOUBLE, [0.0, 0.0, 0.0, 10.0, -3.0, 0.0])]
GEOGRAPHIC = [(34735, SHORT, [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326])]
PLAIN = (bytes, 1)
DEFLATED = (zlib.compress, 8)
LZW = (lzw_encode, 5)


@pytest.mark.parametrize(
    "order,dtype,rows,how,predictor,tile",
    [("<", "f4", 3, PLAIN, 1, None), (">", "f4", 4, LZW, 3, None), ("<", "f8", 50, DEFLATED, 3, 16), (">", "i2", 5, DEFLATED, 2, None), ("<", "u1", 7, LZW, 2, 16), ("<", "i4", 11, LZW, 1, 16)],
)
def test_geotiff_layouts(spark, tmp_path, order, dtype, rows, how, predictor, tile):
    grid = (np.arange(11 * 19).reshape(11, 19) * 37 % 200).astype(dtype)
    grid[2, 3] = 99
    (tmp_path / "a.tif").write_bytes(tiff(order, grid, rows, *how, predictor, tile, [*FRAME, *GEOGRAPHIC, (42113, TEXT, "99")]))
    out, spec = geofiles.read_geotiff(spark, str(tmp_path / "a.tif"))
    got = {(r.row, r.col): r.value for r in out.collect()}
    assert got == {(r, c): float(v) for (r, c), v in np.ndenumerate(grid) if v != 99}
    assert spec == GridSpec(10.0, -3.0, 0.5, 0.25, 11, 19, "EPSG:4326")


def test_point_ties_projected_systems_and_refusals():
    keys = (34735, SHORT, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 2, 3072, 0, 1, 32733])
    grid = np.zeros((2, 2), "f4")
    meta = geofiles.tiff_layout(*geofiles.tiff_tags(tiff("<", grid, 2, *PLAIN, extra=[*FRAME, keys])))
    assert meta["crs"] == "EPSG:32733" and meta["frame"] == (9.75, -2.875, 0.5, 0.25) and meta["nodata"] is None
    with pytest.raises(ValueError, match="not a TIFF"):
        geofiles.tiff_tags(b"PK\3\4" + bytes(20))
    turned = (34264, DOUBLE, [0.5, 0.1, 0, 10, 0.1, -0.5, 0, -3, 0, 0, 0, 0, 0, 0, 0, 1])
    with pytest.raises(ValueError, match="turned"):
        geofiles.tiff_layout(*geofiles.tiff_tags(tiff("<", grid, 2, *PLAIN, extra=[turned])))


def test_geotiff_written_and_read(spark, tmp_path):
    spec = GridSpec(10.0, -3.0, 0.5, 0.25, 3000, 1100, "EPSG:32733")  # four strips, of which the third holds nothing
    rows = [(0, 0, 1.5), (952, 1099, -2.0), (953, 5, 0.1), (2999, 7, 4.0), (10, 10, None), (3000, 0, 9.0), (0, 1100, 9.0)]
    geofiles.write_geotiff(spark.createDataFrame(rows, "row int, col int, v double"), "v", str(tmp_path / "b.tif"), spec)
    out, got = geofiles.read_geotiff(spark, str(tmp_path / "b.tif"))
    assert got == spec
    assert {(r.row, r.col): r.value for r in out.collect()} == {(0, 0): 1.5, (952, 1099): -2.0, (953, 5): float(np.float32(0.1)), (2999, 7): 4.0}
    nothing = spark.createDataFrame([], "row int, col int, v double")
    geofiles.write_geotiff(nothing, "v", str(tmp_path / "c.tif"), spec)
    assert geofiles.read_geotiff(spark, str(tmp_path / "c.tif"))[0].isEmpty()
    with pytest.raises(ValueError, match="reference system"):
        geofiles.write_geotiff(nothing, "v", str(tmp_path / "d.tif"), GridSpec(0, 0, 1, 1, 1, 1, ""))


def shapefile(folder, shapes, fields, rows):
    body = b""
    for k, s in enumerate(shapes):
        body += struct.pack(">2i", k + 1, len(s) // 2) + s
    (folder / "s.shp").write_bytes(struct.pack(">i", 9994) + bytes(96) + body)
    width = 1 + sum(n for _, _, n in fields)
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 32 + 32 * len(fields) + 1, width)
    for name, kind, n in fields:
        head += name.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([n, 0]) + bytes(14)
    data = b"".join(b" " + b"".join(v.encode().rjust(n) if kind == "N" else v.encode().ljust(n) for v, (_, kind, n) in zip(r, fields, strict=True)) for r in rows)
    (folder / "s.dbf").write_bytes(head + b"\r" + data + b"\x1a")
    return str(folder / "s.shp")


def test_shapefile(spark, tmp_path):
    ring, hole = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 2.0), (2.0, 3.0), (1.0, 3.0), (1.0, 2.0)]
    xy = [v for p in ring + hole for v in p]
    polygon = struct.pack("<i4d2i2i16d", 5, 0, 0, 4, 4, 2, 8, 0, 4, *xy)
    line_m = struct.pack("<i4d2ii4d2d2d", 23, 0, 0, 1, 1, 1, 2, 0, 0.0, 0.0, 1.0, 1.0, 0, 9, 5, 6)
    shapes = [polygon, line_m, struct.pack("<i2d", 1, 7.0, 8.0), struct.pack("<i", 0), struct.pack("<i4di4d", 8, 0, 0, 1, 1, 2, 0.0, 1.0, 1.0, 0.0)]
    rows = [("ä", "12", "T"), ("primary", "2.5", "F"), ("", "", "?"), ("x", "***", "N"), ("y", "-3", "Y")]
    path = shapefile(tmp_path, shapes, [("fclass", "C", 10), ("amount", "N", 6), ("ok", "L", 1)], rows)
    got = geofiles.read_shapefile(spark, path, "amount", layer="roads").sort("seq").collect()
    plain = [[[(v.x, v.y) for v in part] for part in r.parts] for r in got]
    assert plain == [[ring, hole], [[(0.0, 0.0), (1.0, 1.0)]], [[(7.0, 8.0)]], [], [[(0.0, 1.0), (1.0, 0.0)]]]
    assert [r.kind for r in got] == ["polygon", "line", "point", None, "point"]
    assert [(r.fclass, r.value) for r in got] == [("ä", 12.0), ("primary", 2.5), (None, None), ("x", None), ("y", -3.0)]
    assert json.loads(got[0].properties) == {"fclass": "ä", "amount": 12, "ok": True} and got[0].layer == "roads"


def place(spark, x, y, source, target):
    a, b = projection.transform_xy(F.lit(x).cast("double"), F.lit(y).cast("double"), source, target)
    return tuple(spark.range(1).select(a, b).first())


def test_reference_systems(spark):
    # a published place: 43 38 33.24 N, 79 23 13.7 W is 630084 east, 4833438 north in zone 17
    lon, lat = -(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600
    assert place(spark, lon, lat, "EPSG:4326", "EPSG:32617") == pytest.approx((630084, 4833438), abs=1.0)
    assert place(spark, 15.0, 0.0, "EPSG:4326", "EPSG:32733") == pytest.approx((500000, 10000000), abs=1e-6)
    assert place(spark, 180.0, 0.0, "EPSG:4326", "EPSG:3857") == pytest.approx((math.pi * 6378137, 0.0))
    for crs, x, y in (("EPSG:32617", lon, lat), ("EPSG:32733", 13.2, -8.8), ("EPSG:32733", 17.9, -17.9), ("EPSG:3857", -120.0, 70.0)):
        assert place(spark, *place(spark, x, y, "EPSG:4326", crs), crs, "OGC:CRS84") == pytest.approx((x, y), abs=1e-9)
    assert place(spark, 1.0, 2.0, None, "EPSG:3857") == (1.0, 2.0) and place(spark, None, 2.0, "EPSG:4326", "EPSG:3857")[0] is None
    with pytest.raises(ValueError, match="unknown"):
        projection.transform_xy("x", "y", "EPSG:2000")


def test_features_move(spark):
    f = spark.createDataFrame([(1, [[(0.0, 0.0), (180.0, 0.0)], []]), (2, None)], "feature_id long, parts array<array<struct<x:double,y:double>>>")
    got = {r.feature_id: r.parts for r in projection.reproject(f, "EPSG:4326", "EPSG:3857").collect()}
    assert got[2] is None and got[1][1] == [] and got[1][0][1].x == pytest.approx(math.pi * 6378137)
