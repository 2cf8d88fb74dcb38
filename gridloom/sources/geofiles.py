"""GeoTIFF and shapefile (SRC-1, SRC-2, SNK-1), decoded from their published layouts over Spark's binaryFile source.

One task cuts a file into its blocks or records (binaryFile holds a file of up to 2 GB in one row); blocks are decoded in
parallel. Classic and big TIFF, either byte order, strips or tiles, plain, LZW, deflate and PackBits data, predictors 1 to 3.
"""

from __future__ import annotations

import itertools
import json
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import GridSpec
from gridloom.session import written

# Fixed values of the TIFF and GeoTIFF layouts: tags, field types, sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, MATRIX, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
KEY_MODEL, KEY_RASTER, KEY_GEOGRAPHIC, KEY_PROJECTED = 1024, 1025, 2048, 3072
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SAMPLE = {1: "u", 2: "i", 3: "f"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def tiff_tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first directory's tags."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack_from(f"{order}H", data, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, at + k * (20 if big else 12))
        place = at + k * (20 if big else 12) + (12 if big else 8)
        if kind not in FIELD:
            continue
        fmt = f"{order}{count}{FIELD[kind]}"
        if struct.calcsize(fmt) > (8 if big else 4):
            place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
        values = struct.unpack_from(fmt, data, place)
        tags[tag] = (b"".join(values).rstrip(b"\0").decode("latin-1"),) if kind == 2 else values
    return order, tags


def tiff_layout(order: str, tags: dict[int, tuple]) -> dict:
    """What decoding a block takes, and the georeference; cells at an angle to the axes are refused."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    height, width, bits, kind = tags[HEIGHT][0], tags[WIDTH][0], one(BITS, 1), SAMPLE.get(one(SAMPLE_FORMAT, 1))
    if kind is None or bits not in (8, 16, 32, 64):
        raise ValueError(f"samples of format {one(SAMPLE_FORMAT, 1)} and {bits} bits are not read")
    tiled = TILE_OFFSETS in tags
    block = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(one(STRIP_ROWS, height), height), width)
    keys = {k[0]: k[3] for k in (tags.get(GEO_KEYS, ())[i : i + 4] for i in range(4, len(tags.get(GEO_KEYS, ())), 4)) if k[1] == 0}
    if PIXEL_SCALE in tags and TIEPOINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIEPOINT][:5]
        frame = (x - i * sx, y + j * sy, sx, sy)
    elif MATRIX in tags:
        m = tags[MATRIX]
        if m[1] or m[4]:
            raise ValueError("turned rasters are not read")
        frame = (m[3], m[7], m[0], -m[5])
    else:
        frame = (0.0, 0.0, 1.0, 1.0)
    if keys.get(KEY_RASTER) == 2:  # the tie is a cell's centre
        frame = (frame[0] - frame[2] / 2, frame[1] + frame[3] / 2, *frame[2:])
    code = keys.get(KEY_PROJECTED) if keys.get(KEY_MODEL) == 1 else keys.get(KEY_GEOGRAPHIC)
    nodata = one(NODATA, "").strip()
    return {
        "order": order, "height": height, "width": width, "dtype": f"{order}{kind}{bits // 8}", "block": block, "samples": one(SAMPLES, 1), "planar": one(PLANAR, 1),
        "compression": one(COMPRESSION, PLAIN), "predictor": one(PREDICTOR, 1), "frame": frame, "crs": f"EPSG:{code}" if code and code != 32767 else "", "nodata": nodata or None,
    }


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, widened one code early; 256 clears, 257 ends."""
    out, table, width, last = bytearray(), [], 9, None
    held = bits = 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([b]) for b in range(256)] + [b"", b""], 9, None
            continue
        word = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + word[:1])
            if len(table) == (1 << width) - 1 and width < 12:
                width += 1
        out += word
        last = word
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    """Runs: n below 128 copies n + 1 bytes, n above 128 repeats the next one 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def decode_block(data: bytes, meta: dict, rows: int, band: int) -> np.ndarray:
    """One block's samples of a band, (rows, block width)."""
    method = meta["compression"]
    if method in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif method == LZW:
        data = lzw_decode(data)
    elif method == PACKBITS:
        data = packbits_decode(data)
    elif method != PLAIN:
        raise ValueError(f"compression {method} is not read")
    kind, width, samples = np.dtype(meta["dtype"]), meta["block"][1], meta["samples"] if meta["planar"] == 1 else 1
    size = rows * width * samples * kind.itemsize
    if meta["predictor"] == 3:  # bytes of a row by significance, each the difference to the one before
        planes = np.cumsum(np.frombuffer(data, np.uint8, size).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        values = np.ascontiguousarray(planes.reshape(rows, kind.itemsize, -1).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, width, samples)
    else:
        values = np.frombuffer(data[:size], kind).reshape(rows, width, samples)
        if meta["predictor"] == 2:
            values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
    return values[:, :, band if meta["planar"] == 1 else 0]


def _blocks(data: bytes, band: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(first row, first column, rows held, bytes) of a band's blocks; blocks left out of the file are left out."""
    order, tags = tiff_tags(data)
    meta = tiff_layout(order, tags)
    (rows, cols), tiled = meta["block"], TILE_OFFSETS in tags
    across, down = math.ceil(meta["width"] / cols), math.ceil(meta["height"] / rows)
    if not 0 <= band < meta["samples"]:
        raise ValueError(f"no band {band + 1} of {meta['samples']}")
    start = band * across * down if meta["planar"] == 2 else 0
    places, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    for k in range(across * down):
        r, c, at, n = k // across * rows, k % across * cols, places[start + k], sizes[start + k]
        if n:
            yield r, c, rows if tiled else min(rows, meta["height"] - r), data[at : at + n]


def geotiff_layout(spark: SparkSession, path: str) -> dict:
    """A file's layout and georeference, read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"meta": [json.dumps(tiff_layout(*tiff_tags(bytes(b)))) for b in pdf["content"]]})

    return json.loads(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "meta string").first()["meta"])


def read_geotiff(spark: SparkSession, path: str, band: int = 1) -> tuple[DataFrame, GridSpec]:
    """SRC-1: (row, col, value) without no-data and NaN cells, and the grid; a file without a reference system has crs ""."""
    meta = geotiff_layout(spark, path)
    missing = math.nan if meta["nodata"] is None else float(meta["nodata"])
    if np.dtype(meta["dtype"]).kind == "f":
        missing = float(np.array(missing, meta["dtype"]))  # written in decimals, held in the file's own type

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                for block in _blocks(bytes(content), band - 1):
                    yield pd.DataFrame([block], columns=["r0", "c0", "rows", "data"])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                v = decode_block(bytes(b.data), meta, b.rows, band - 1)[: meta["height"] - b.r0, : meta["width"] - b.c0].astype("float64")
                r, c = np.nonzero(~np.isnan(v) & (v != missing))
                yield pd.DataFrame({"row": (r + b.r0).astype("int32"), "col": (c + b.c0).astype("int32"), "value": v[r, c]})

    blocks = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "r0 int, c0 int, rows int, data binary")
    out = blocks.repartition("r0", "c0").mapInPandas(decode, "row int, col int, value double")
    x0, y0, dx, dy = meta["frame"]
    return out, GridSpec(x0, y0, dx, dy, meta["height"], meta["width"], meta["crs"])


def _directory(entries: list[tuple[int, int, tuple]], at: int) -> bytes:
    """A little-endian classic directory at byte `at`, its long values behind it."""
    fixed, spare = b"", b""
    end = at + 2 + 12 * len(entries) + 4
    for tag, kind, values in sorted(entries):
        raw = values[0].encode("latin-1") + b"\0" if kind == 2 else struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", end + len(spare))
        spare += b"" if len(raw) <= 4 else raw + b"\0" * (len(raw) % 2)
        fixed += struct.pack("<HHI", tag, kind, len(raw) if kind == 2 else len(values)) + place
    return struct.pack("<H", len(entries)) + fixed + struct.pack("<I", 0) + spare


def write_geotiff(cells: DataFrame, layer: str, path: str, spec: GridSpec) -> None:
    """SNK-1: a layer as one deflated float32 file with NaN as no data; a grid without an EPSG code is refused.

    Strips of up to a million cells are packed in parallel; the driver then streams them into the file one after another.
    """
    code = spec.crs.upper().removeprefix("EPSG:").replace("OGC:CRS84", "4326")
    if not code.isdigit():
        raise ValueError("a grid needs a reference system")
    spark, height, width = cells.sparkSession, spec.height, spec.width
    step = max(1, min(height, (1 << 20) // width))

    def strip(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["strip"].iloc[0])
        grid = np.full((min(step, height - k * step), width), np.nan, "<f4")
        grid[pdf["row"] - k * step, pdf["col"]] = pdf["v"].astype("float32")
        return pd.DataFrame({"strip": [k], "data": [zlib.compress(grid.tobytes())]})

    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    rows = cells.filter(inside).select("row", "col", F.col(layer).cast("double").alias("v"), F.floor(F.col("row") / step).cast("int").alias("strip"))
    packed = written(rows.groupBy("strip").applyInPandas(strip, "strip int, data binary"), "strips")
    count = math.ceil(height / step)
    blank = {n: zlib.compress(np.full((n, width), np.nan, "<f4").tobytes()) for n in {step, height - (count - 1) * step}}
    empty = [blank[min(step, height - k * step)] for k in range(count)]
    sizes = [len(b) for b in empty]
    for r in packed.select("strip", F.octet_length("data").alias("n")).collect():  # one number per million cells
        sizes[r["strip"]] = r["n"]
    geographic = spec.crs.upper() in ("EPSG:4326", "OGC:CRS84")
    keys = (1, 1, 0, 3, KEY_MODEL, 0, 1, 2 if geographic else 1, KEY_RASTER, 0, 1, 1, KEY_GEOGRAPHIC if geographic else KEY_PROJECTED, 0, 1, int(code))

    def head(places: list[int]) -> bytes:
        return struct.pack("<2sHI", b"II", 42, 8) + _directory([
            (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (32,)), (COMPRESSION, 3, (DEFLATE,)), (PHOTOMETRIC, 3, (1,)), (STRIP_OFFSETS, 4, tuple(places)), (SAMPLES, 3, (1,)),
            (STRIP_ROWS, 4, (step,)), (STRIP_BYTES, 4, tuple(sizes)), (PLANAR, 3, (1,)), (SAMPLE_FORMAT, 3, (3,)), (PIXEL_SCALE, 12, (spec.dx, abs(spec.dy), 0.0)),
            (TIEPOINT, 12, (0.0, 0.0, 0.0, spec.x0, spec.y0, 0.0)), (GEO_KEYS, 3, keys), (NODATA, 2, ("nan",)),
        ], 8)

    start = len(head([0] * count))
    places = list(itertools.accumulate([start, *sizes[:-1]]))
    if start + sum(sizes) >= 1 << 32:
        raise ValueError("a classic TIFF file ends at 4 GB; write the grid as a table")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(head(places)))
        at = 0
        for r in packed.sort("strip").toLocalIterator():
            for k in range(at, r["strip"]):
                out.write(bytearray(empty[k]))
            out.write(bytearray(r["data"]))
            at = r["strip"] + 1
        for k in range(at, count):
            out.write(bytearray(empty[k]))
    finally:
        out.close()


def shp_records(data: bytes) -> Iterator[tuple[int, str | None, list[list[tuple[float, float]]]]]:
    """(number from 0, kind, parts) of a .shp file; heights and measures are left out, empty shapes have no kind."""
    if struct.unpack_from(">i", data, 0)[0] != 9994:
        raise ValueError("not a shapefile")
    at, seq = 100, 0
    while at + 12 <= len(data):
        words = struct.unpack_from(">i", data, at + 4)[0]
        body = at + 8
        shape = struct.unpack_from("<i", data, body)[0] % 10
        if shape == 1:
            yield seq, "point", [[struct.unpack_from("<2d", data, body + 4)]]
        elif shape == 8:
            n = struct.unpack_from("<i", data, body + 36)[0]
            xy = struct.unpack_from(f"<{2 * n}d", data, body + 40)
            yield seq, "point", [list(zip(xy[::2], xy[1::2], strict=True))]
        elif shape in (3, 5):
            parts, n = struct.unpack_from("<2i", data, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), n]
            xy = struct.unpack_from(f"<{2 * n}d", data, body + 44 + 4 * parts)
            points = list(zip(xy[::2], xy[1::2], strict=True))
            yield seq, "line" if shape == 3 else "polygon", [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            yield seq, None, []
        at, seq = body + 2 * words, seq + 1


def dbf_records(data: bytes, encoding: str = "utf-8") -> Iterator[tuple[int, dict[str, str | float | bool | None]]]:
    """(number from 0, fields) of a .dbf file; numbers as floats or whole numbers, blanks as None. Deleted records keep their place."""
    count, start, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), chr(data[at + 11]), data[at + 16]))
        at += 32
    for k in range(count):
        at, row = start + k * size + 1, {}
        for name, kind, width in fields:
            text = data[at : at + width].split(b"\0")[0].decode(encoding, "replace").strip()
            at += width
            if kind in "NF":
                try:
                    row[name] = int(text) if text.lstrip("+-").isdigit() else float(text)
                except ValueError:
                    row[name] = None
            elif kind == "L":
                row[name] = {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
            else:
                row[name] = text or None
        yield k, row


def read_shapefile(spark: SparkSession, path: str, value: str | None = None, fclass: str = "fclass", layer: str = "layer", encoding: str = "utf-8") -> DataFrame:
    """SRC-2: features of a .shp file and the .dbf file beside it, as read_geojson gives them; empty shapes have no parts."""
    vertex = "array<array<struct<x:double,y:double>>>"

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                records = shp_records(bytes(content))
                while chunk := list(itertools.islice(records, 1000)):
                    yield pd.DataFrame([(seq, kind, [[{"x": x, "y": y} for x, y in ring] for ring in parts]) for seq, kind, parts in chunk], columns=["seq", "kind", "parts"])

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                records = dbf_records(bytes(content), encoding)
                while chunk := list(itertools.islice(records, 10_000)):
                    yield pd.DataFrame([(k, json.dumps(r)) for k, r in chunk], columns=["seq", "properties"])

    files = spark.read.format("binaryFile")
    left = files.load(path).select("content").mapInPandas(shapes, f"seq int, kind string, parts {vertex}")
    right = files.load(path[:-4] + (".DBF" if path.endswith(".SHP") else ".dbf")).select("content").mapInPandas(fields, "seq int, properties string")
    prop = lambda name: F.get_json_object("properties", f"$['{name}']")
    val = prop(value).try_cast("double") if value else F.lit(1.0)
    return left.join(right, "seq", "left").select(F.lit(layer).alias("layer"), F.col("seq").cast("long").alias("feature_id"), "seq", "kind", prop(fclass).alias("fclass"), val.alias("value"), "parts", "properties")


def write_shapefile(features: DataFrame, path: str, numbers: list[str]) -> None:
    """SNK: polygons as a .shp file, with number columns in the .dbf file beside it, in the order of the first of these.

    Records are packed in parallel; the driver streams them into both files. Rings stand as they are given.
    """
    spark = features.sparkSession
    width = 24

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rings = [[(v["x"], v["y"]) for v in ring] for ring in parts or []]
                rings = [r if r[0] == r[-1] else [*r, r[0]] for r in rings if r]
                xy = [v for r in rings for p in r for v in p]
                body = struct.pack("<i", 0)
                if rings:
                    starts = list(itertools.accumulate([0, *map(len, rings[:-1])]))
                    body = struct.pack("<i4d2i", 5, min(xy[::2]), min(xy[1::2]), max(xy[::2]), max(xy[1::2]), len(rings), len(xy) // 2) + struct.pack(f"<{len(rings)}i", *starts) + struct.pack(f"<{len(xy)}d", *xy)
                text = "".join(("" if v is None else f"{v:.15g}").rjust(width) for v in values)
                rows.append((values[0], body, b" " + text.encode()))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.float64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["k", "shape", "record"])

    packed = written(features.select("parts", *(F.col(c).cast("double").alias(c) for c in numbers)).mapInArrow(pack, "k double, shape binary, record binary"), "shapes")
    size = packed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("shape") + 8), F.lit(0)).alias("bytes")).first()
    fields = b"".join(struct.pack("<11sc4xBB14x", c.encode()[:10], b"N", width, 8) for c in numbers)
    heads = {
        path: struct.pack(">i20xi", 9994, (100 + size["bytes"]) // 2) + struct.pack("<2i", 1000, 5) + bytes(64),
        path[:-4] + ".dbf": struct.pack("<4BIHH20x", 3, 124, 1, 1, size["n"], 32 + 32 * len(numbers) + 1, 1 + width * len(numbers)) + fields + b"\r",
    }
    files = {}
    for name, head in heads.items():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        files[name] = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        files[name].write(bytearray(head))
    try:
        shp, dbf = files.values()
        for k, r in enumerate(packed.sort("k").toLocalIterator(), 1):
            shp.write(bytearray(struct.pack(">2i", k, len(r["shape"]) // 2) + r["shape"]))
            dbf.write(bytearray(r["record"]))
    finally:
        for out in files.values():
            out.close()
