"""Maps as PNG files (SNK-6), without a plotting library: strips of a grid are shaded and deflated in parallel and joined.

Each task shades some rows and deflates them as a closed run of blocks; runs simply follow one another in one stream, whose
checksum is put together from the parts' ones. The driver streams the strips into the file, one after another.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import GridSpec
from gridloom.session import written

#: Colours of the shades from low to high, between which the palette is linear; shade 0, no data, is clear.
RAMP = ((255, 255, 217), (127, 205, 187), (29, 145, 192), (8, 29, 88))
_BASE = 65521
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def palette(ramp: tuple[tuple[int, int, int], ...] = RAMP) -> list[tuple[int, int, int]]:
    """256 colours: shade 0 is white (clear), 1 to 255 run along the ramp."""
    at = np.linspace(0, len(ramp) - 1, 255)
    return [(255, 255, 255), *zip(*(np.rint(np.interp(at, range(len(ramp)), [c[k] for c in ramp])).astype(int).tolist() for k in range(3)), strict=True)]


def joined_adler(first: int, second: int, size: int) -> int:
    """The Adler-32 of two byte runs one after another, from theirs and the second's size."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % _BASE
    b = (b1 + b2 + size % _BASE * (a1 - 1)) % _BASE
    return b << 16 | a


def shade(value, low: float, high: float) -> Column:
    """1 to 255 from low to high, held there; 0 without a value."""
    part = (F.col(value) - low) / (high - low)
    held = F.least(F.lit(255), F.greatest(F.lit(1), 1 + F.floor(part * 255)))
    return F.when(part.isNotNull() & ~F.isnan(part), held).otherwise(0).cast("int")  # greatest() skips nulls


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_map(cells: DataFrame, layer: str, path: str, spec: GridSpec, low: float, high: float, ramp: tuple[tuple[int, int, int], ...] = RAMP) -> None:
    """SNK-6: one layer as a palette PNG, a pixel a cell; cells without a value, or not there, are clear."""
    if not high > low:
        raise ValueError("the range of shades is empty")
    spark, height, width = cells.sparkSession, spec.height, spec.width
    step = max(1, min(height, (1 << 20) // width))

    def packed(rows: np.ndarray) -> tuple[bytes, int, int]:
        raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()  # a filter byte of 0 before each row
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        return deflate.compress(raw) + deflate.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw), len(raw)

    def strip(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["strip"].iloc[0])
        grid = np.zeros((min(step, height - k * step), width), np.uint8)
        grid[pdf["row"] - k * step, pdf["col"]] = pdf["shade"]
        data, adler, size = packed(grid)
        return pd.DataFrame({"strip": [k], "data": [_chunk(b"IDAT", data)], "adler": [adler], "size": [size]})

    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    rows = cells.filter(inside).select("row", "col", shade(layer, low, high).alias("shade"), F.floor(F.col("row") / step).cast("int").alias("strip"))
    strips = written(rows.groupBy("strip").applyInPandas(strip, "strip int, data binary, adler long, size long"), "strips")
    blank = {n: packed(np.zeros((n, width), np.uint8)) for n in {step, height - (math.ceil(height / step) - 1) * step}}
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    adler, at = 1, 0

    def put(data: bytes, own: int, size: int) -> None:
        nonlocal adler
        out.write(bytearray(data))
        adler = joined_adler(adler, own, size)

    def clear(until: int) -> None:
        for k in range(at, until):
            data, own, size = blank[min(step, height - k * step)]
            put(_chunk(b"IDAT", data), own, size)

    try:
        out.write(bytearray(_SIGNATURE + _chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 3, 0, 0, 0)) + _chunk(b"PLTE", bytes(v for c in palette(ramp) for v in c)) + _chunk(b"tRNS", b"\0") + _chunk(b"IDAT", b"\x78\x9c")))
        for r in strips.sort("strip").toLocalIterator():
            clear(r["strip"])
            put(bytes(r["data"]), r["adler"], r["size"])
            at = r["strip"] + 1
        clear(math.ceil(height / step))
        out.write(bytearray(_chunk(b"IDAT", b"\x03\0" + struct.pack(">I", adler)) + _chunk(b"IEND", b"")))
    finally:
        out.close()


def png_shades(data: bytes) -> np.ndarray:
    """The shades of a map that write_map wrote."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, width, height = 8, b"", 0, 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + chunk):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colours = struct.unpack(">2I2B", chunk[:10])
            if (depth, colours) != (8, 3):
                raise ValueError("not a palette map")
        body += chunk if kind == b"IDAT" else b""
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:]


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, shade) of a map's pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                for r, row in enumerate(png_shades(bytes(content))):
                    yield pd.DataFrame({"row": np.int32(r), "col": np.arange(len(row), dtype=np.int32), "shade": row.astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row int, col int, shade int")
