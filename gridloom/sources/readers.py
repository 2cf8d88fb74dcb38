"""Sources (SRC): tables by path, optional and discovered paths, sniffed CSV, JSON, inline points, features, rasters.

All paths go through Hadoop's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.numeric import nan_to_null
from gridloom.schema import FEATURES
from gridloom.session import sized

DELIMITERS = (",", ";", "\t", "|")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return bool(fs.exists(where))


def first_existing(spark: SparkSession, paths: list[str], prefer: str | None = None) -> str | None:
    """SRC-4: the first path that exists, those that hold `prefer` first."""
    ordered = sorted(paths, key=lambda p: prefer is None or prefer not in p)
    return next((p for p in ordered if exists(spark, p)), None)


def discover(spark: SparkSession, patterns: list[str]) -> list[str]:
    """SRC-5: paths that match any of the glob patterns, in pattern order, each once."""
    out: list[str] = []
    for p in patterns:
        where, fs = _fs(spark, p)
        out += sorted(str(s.getPath()) for s in (fs.globStatus(where) or []) if str(s.getPath()) not in out)
    return out


def head_bytes(spark: SparkSession, path: str, most: int = 1 << 16) -> bytes:
    """The first bytes of a file, through the session's file systems."""
    one = spark.read.format("binaryFile").load(path).select(F.expr(f"substring(content, 1, {most})").alias("b")).first()
    return bytes(one["b"]) if one else b""


def sniff(sample: bytes) -> tuple[str, str]:
    """SRC-7: (delimiter, encoding): the delimiter whose count is the same and largest on the first five lines."""
    try:
        text, encoding = sample.decode("utf-8"), "UTF-8"
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data" and e.start > len(sample) - 4:
            text, encoding = sample[: e.start].decode("utf-8"), "UTF-8"
        else:
            text, encoding = sample.decode("latin-1"), "ISO-8859-1"
    lines = [x for x in io.StringIO(text).read().splitlines() if x.strip()][:5]
    best = max(((min(counts), d) for d in DELIMITERS if (counts := [x.count(d) for x in lines]) and min(counts) == max(counts) and min(counts) > 0), key=lambda x: x[0], default=None)
    if best:
        return best[1], encoding
    try:
        return csv.Sniffer().sniff(text[:4096], "".join(DELIMITERS)).delimiter, encoding
    except csv.Error:
        return ",", encoding


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """SRC-6: header, empty text is null; without a schema all columns are text (no inference pass)."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("nullValue", "")
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path)


def read_csv_auto(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """SRC-7."""
    sep, encoding = sniff(head_bytes(spark, path))
    return read_csv(spark, path, schema, sep, encoding)


def read_optional(spark: SparkSession, path: str | None, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame | None:
    """SRC-3: the table, or None where there is none."""
    if path is None or not exists(spark, path):
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nan_to_null({"parquet": reader.parquet, "orc": reader.orc, "json": reader.json}[kind](path) if kind != "csv" else read_csv(spark, path, schema))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """SRC-9: a document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def inline_points(spark: SparkSession, points: list[dict]) -> DataFrame:
    """SRC-10: points of a configuration: name, lon, lat."""
    return spark.createDataFrame([(p["name"], float(p["lon"]), float(p["lat"])) for p in points], "name string, lon double, lat double")


def read_cells(spark: SparkSession, path: str, aoi: str | None = None) -> DataFrame:
    """SRC-1: a grid table, one partition per area; NaN becomes null."""
    cells = nan_to_null(spark.read.parquet(path))
    return cells if aoi is None else cells.filter(F.col("aoi") == aoi)


def _numbered_lines(spark: SparkSession, path: str, keep) -> DataFrame:
    """(line, nth) of a file's lines for which keep(value) holds, numbered from 0 in the file's order.

    Lines are read in blocks in parallel; each block's lines are counted and the counts added up over the blocks, so no task
    sees all lines.
    """
    lines = spark.read.text(path).withColumn("at", F.col("_metadata.file_block_start")).withColumn("id", F.monotonically_increasing_id())
    lines = lines.withColumns({"block": F.shiftright("id", 33), "place": F.col("id").bitwiseAND((1 << 33) - 1)}).filter(keep(F.col("value")))
    per = lines.groupBy("block").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    before = per.select("block", (F.sum("n").over(Window.orderBy("at", "block")) - F.col("n")).alias("before"))  # one row per block of a file
    inside = F.row_number().over(Window.partitionBy("block").orderBy("place")) - 1
    return lines.withColumn("inside", inside).join(sized(before), "block").select(F.col("value").alias("line"), (F.col("before") + F.col("inside")).alias("nth"))


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """SRC-1: an ESRI ASCII raster: (row, col, value) without no-data cells, and its header. Lines are read in parallel."""
    head = {}
    for line in head_bytes(spark, path, 4096).decode("ascii", "replace").splitlines():
        parts = line.split()
        if len(parts) != 2 or not parts[0][0].isalpha():
            break
        head[parts[0].lower()] = float(parts[1])
    rows = _numbered_lines(spark, path, lambda v: ~v.rlike("^\\s*[A-Za-z]")).select(F.col("nth").cast("int").alias("row"), F.split(F.trim("line"), "\\s+").alias("v"))
    out = rows.select("row", F.posexplode("v").alias("col", "text")).select("row", "col", F.col("text").try_cast("double").alias("value"))
    return out.filter((F.col("value") != head.get("nodata_value", float("nan"))) & F.col("value").isNotNull()), head


#: A feature that fills a line of a GeoJSON document, and what else its lines may hold: the collection's head and end.
_FEATURE_LINE = r'^\s*\{.*"geometry".*\}\s*,?\s*$'
_OTHER_LINE = r'^\s*$|^\s*[\]\}][\s\]\},]*$|^\s*\{?\s*$|^\s*\{?\s*"(type|name|crs|features|bbox|xy_coordinate_resolution)"\s*:'


def _feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(seq, f): the features of a GeoJSON document as JSON texts.

    Documents with a feature to a line, as the usual tools write them, are read in blocks by all tasks, features being found
    where lines end; others, on one line or over many, by one task.
    """
    lines = spark.read.text(path)
    feature = lambda v: v.rlike(_FEATURE_LINE) & ~v.rlike(r'"features"\s*:\s*\[') & (F.get_json_object(F.regexp_replace(v, r",\s*$", ""), "$.geometry").isNotNull() | v.rlike(r'"geometry"\s*:\s*null'))
    found = lines.agg(F.count_if(feature(F.col("value"))).alias("features"), F.count_if(~feature(F.col("value")) & ~F.col("value").rlike(_OTHER_LINE)).alias("others"), F.count_if(F.col("value").rlike(r'"features"\s*:\s*\[') & F.col("value").rlike('"geometry"')).alias("joined")).first()
    if found["features"] and not found["others"] and not found["joined"]:
        return _numbered_lines(spark, path, feature).select(F.col("nth").alias("seq"), F.regexp_replace("line", r",\s*$", "").alias("f"))
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("seq", "f"))


def read_geojson(spark: SparkSession, path: str, value: str | None = None, fclass: str = "fclass", layer: str = "layer") -> DataFrame:
    """SRC-2: features of a GeoJSON document as the feature table; points, lines, polygons and their multiples."""
    items = _feature_texts(spark, path)
    kind = F.get_json_object("f", "$.geometry.type")
    raw = F.get_json_object("f", "$.geometry.coordinates")
    pt = "array<double>"
    shape = {"Point": F.array(F.array(F.from_json(raw, pt))), "MultiPoint": F.array(F.from_json(raw, f"array<{pt}>")), "LineString": F.array(F.from_json(raw, f"array<{pt}>")), "MultiLineString": F.from_json(raw, f"array<array<{pt}>>"), "Polygon": F.from_json(raw, f"array<array<{pt}>>"), "MultiPolygon": F.flatten(F.from_json(raw, f"array<array<array<{pt}>>>"))}
    coords = None
    for k, c in shape.items():
        coords = F.when(kind == k, c) if coords is None else coords.when(kind == k, c)
    parts = F.transform(coords, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    plain = F.when(kind.contains("Point"), "point").when(kind.contains("Line"), "line").otherwise("polygon")
    val = F.get_json_object("f", f"$.properties.{value}").try_cast("double") if value else F.lit(1.0)
    out = items.select(F.lit(layer).alias("layer"), F.col("seq").cast("long").alias("feature_id"), F.col("seq").cast("int").alias("seq"), plain.alias("kind"), F.get_json_object("f", f"$.properties.{fclass}").alias("fclass"), val.alias("value"), parts.alias("parts"), F.get_json_object("f", "$.properties").alias("properties"))
    return out


def features_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A feature table from (layer, id, seq, kind, fclass, value, [[(x, y), ...], ...])."""
    return spark.createDataFrame(rows, FEATURES)
