"""Sinks (SNK): tables, CSV, sidecars, by area."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.grid import GridSpec, apply_mask
from gridloom.operators.profile import profile_columns
from gridloom.schema import empty_table
from gridloom.session import written


def out_path(root: str, aoi: str, stem: str, ext: str = "") -> str:
    """SNK-7."""
    return f"{root.rstrip('/')}/{aoi}_{stem}{ext}"


def write_cells(cells: DataFrame, path: str, spec: GridSpec, mode: str = "overwrite") -> None:
    """SNK-1: a grid table by area, with its georeference beside it; a grid without a reference system is refused."""
    if not spec.crs:
        raise ValueError("a grid needs a reference system")
    cells.write.mode(mode).partitionBy("aoi").parquet(path)
    write_json(cells.sparkSession, f"{path.rstrip('/')}.geo.json", {"crs": spec.crs, "transform": [spec.dx, 0.0, spec.x0, 0.0, -spec.dy, spec.y0, 0.0, 0.0, 1.0], "shape": [spec.height, spec.width]})


def write_masked(cells: DataFrame, layers: list[str], path: str, spec: GridSpec, policy: str = "mask", force: bool | None = None) -> None:
    """SNK-2."""
    write_cells(apply_mask(cells, layers, policy, force=force), path, spec)


def _csv_ready(df: DataFrame) -> DataFrame:
    """Arrays as "(a, b)", booleans as True and False, nulls empty."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.concat(F.lit("("), F.array_join(c.cast("array<string>"), ", "), F.lit(")"))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, "True").when(~c, "False")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, single: bool = True, mode: str = "overwrite") -> None:
    """SNK-3: header and comma; result tables are small, so they may be one file."""
    ready = _csv_ready(df)
    (ready.coalesce(1) if single else ready).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_empty(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """SNK-4."""
    write_csv(empty_table(spark, schema), path)


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """SNK-5: one small document, through the session's file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(json.dumps(document, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def write_profile(df: DataFrame, path: str) -> None:
    """SNK-8: the profile as JSON rows."""
    profile_columns(df).coalesce(1).write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """SNK-8: the profile as JSON rows, the columns with their places as CSV, and a text to read, below path."""
    profile = written(profile_columns(df), "profile")
    profile.coalesce(1).write.mode("overwrite").json(f"{path}/profile.json")
    order = F.create_map(*(F.lit(x) for i, c in enumerate(df.columns, 1) for x in (c, i)))
    placed = profile.withColumn("place", order[F.col("column")])
    write_csv(placed.select("place", "column", "type"), f"{path}/columns.csv")
    line = F.concat_ws(" ", F.format_string("%s (%s): %d nulls, %d distinct", "column", "type", "nulls", "distinct"), F.concat(F.lit(", "), F.format_string("%.6g to %.6g, mean %.6g, median %.6g", "min", "max", "mean", "median")), F.when(F.col("insights") != "", F.concat(F.lit("["), "insights", F.lit("]"))))
    text = placed.select("place", line.alias("value")).unionAll(profile.limit(1).select(F.lit(0), F.concat(F.lit("rows: "), F.col("rows").cast("string"))))
    text.repartition(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(f"{path}/profile.txt")
