"""Vector features to cells (RST): scanline spans, supercover lines, coverage shares, zone labels.

Features: (feature_id, seq, kind, value, parts) with parts an array of rings or lines of (x, y). Polygons follow the centre
rule: a cell is burnt if its centre lies inside (even-odd). Later features overwrite earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import ring_edges, with_geometry
from gridloom.operators.grid import GridSpec
from gridloom.session import sized


def pick_field(df: DataFrame, candidates: list[str], required: bool = False) -> str | None:
    """RST-10: the first of the candidates that is a column."""
    found = next((c for c in candidates if c in df.columns), None)
    if required and found is None:
        raise KeyError(f"none of {candidates} in {df.columns}")
    return found


def select_features(features: DataFrame, where: str | Column | None) -> DataFrame:
    """RST-9, FLT-1: an attribute filter before the burn."""
    return features if where is None else features.filter(where)


def polygon_cells(features: DataFrame, spec: GridSpec) -> DataFrame:
    """(feature_id, row, col) of the cells whose centres lie in each polygon: edge crossings by row, paired, spans exploded."""
    edges = with_geometry(features).select("feature_id", F.explode(F.flatten(F.transform("parts", ring_edges))).alias("e")).select("feature_id", "e.*").filter("y1 <> y2")
    centre = lambda y: (F.lit(spec.y0) - y) / spec.dy - 0.5  # noqa: E731  a y as a fractional row of centres
    top, bottom = centre(F.greatest("y1", "y2")), centre(F.least("y1", "y2"))
    lo, hi = F.greatest(F.ceil(top - 1e-9), F.lit(0)).cast("int"), F.least(F.floor(bottom + 1e-9), F.lit(spec.height - 1)).cast("int")
    rows = edges.withColumns({"lo": lo, "hi": hi}).filter("lo <= hi").withColumn("row", F.explode(F.sequence("lo", "hi")))
    y = F.lit(spec.y0) - (F.col("row") + 0.5) * spec.dy
    rows = rows.withColumn("yc", y).filter((F.col("y1") <= F.col("yc")) != (F.col("y2") <= F.col("yc")))
    rows = rows.withColumn("x", F.col("x1") + (F.col("yc") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    w = Window.partitionBy("feature_id", "row").orderBy("x")
    spans = rows.withColumns({"nth": F.row_number().over(w), "end": F.lead("x").over(w)}).filter("nth % 2 = 1 and end is not null")
    first = F.greatest(F.ceil((F.col("x") - spec.x0) / spec.dx - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil((F.col("end") - spec.x0) / spec.dx - 0.5) - 1, F.lit(spec.width - 1)).cast("int")
    spans = spans.select("feature_id", "row", first.alias("first"), last.alias("last")).filter("first <= last")
    return spans.select("feature_id", "row", F.explode(F.sequence("first", "last")).alias("col")).distinct()


def line_cells(features: DataFrame, spec: GridSpec, closed: bool = False, all_touched: bool = True) -> DataFrame:
    """RST-2: (feature_id, row, col) of the cells that lines pass (all_touched), or of points along them at half a cell."""
    if closed:
        edges = F.flatten(F.transform("parts", ring_edges))
    else:
        edges = F.flatten(F.transform("parts", lambda p: F.when(F.size(p) > 1, F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))))
    seg = with_geometry(features).select("feature_id", F.explode(edges).alias("e"))
    u = lambda x: (x - spec.x0) / spec.dx
    v = lambda y: (F.lit(spec.y0) - y) / spec.dy
    seg = seg.select("feature_id", u(F.col("e.x1")).alias("u1"), v(F.col("e.y1")).alias("v1"), u(F.col("e.x2")).alias("u2"), v(F.col("e.y2")).alias("v2"))
    if all_touched:
        # the segment's crossings with grid lines cut it into pieces that lie in one cell each: their midpoints name it
        def cuts(a: Column, b: Column) -> Column:
            lo, hi = F.floor(F.least(a, b)) + 1, F.ceil(F.greatest(a, b)) - 1
            return F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda k: (k - a) / (b - a))).otherwise(F.array().cast("array<double>"))

        ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts(F.col("u1"), F.col("u2")), cuts(F.col("v1"), F.col("v2")))))
        t = F.explode(F.zip_with(F.slice("ts", 1, F.size("ts") - 1), F.slice("ts", 2, F.size("ts") - 1), lambda a, b: (a + b) / 2))
        seg = seg.withColumn("ts", ts).withColumn("t", t)
    else:
        steps = F.greatest(F.lit(1), F.ceil(2 * F.greatest(F.abs(F.col("u2") - F.col("u1")), F.abs(F.col("v2") - F.col("v1"))))).cast("int")
        seg = seg.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps")))).withColumn("t", F.col("k") / F.col("steps"))
    at = seg.select("feature_id", F.floor(F.col("v1") + F.col("t") * (F.col("v2") - F.col("v1"))).cast("int").alias("row"), F.floor(F.col("u1") + F.col("t") * (F.col("u2") - F.col("u1"))).cast("int").alias("col"))
    return at.filter((F.col("row") >= 0) & (F.col("row") < spec.height) & (F.col("col") >= 0) & (F.col("col") < spec.width)).distinct()


def touched_cells(features: DataFrame, spec: GridSpec) -> DataFrame:
    """Cells that polygons touch: inside by centre, or passed by an edge."""
    return polygon_cells(features, spec).unionByName(line_cells(features, spec, closed=True)).distinct()


def aoi_mask(cells: DataFrame, boundary: DataFrame, spec: GridSpec, out: str = "in_aoi") -> DataFrame:
    """GRD-10: cells with a flag for those that the boundary touches; written tables keep it for later steps."""
    inside = touched_cells(boundary, spec).select("row", "col").distinct().withColumn(out, F.lit(True))
    return cells.join(inside, ["row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def burn(features: DataFrame, spec: GridSpec, where: str | Column | None = None, all_touched: bool = False, kind: str = "polygon") -> DataFrame:
    """RST-1, RST-2: (row, col, value) of the latest feature on each cell; no features give no rows (all null after a join)."""
    chosen = select_features(features, where)
    hit = line_cells(chosen, spec, all_touched=all_touched) if kind == "line" else touched_cells(chosen, spec) if all_touched else polygon_cells(chosen, spec)
    values = chosen.select("feature_id", "seq", "value")
    return hit.join(values, "feature_id").groupBy("row", "col").agg(F.max_by("value", F.struct("seq", "feature_id")).alias("value"))


def zone_labels(zones: DataFrame, code: str, numbering: str = "sorted") -> DataFrame:
    """RST-3..5: labels from 1, by sorted code, or by first appearance (`file`); duplicates and null codes dropped."""
    w = Window.partitionBy(code).orderBy("seq")
    one = zones.filter(F.col(code).isNotNull()).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    order = Window.orderBy(code) if numbering == "sorted" else Window.orderBy("seq", code)
    return one.withColumn("zone_id", F.row_number().over(order).cast("int"))


def burn_zones(zones: DataFrame, spec: GridSpec, code: str, all_touched: bool = False, numbering: str = "sorted") -> DataFrame:
    """(row, col, zone_id): background cells are absent."""
    labelled = zone_labels(zones, code, numbering).withColumn("value", F.col("zone_id").cast("double"))
    return burn(labelled, spec, all_touched=all_touched).select("row", "col", F.col("value").cast("int").alias("zone_id"))


def coverage_fraction(features: DataFrame, spec: GridSpec, k: int = 10) -> DataFrame:
    """RST-6: share of each cell that the features' union covers, from k x k subcells; cells without cover are absent."""
    fine = polygon_cells(features, spec.supersampled(k)).select("row", "col").distinct()
    return fine.groupBy((F.col("row") / k).cast("int").alias("row"), (F.col("col") / k).cast("int").alias("col")).agg((F.count("*") / F.lit(float(k * k))).alias("value"))


def indicator_layers(cells: DataFrame, indicators: DataFrame, names: list[str], zone: str = "zone_id") -> DataFrame:
    """RST-7: zone indicators as layers: one row per zone joins the cells."""
    values = indicators.select(zone, *(F.when(~F.isnan(F.col(f"`{n}`").cast("double")), F.col(f"`{n}`")).alias(n) for n in names))
    return cells.join(sized(values), zone, "left")


def class_max(features: DataFrame, spec: GridSpec, speeds: dict[str, float], classes: tuple[str, ...] = (), all_touched: bool = True) -> DataFrame:
    """RST-8: the fastest class on each cell; classes without a speed, or not asked for, are left out."""
    known = features.filter(F.col("fclass").isin(*(classes or speeds)) & F.col("fclass").isin(*speeds))
    speed = F.create_map(*(F.lit(x) for kv in speeds.items() for x in kv))
    hit = line_cells(known, spec, all_touched=all_touched).join(known.select("feature_id", speed[F.col("fclass")].alias("speed")), "feature_id")
    return hit.groupBy("row", "col").agg(F.max("speed").alias("value"))


def clip_cells(cells: DataFrame, features: DataFrame, spec: GridSpec) -> DataFrame:
    """RST-11: (feature_id, cells' columns) of the cells whose centres lie in each feature."""
    return cells.join(polygon_cells(features, spec), ["row", "col"])
