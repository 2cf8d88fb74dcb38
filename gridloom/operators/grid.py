"""Grids as tables: one row per cell, one nullable column per layer (GRD)."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geo import cell_area

#: Resampling names by kind of layer, and all that can be asked for.
KINDS = {"continuous": "bilinear", "categorical": "nearest", "count": "nearest"}
METHODS = ("nearest", "bilinear", "cubic", "cubic_spline", "lanczos", "average", "mode", "max", "min", "med", "q1", "q3", "sum", "rms")


@dataclass(frozen=True)
class GridSpec:
    """Upper left corner, cell size (dy positive downwards), rows and columns."""

    x0: float
    y0: float
    dx: float
    dy: float
    height: int
    width: int
    crs: str = "EPSG:4326"
    aoi: str = "aoi"

    def supersampled(self, k: int) -> GridSpec:
        """GRD-6: the same extent in k times as many rows and columns."""
        return replace(self, dx=self.dx / k, dy=self.dy / k, height=self.height * k, width=self.width * k)

    def same_grid(self, other: GridSpec, tolerance: float = 1e-9) -> bool:
        """GRD-4: equal shape, reference system and transform."""
        close = all(math.isclose(getattr(self, a), getattr(other, a), rel_tol=0, abs_tol=tolerance) for a in ("x0", "y0", "dx", "dy"))
        return close and (self.height, self.width, self.crs.upper()) == (other.height, other.width, other.crs.upper())


def resampling(name_or_kind: str) -> str:
    """GRD-3: a method by its own name or by the kind of layer."""
    method = KINDS.get(name_or_kind, name_or_kind)
    if method not in METHODS:
        raise ValueError(f"unknown resampling {name_or_kind!r}")
    return method


def template_cells(spark: SparkSession, spec: GridSpec, area_model: str = "latlon") -> DataFrame:
    """GRD-1: all cells with centre and area."""
    i = F.col("id")
    cells = spark.range(spec.height * spec.width).select((i / spec.width).cast("int").alias("row"), (i % spec.width).cast("int").alias("col"))
    cells = cells.select(F.lit(spec.aoi).alias("aoi"), "row", "col", (F.lit(spec.x0) + (F.col("col") + 0.5) * spec.dx).alias("x"), (F.lit(spec.y0) - (F.col("row") + 0.5) * spec.dy).alias("y"))
    return cells.withColumn("area_km2", cell_area("y", spec, area_model))


def source_index(spec: GridSpec, x: str = "x", y: str = "y") -> tuple[Column, Column]:
    """Row and column of a point in a source grid, whether inside or not."""
    return F.floor((F.lit(spec.y0) - F.col(y)) / spec.dy).cast("int"), F.floor((F.col(x) - spec.x0) / spec.dx).cast("int")


def align(source: DataFrame, source_spec: GridSpec, cells: DataFrame, target_spec: GridSpec, method: str = "nearest", value: str = "value") -> DataFrame:
    """GRD-2 (a nearest, b bilinear, c max, d average, e all others): the target's (row, col) with the source's layer resampled to it; null where the source has no data.

    nearest, bilinear, cubic and lanczos look from target centres into the source; the others gather the source cells whose
    centres lie in a target cell (overlaps are not weighted: for integer factors that is the same).
    """
    method = resampling(method)
    if source_spec.same_grid(target_spec):
        return cells.select("row", "col").join(source.select("row", "col", F.col(value).alias("value")), ["row", "col"], "left")
    if method == "nearest":
        r, c = source_index(source_spec)
        at = cells.select("row", "col", r.alias("srow"), c.alias("scol"))
        src = source.select(F.col("row").alias("srow"), F.col("col").alias("scol"), F.col(value).alias("value"))
        return at.join(src, ["srow", "scol"], "left").select("row", "col", "value")
    if method in ("bilinear", "cubic", "cubic_spline", "lanczos"):
        return _weighted(source, source_spec, cells, value, method)
    r, c = source_index(target_spec)
    src = source.withColumns({"x": F.lit(source_spec.x0) + (F.col("col") + 0.5) * source_spec.dx, "y": F.lit(source_spec.y0) - (F.col("row") + 0.5) * source_spec.dy})
    v = F.col(value)
    how = {"max": F.max(v), "min": F.min(v), "average": F.avg(v), "sum": F.sum(v), "med": F.median(v), "q1": F.percentile(v, 0.25), "q3": F.percentile(v, 0.75), "rms": F.sqrt(F.avg(v * v))}
    src = src.select(r.alias("row"), c.alias("col"), v)
    if method == "mode":  # ties: the smallest value
        grouped = src.filter(v.isNotNull()).groupBy("row", "col", value).agg(F.count("*").alias("n")).groupBy("row", "col").agg(F.min(F.struct(-F.col("n"), v.alias("v")))["v"].alias("value"))
    else:
        grouped = src.groupBy("row", "col").agg(how[method].alias("value"))
    return cells.select("row", "col").join(grouped, ["row", "col"], "left")


def _kernel(method: str, d: Column) -> Column:
    a = F.abs(d)
    if method == "bilinear":
        return F.greatest(F.lit(0.0), 1 - a)
    if method == "cubic":  # Catmull-Rom
        return F.when(a < 1, 1.5 * a**3 - 2.5 * a**2 + 1).when(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2).otherwise(0.0)
    if method == "cubic_spline":
        return F.when(a < 1, (4 - 6 * a**2 + 3 * a**3) / 6).when(a < 2, (2 - a) ** 3 / 6).otherwise(0.0)
    p = F.lit(math.pi) * d
    return F.when(a < 1e-12, 1.0).when(a < 3, 3 * F.sin(p) * F.sin(p / 3) / F.when(a >= 1e-12, p * p)).otherwise(0.0)


def _weighted(source: DataFrame, spec: GridSpec, cells: DataFrame, value: str, method: str) -> DataFrame:
    reach = {"bilinear": 1, "cubic": 2, "cubic_spline": 2, "lanczos": 3}[method]
    u, v = (F.col("x") - spec.x0) / spec.dx - 0.5, (F.lit(spec.y0) - F.col("y")) / spec.dy - 0.5
    offsets = F.sequence(F.lit(1 - reach), F.lit(reach))
    at = cells.select("row", "col", u.alias("u"), v.alias("v")).withColumn("dr", F.explode(offsets)).withColumn("dc", F.explode(offsets))
    at = at.withColumns({"srow": (F.floor("v") + F.col("dr")).cast("int"), "scol": (F.floor("u") + F.col("dc")).cast("int")})
    at = at.withColumn("w", _kernel(method, F.col("v") - F.col("srow")) * _kernel(method, F.col("u") - F.col("scol")))
    src = source.select(F.col("row").alias("srow"), F.col("col").alias("scol"), F.col(value).alias("value")).filter("value is not null")
    sums = at.join(src, ["srow", "scol"]).groupBy("row", "col").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("w"))
    return cells.select("row", "col").join(sums, ["row", "col"], "left").select("row", "col", F.when(F.abs("w") > 1e-9, F.col("s") / F.col("w")).alias("value"))


def block_sum(cells: DataFrame, factor: int, height: int, width: int, value: str = "value") -> DataFrame:
    """GRD-5: sums of factor x factor blocks; rows and columns of the remainder are dropped."""
    inside = cells.filter((F.col("row") < height // factor * factor) & (F.col("col") < width // factor * factor))
    return inside.groupBy((F.col("row") / factor).cast("int").alias("row"), (F.col("col") / factor).cast("int").alias("col")).agg(F.sum(value).alias("value"))


def overlap_share(cells: DataFrame, in_aoi: str = "in_aoi") -> Column:
    """AGG-31 as an aggregate: share of cells inside the area."""
    return F.avg(F.coalesce(F.col(in_aoi).cast("int"), F.lit(0)))


def apply_mask(cells: DataFrame, layers: list[str], policy: str = "mask", min_overlap: float = 0.005, force: bool | None = None, in_aoi: str = "in_aoi") -> DataFrame:
    """GRD-11, SNK-2: layers are null outside the area, unless the policy is `none`; force overrides the policy.

    Nothing is masked where the area covers less than min_overlap of the grid: that is a misplaced boundary.
    """
    if policy not in ("none", "mask"):
        raise ValueError(f"unknown mask policy {policy!r}")
    if force is False or (policy == "none" and not force):
        return cells
    share = cells.agg(overlap_share(cells, in_aoi)).first()[0]
    if share is None or share < min_overlap:
        return cells
    return cells.withColumns({c: F.when(F.col(in_aoi).cast("boolean"), F.col(c)) for c in layers})


def same_cells(a: DataFrame, b: DataFrame) -> bool:
    """GRD-12: both tables hold the same set of cells."""
    ka, kb = a.select("row", "col").distinct(), b.select("row", "col").distinct()
    return ka.exceptAll(kb).isEmpty() and kb.exceptAll(ka).isEmpty()


def stack_layers(cells: DataFrame, layers: dict[str, DataFrame | None]) -> DataFrame:
    """JON-1, SRC-3: layers (row, col, value) become columns; a missing layer is a null column."""
    for name, layer in layers.items():
        if layer is None:
            cells = cells.withColumn(name, F.lit(None).cast("double"))
        else:
            cells = cells.join(layer.select("row", "col", F.col("value").alias(name)), ["row", "col"], "left")
    return cells
