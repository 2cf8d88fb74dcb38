"""Neighbourhood operators (FOC) as two separable passes: cells are added up by column offsets, then along rows by windows.

The first pass sums cells into the rows around them (combined before the shuffle), which also gives places where no cell
stands; the second is a range window over one row, so no task holds the grid. On a grid that has every cell, `dense` makes
the first pass a window too and saves the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _passes(cells: DataFrame, value: Column, radius: int, keys: list[str], combine: dict, dense: bool) -> DataFrame:
    """cells with one column per entry of combine (name -> (aggregate, of)) over the square window around each cell."""
    along = Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(-radius, radius)
    base = cells.withColumns({f"__v_{k}": of(value) for k, (_, of) in combine.items()})
    if dense:
        down = Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(-radius, radius)
        step = base.withColumns({f"__d_{k}": f(f"__v_{k}").over(down) for k, (f, _) in combine.items()})
        step = step.withColumns({k: f(f"__d_{k}").over(along) for k, (f, _) in combine.items()})
        return step.drop(*(f"__{t}_{k}" for t in "vd" for k in combine))
    offsets = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    spread = base.select(*keys, "row", "col", *(f"__v_{k}" for k in combine), offsets.alias("__o"))
    rows = spread.groupBy(*keys, (F.col("row") + F.col("__o")).alias("row"), "col").agg(*(f(f"__v_{k}").alias(f"__d_{k}") for k, (f, _) in combine.items()), F.max(F.col("__o") == 0).alias("__here"))
    sums = rows.withColumns({k: f(f"__d_{k}").over(along) for k, (f, _) in combine.items()}).filter("__here").select(*keys, "row", "col", *combine)
    return cells.join(sums, [*keys, "row", "col"])


def focal_mean(cells: DataFrame, value: str, radius: int = 1, out: str | None = None, keys: tuple[str, ...] = ("aoi",), preserve_nulls: bool = False, dense: bool = False) -> DataFrame:
    """FOC-1: mean of the present values in a square window cut off at the edges. Null cells next to present ones are
    filled, unless preserve_nulls."""
    out = out or value
    if radius <= 0:
        return cells.withColumn(out, F.col(value))
    use = [k for k in keys if k in cells.columns]
    some = {"__s": (F.sum, lambda v: v), "__n": (F.sum, lambda v: v.isNotNull().cast("int"))}
    step = _passes(cells, F.col(value), radius, use, some, dense)
    mean = F.when(F.col("__n") > 0, F.col("__s") / F.when(F.col("__n") > 0, F.col("__n")))
    if preserve_nulls:
        mean = F.when(F.col(value).isNotNull(), mean)
    return step.withColumn(out, mean).drop("__s", "__n")


def focal_max(cells: DataFrame, value: str, radius: int = 1, out: str | None = None, keys: tuple[str, ...] = ("aoi",), dense: bool = False) -> DataFrame:
    """FOC-2: dilation; no data counts as 0."""
    use = [k for k in keys if k in cells.columns]
    step = _passes(cells, F.coalesce(F.col(value), F.lit(0)), radius, use, {"__m": (F.max, lambda v: v)}, dense)
    return step.withColumn(out or value, F.col("__m")).drop("__m")


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def disk_sums(points: DataFrame, cells: DataFrame, values: list[str], radius: int = 5, key: str = "site_id") -> DataFrame:
    """FOC-3: for points with row and col, sums over the disk of cells around; outside the grid and no data count as 0.

    Only the points are multiplied, by the disk's cells (81 for radius 5).
    """
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disk_offsets(radius))))
    wide = points.select(key, "row", "col", at.alias("o")).select(key, (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    joined = wide.join(cells.select("row", "col", *values), ["row", "col"], "left")
    return joined.groupBy(key).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values))
