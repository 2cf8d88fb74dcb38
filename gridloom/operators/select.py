"""Ranking and selection (WIN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.numeric import quintile, safe_div
from gridloom.operators.ordered import MOST, locate, quantiles, scalar_quantiles
from gridloom.session import settled


def percentile_of(df: DataFrame, value: str, p: float) -> float | None:
    """AGG-15: exact percentile (linear between neighbours) of the values there are; a scalar on the driver."""
    return scalar_quantiles(df, {"p": (value, p)})["p"]


def _masked(cells: DataFrame, value: str, reached: Column, out: str, null_is_zero: bool) -> DataFrame:
    mask = F.when(F.col(value).isNotNull(), F.coalesce(reached, F.lit(False)).cast("int"))
    return cells.withColumn(out, F.coalesce(mask, F.lit(0)) if null_is_zero else mask)


def top_percent(cells: DataFrame, value: str, percent: float | Column, out: str = "selected", null_is_zero: bool = False, keys: tuple[str, ...] = ("aoi",)) -> DataFrame:
    """WIN-1: 1 where the value reaches the (100 - percent)th percentile, ties included; null stays, or is 0 (WIN-3).

    percent may be a column over the keys. cells are read again for the percentile: write a costly plan first.
    """
    keys = [k for k in keys if k in cells.columns]
    wanted = {"__cut": (value, 1 - percent / 100)}
    if keys:
        joined = cells.join(settled(quantiles(cells, wanted, keys), "cuts"), keys, "left")  # one row per area
    else:
        joined = cells.withColumn("__cut", F.lit(scalar_quantiles(cells, wanted)["__cut"]).cast("double"))
    return _masked(joined, value, F.col(value) >= F.col("__cut"), out, null_is_zero).drop("__cut")


def top_area(cells: DataFrame, value: str, target_km2: float | Column, out: str = "selected", null_is_zero: bool = False, keys: tuple[str, ...] = ("aoi",), most: int = MOST) -> DataFrame:
    """WIN-2: best cells first until their area reaches the target; the cell that crosses it is in, and one cell at least.

    Cells stand in the order of (value falling, row, col), so the selection is all up to one cell. That cell is found by areas
    summed over slices of this order, first of the values, among equal ones of the rows and then of the columns; no task
    orders more than `most` cells, ties or not. The target may be a column over the keys.
    """
    keys = [k for k in keys if k in cells.columns]
    target = target_km2 if isinstance(target_km2, Column) else F.lit(float(target_km2))
    rows = cells.filter(F.col(value).isNotNull()).select(*keys, (-F.col(value).cast("double")).alias("__v"), F.col("row").cast("double").alias("__row"), F.col("col").cast("double").alias("__col"), F.coalesce(F.col("area_km2"), F.lit(0.0)).alias("__w"))
    last = settled(locate(rows, keys, ["__v", "__row", "__col"], [(0, target)], most).drop("t", "__total"), "crossing")  # one row per area
    if keys:
        joined = cells.join(last, keys, "left")
    else:
        found = last.first()
        joined = cells.withColumns({c: F.lit(found[c] if found else None).cast("double") for c in ("__v", "__row", "__col")})
    v, r, c = -F.col(value), F.col("row"), F.col("col")
    reached = (v < F.col("__v")) | ((v == F.col("__v")) & ((r < F.col("__row")) | ((r == F.col("__row")) & (c <= F.col("__col")))))
    return _masked(joined, value, reached, out, null_is_zero).drop("__v", "__row", "__col")


def select_top(cells: DataFrame, value: str, percent: float | None = None, km2: float | None = None, **options) -> DataFrame:
    """By area if one is given, else by percent."""
    return top_area(cells, value, km2, **options) if km2 is not None else top_percent(cells, value, percent, **options)


def rank_by(rows: DataFrame, score: str, *ties: str, out: str = "rank") -> DataFrame:
    """WIN-4, WIN-5: 1..N from the best; no data last. For zones and sites: their tables are small by nature."""
    return rows.withColumn(out, F.row_number().over(Window.orderBy(F.desc_nulls_last(score), *ties)))


def add_quintile(rows: DataFrame, value: str, order: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """WIN-6: quintiles of first-method ranks; null values, or fewer than two distinct ones, have none."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumns({"__n": F.count(value).over(w), "__lo": F.min(value).over(w), "__hi": F.max(value).over(w), "__k": F.row_number().over(w.orderBy(F.asc_nulls_last(value), order))})
    part = quintile(F.col("__k"), F.col("__n"))
    return ranked.withColumn(out, F.when(F.col(value).isNotNull() & (F.col("__hi") > F.col("__lo")), part)).drop("__n", "__lo", "__hi", "__k")


def top_n(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """WIN-7: TakeOrderedAndProject; the order must end in a unique key."""
    return rows.orderBy(*order).limit(n)


def share_of_total(rows: DataFrame, value: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """WIN-9: 100 * x / sum; null if the sum is 0."""
    return rows.withColumn(out, safe_div(100.0 * F.col(value), F.sum(value).over(Window.partitionBy(*keys))))


def minmax_part(value: str, keys: tuple[str, ...] = (), invert: bool = False) -> Column:
    """WIN-11: (v - min) / (max - min) over the group; 0 where the value is missing or the group constant."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    v = -F.col(value) if invert else F.col(value)
    low = -hi if invert else lo
    return F.when(F.col(value).isNull() | (hi == lo) | hi.isNull(), 0.0).otherwise((v - low) / F.when(hi != lo, hi - lo))


def composite(rows: DataFrame, parts: dict[str, bool], keys: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """WIN-12: mean of scaled parts; parts: column -> larger is less urgent (inverted). Columns that are missing are left out."""
    use = {c: inv for c, inv in parts.items() if c in rows.columns}
    if not use:
        return rows.withColumn(out, F.lit(None).cast("double"))
    return rows.withColumn(out, sum((minmax_part(c, keys, inv) for c, inv in use.items()), F.lit(0.0)) / len(use))


def max_normalize(rows: DataFrame, value: str, out: str) -> DataFrame:
    """WIN-13."""
    return rows.withColumn(out, safe_div(value, F.max(value).over(Window.partitionBy())))


def contiguous(rows: DataFrame, value: str, start: int | None = 1) -> DataFrame:
    """WIN-10: one row: whether the values are start..n (or min..max) without gaps or repeats."""
    g = rows.agg(F.count(value).alias("n"), F.count_distinct(value).alias("distinct"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    low = F.lit(start) if start is not None else F.col("lo")
    ok = (F.col("n") == 0) | ((F.col("n") == F.col("distinct")) & (F.col("lo") == low) & (F.col("hi") - low + 1 == F.col("n")))
    return g.select("n", F.coalesce(ok, F.lit(False)).alias("ok"))


def quantile_band(rows: DataFrame, high: str, low: str, p_high: float = 0.75, p_low: float = 0.25) -> DataFrame:
    """FLT-6: rows at or above one column's upper quantile and at or below the other's lower one."""
    cuts = scalar_quantiles(rows, {"high": (high, p_high), "low": (low, p_low)})
    return rows.filter((F.col(high) >= cuts["high"]) & (F.col(low) <= cuts["low"])) if None not in cuts.values() else rows.limit(0)
