"""Row filters (FLT), sorts and fills (SET) that steps share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ordered import scalar_quantiles


def any_of(column: str, values: list, ignore_case: bool = False) -> Column:
    """FLT-1: equality with one of some values; no values let everything through."""
    if not values:
        return F.lit(True)
    return F.lower(column).isin([str(v).lower() for v in values]) if ignore_case else F.col(column).isin(values)


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """FLT-2: rows whose columns are all there and finite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            ok = ok & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.filter(ok)


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    """FLT-3: both ends included."""
    return df.filter(F.col(column).between(low, high))


def labelled(df: DataFrame, label: str, *values: str) -> DataFrame:
    """FLT-4: cells of a zone (label above 0) that have all the values."""
    return finite(df.filter(F.col(label) > 0), list(values))


def off_diagonal(flows: DataFrame, a: str = "oi", b: str = "dj") -> DataFrame:
    """FLT-5: pairs of two different ends."""
    return flows.filter(F.col(a) != F.col(b))


def sort_nulls_last(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """SET-4: keys as (column, descending), nulls last in either direction."""
    return df.orderBy(*(F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys))


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """SET-11."""
    return df.fillna({k: v for k, v in values.items() if k in df.columns})


def flatten_matrix(rows: DataFrame, columns: DataFrame, row: str = "oi", column: str = "dj") -> DataFrame:
    """SET-7: every (row, column) key pair of a matrix, long; both are zone tables."""
    return rows.select(F.col(row)).distinct().crossJoin(columns.select(F.col(column)).distinct())


def lock_order(df: DataFrame, first: list[str]) -> DataFrame:
    """SET-10: stated columns first, the others after them in their order."""
    return df.select(*(F.col(f"`{c}`") for c in [c for c in first if c in df.columns] + [c for c in df.columns if c not in first]))


def quantiles(df: DataFrame, column: str, points: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """AGG-16: one row of exact quantiles, linear between neighbours: p25, p75, ...; null without any value."""
    found = scalar_quantiles(df, {f"p{p * 100:g}": (column, p) for p in points})
    return df.sparkSession.range(1).select(*(F.lit(v).cast("double").alias(k) for k, v in found.items()))
