"""Column expressions for numbers. Null is the only "no data": nan_to_null is applied once, where data enters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a float column becomes null; Spark would compare NaN as larger than any number."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def np_round(c: Column | str, digits: int) -> Column:
    """PRJ-32: half to even of the scaled value, as array libraries round."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / F.lit(scale)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Null where the denominator is 0 or null."""
    return F.when(col(b) != 0, col(a) / col(b))


def clamp(c: Column | str, low: float | Column | None, high: float | Column | None) -> Column:
    """Bounds that keep nulls (least and greatest alone would skip them)."""
    v = col(c)
    if low is not None:
        v = F.when(v < low, F.lit(low)).otherwise(v)
    if high is not None:
        v = F.when(v > high, F.lit(high)).otherwise(v)
    return F.when(col(c).isNotNull(), v)


def reclass_le(c: Column | str, threshold: float | Column) -> Column:
    """PRJ-1: 1 where the value is at most the threshold, else 0; null stays."""
    return (col(c) <= threshold).cast("int")


def flag(condition: Column) -> Column:
    """Comparison of layers in which no data counts as false."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def normalize_linear(c: Column | str, low: float | Column, high: float | Column) -> Column:
    """PRJ-2: (v - low) / (high - low) within 0..1; 0 where the bounds are equal; null stays."""
    low, high = (F.lit(x) if not isinstance(x, Column) else x for x in (low, high))
    return F.when(col(c).isNull(), None).when(high == low, 0.0).otherwise(clamp((col(c) - low) / F.when(high != low, high - low), 0.0, 1.0))


def minmax_scale(c: Column | str, low: float | Column, high: float | Column, invert: bool = False) -> Column:
    """PRJ-3: clip to the bounds, divide by their distance plus 1e-9; inverted: 1 minus that."""
    low, high = (F.lit(x) if not isinstance(x, Column) else x for x in (low, high))
    v = (clamp(c, low, high) - low) / (high - low + 1e-9)
    return 1 - v if invert else v


def percent_guard(c: Column | str) -> Column:
    """PRJ-33: null outside 0..100 with a tolerance of 1e-6."""
    return F.when((col(c) >= -1e-6) & (col(c) <= 100 + 1e-6), col(c))


def to_number(c: Column | str) -> Column:
    """PRJ-22: text that is no finite number becomes null."""
    v = col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def impedance(distance: Column | str, kind: str = "exp", decay: float = 0.015, beta: float = 1.5) -> Column:
    """PRJ-23: exp(-decay * d), or (1 + d) ** -beta."""
    if kind == "exp":
        return F.exp(-F.lit(decay) * col(distance))
    if kind in ("pow", "power"):
        return F.pow(1 + col(distance), F.lit(-beta))
    raise ValueError(f"unknown impedance {kind!r}")


def cutoff(flow: Column | str, distance: Column | str, most: float | None) -> Column:
    """PRJ-24: no flow beyond the distance."""
    return col(flow) if most is None else F.when(col(distance) > most, 0.0).otherwise(col(flow))


def equity_mass(pop: Column | str, rwi_z: Column | str, weight: float = 0.25, sign: int = 1) -> Column:
    """PRJ-25: population times (1 + sign * weight * rwi_z), at least 0; rwi_z is wealth over 2, none counts as 0."""
    m = col(pop) * (1 + F.lit(sign * weight) * F.coalesce(col(rwi_z), F.lit(0.0)))
    return F.greatest(F.lit(0.0), m)


def friction(road_kmh: Column | str, off_road_kmh: float = 4.0) -> Column:
    """PRJ-19: minutes per kilometre of the faster of road and off-road speed, at least 0.1 km/h."""
    return 60.0 / F.greatest(F.greatest(F.coalesce(col(road_kmh), F.lit(0.0)), F.lit(off_road_kmh)), F.lit(0.1))


def quintile(rank: Column, n: Column, parts: int = 5) -> Column:
    """WIN-6: the part 1..parts of a first-method rank 1..n, as quantile cuts of the ranks give it."""
    return F.greatest(F.lit(1), F.floor((parts * (rank - 1) + n - 2) / F.greatest(n - 1, F.lit(1)))).cast("int")


def road_bucket(fclass: Column | str) -> Column:
    """PRJ-27: major, collector or local by lower-cased class; links count as their roads."""
    c = F.regexp_replace(F.lower(F.coalesce(col(fclass), F.lit(""))), "_link$", "")
    return F.when(c.isin("motorway", "trunk", "primary"), "major").when(c.isin("secondary", "tertiary"), "collector").otherwise("local")


def dominant(parts: dict[str, Column], none: str = "none", mixed: str = "mixed") -> Column:
    """PRJ-28: the name of the single largest part; `none` if all are 0, `mixed` if the largest is shared."""
    values = {k: F.coalesce(v, F.lit(0)) for k, v in parts.items()}
    top = F.greatest(*values.values())
    hits = sum((v == top).cast("int") for v in values.values())
    out = F.when(top <= 0, none).when(hits > 1, mixed)
    for k, v in values.items():
        out = out.when(v == top, k)
    return out


def quadrant(score: Column | str, poverty: Column | str, score_median: Column | float, poverty_median: Column | float) -> Column:
    """PRJ-29: label by both values against their medians; null if a value is."""
    high, poor = col(score) >= score_median, col(poverty) >= poverty_median
    return F.when(high & poor, "High score & high poverty").when(high & ~poor, "High score & lower poverty").when(~high & poor, "Lower score & high poverty").when(~high & ~poor, "Lower score & lower poverty")


def poverty_rate(c: Column | str, largest: Column) -> Column:
    """PRJ-26: a rate in 0..1 from either unit, told by the column's largest value; null if it is neither."""
    v = F.when(largest <= 1.5, col(c)).when(largest <= 100, col(c) / 100)
    return clamp(v, 0.0, 1.0)


def format_site(c: Column | str) -> Column:
    return F.concat(F.lit("site_"), col(c).cast("string"))


def quote_literal(value: str) -> str:
    """PRJ-30: a text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def theme_and_variable(c: Column | str) -> tuple[Column, Column]:
    """PRJ-30: `<theme>__<var>` split at the first double underscore."""
    return F.substring_index(col(c), "__", 1), F.regexp_extract(col(c), "^.*?__(.*)$", 1)


def number_in(c: Column | str, pattern: str) -> Column:
    """PRJ-31: the first group of a pattern as an int, null where it doesn't match."""
    found = F.regexp_extract(col(c), pattern, 1)
    return F.when(found != "", found.cast("int"))
