"""Survey tables (SRC-8, PRJ-20..22, SET, JON, AGG-11..13): ingest, reshape, join, correlate."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.numeric import theme_and_variable, to_number
from gridloom.operators.select import add_quintile
from gridloom.session import sized

KEYS = ("ADM2CD_c", "NAM_2", "NAM_1")


def rename_columns(df: DataFrame, names: dict[str, str], keep: tuple[str, ...] = KEYS) -> DataFrame:
    """PRJ-20: data columns under their names; columns without a name are dropped, keys stay."""
    return df.select(*(F.col(k) for k in keep if k in df.columns), *(F.col(a).alias(b) for a, b in names.items() if a in df.columns))


def normalize_units(df: DataFrame, percents: list[str] = (), hours: dict[str, str] | None = None) -> DataFrame:
    """PRJ-21, PRJ-22: percent to 0..1, hours to minutes under a new name; text that is no number is null."""
    hours = hours or {}
    out = []
    for c in df.columns:
        if c in percents:
            out.append((to_number(c) / 100.0).alias(c))
        elif c in hours:
            out.append((to_number(c) * 60.0).alias(hours[c]))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def ingest_themes(themes: dict[str, DataFrame], skip: tuple[str, ...] = (), limit: tuple[str, ...] = (), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """SRC-8, SET-1, FLT-9: themes (keys and values, wide) as one long table: keys, theme, var, value."""
    chosen = {k: v for k, v in themes.items() if k not in skip and (not limit or k in limit)}
    if not chosen:
        raise ValueError("no theme is left")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (melt(df, keys).withColumn("theme", F.lit(name)) for name, df in chosen.items()))


def melt(df: DataFrame, keys: tuple[str, ...] = KEYS, var: str = "var", value: str = "value") -> DataFrame:
    """SET-6: one row per key and column that isn't a key."""
    ids = [k for k in keys if k in df.columns]
    names = [c for c in df.columns if c not in ids]
    wide = df.select(*ids, *(to_number(c).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(f"`{c}`").cast("double").alias(c) for c in names))
    return wide.unpivot(ids, names, var, value)


def mean_of_duplicates(long: DataFrame, keys: tuple[str, ...] = (*KEYS, "theme", "var")) -> DataFrame:
    """AGG-11: rows of one key are averaged."""
    return long.groupBy(*(k for k in keys if k in long.columns)).agg(F.avg("value").alias("value"))


def wide_table(long: DataFrame, names: list[str] | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """SET-5, JON-3: one column `<theme>__<var>` each; names may be given to save the job that lists them."""
    keyed = long.withColumn("__name", F.concat_ws("__", "theme", "var"))
    ids = [k for k in keys if k in long.columns]
    return keyed.groupBy(*ids).pivot("__name", names).agg(F.avg("value"))


def drop_empty_columns(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """SET-3: columns without any value go; one pass counts them all."""
    names = [c for c in df.columns if c not in keys]
    if not names:
        return df
    n = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in names)).first().asDict()
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c in keys or n[c]))


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """SET-2: the first row of each key in a stated order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def first_values(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """AGG-12: per key and column the first value that isn't null in a stated order."""
    names = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(*(F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(c) for c in names))


def left_on_text(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JON-5: left join on keys compared as texts."""
    r = right.select(*(F.col(k).cast("string").alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (F.col(k).cast("string") == F.col(f"__{k}") for k in keys))
    return left.join(r, on, "left").drop(*(f"__{k}" for k in keys))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """JON-6: a join that refuses keys that stand twice on either side."""
    for name, side in (("left", left), ("right", right)):
        if not side.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"keys {keys} are not unique on the {name} side")
    return left.join(right, keys, how)


def with_names(df: DataFrame, names: DataFrame, code: str, out: str) -> DataFrame:
    """JON-2, JON-13: name of a code, the code itself where there is none. names: code, name."""
    n = names.select(F.col("code").alias("__c"), F.col("name").alias("__n"))
    return df.join(sized(n), F.col(code) == F.col("__c"), "left").withColumn(out, F.coalesce("__n", F.col(code).cast("string"))).drop("__c", "__n")


def code_maps(base: DataFrame, maps: dict[int, DataFrame]) -> DataFrame:
    """JON-7, JON-8: raw map tables (muni_n_af, variable, value) put on base (adm2code, muni_n_af) as data1..dataN in order."""
    codes = keep_first(base, ["adm2code"], "muni_n_af").select("adm2code", "muni_n_af")
    out = codes
    for n in sorted(maps):
        m = maps[n].groupBy("muni_n_af").agg(F.avg(to_number("value")).alias(f"data{n}"))
        out = out.join(m, "muni_n_af", "left")
    return out.select("adm2code", "muni_n_af", *(f"data{n}" for n in sorted(maps)))


def _p_value(r: float, n: int) -> float | None:
    """Two-sided p of a Pearson r: the regularised incomplete beta at 1 - r*r with (n - 2) / 2 and 1 / 2."""
    if r is None or n < 3:
        return None
    x = min(1.0, max(0.0, 1 - r * r))
    if n == 2 or x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    a, b = (n - 2) / 2, 0.5
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta, evaluated from the front until it settles."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def correlations(wide: DataFrame, target: str, keys: tuple[str, ...] = KEYS, p_values: bool = True) -> DataFrame:
    """AGG-13: each variable against the target over rows that have both: theme, var, r, p, n; fewer than 3 rows: none;
    a constant: nulls. One pass over the table; the p column is a small batch function over one row per variable."""
    others = [c for c in wide.columns if c not in keys and c != target]
    long = wide.select(F.col(f"`{target}`").cast("double").alias("__t"), *(F.col(f"`{c}`").cast("double").alias(c) for c in others)).unpivot("__t", others, "__name", "v").filter("__t is not null and v is not null")
    g = long.groupBy("__name").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"), F.min("__t").alias("c"), F.max("__t").alias("d"), F.covar_pop("v", "__t").alias("cov"), F.stddev_pop("v").alias("sv"), F.stddev_pop("__t").alias("st"))
    varies = (F.col("a") < F.col("b")) & (F.col("c") < F.col("d")) & (F.col("sv") > 0) & (F.col("st") > 0)
    r = F.when(varies, F.col("cov") / F.when(varies, F.col("sv") * F.col("st")))
    theme, var = theme_and_variable("__name")
    out = g.filter("n >= 3").select(theme.alias("theme"), var.alias("var"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r0"), r.isNull().alias("none"), "n").select("theme", "var", F.when(~F.col("none"), F.col("r0")).alias("r"), "n")
    if not p_values:
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = [None if pd.isna(x) else _p_value(float(x), int(k)) for x, k in zip(pdf["r"], pdf["n"], strict=True)]
            yield pdf.assign(p=pd.Series(p, dtype="float64", index=pdf.index))[["theme", "var", "r", "p", "n"]]

    return out.mapInPandas(run, "theme string, var string, r double, p double, n long").orderBy(F.desc_nulls_last("r"), "theme", "var")


def profiles(wide: DataFrame, columns: list[str], poverty: str, order: str = "ADM2CD_c") -> DataFrame:
    """Q06's profile table: keys, chosen columns and the quintile of poverty."""
    base = keep_first(wide.select(*(k for k in KEYS if k in wide.columns), *(c for c in columns if c in wide.columns)), [order], order)
    return add_quintile(base, poverty, order, "poverty_quintile")
