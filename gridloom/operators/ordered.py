"""Exact selection by rank or by running weight, without a task that orders or holds a whole group.

Rows are counted into slices of the range of their order: first by the logarithm of the first order column, which cuts any
distribution into parts of some five percent, then, only inside the slices that hold an answer, into 65,536 even parts, of the
next order column where the one before is constant. Slices are sums of at most a few tens of thousands of rows a group, whatever
the data; ties fall together and cost nothing. When few rows are left in a slice, or there are few from the start, they are sorted.
Where slices lie does not change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import settled

#: Rows of a slice that are sorted by one task.
MOST = 200_000
_PARTS, _SMALLEST = 65_536, 4.9e-324


def _by_logarithm(v: Column) -> Column:
    """A slice that never falls as v grows: 22 to a power of e, 0 in the middle."""
    size = F.least(F.lit(746.0) + F.ln(F.abs(v)), F.lit(1480.0))
    return F.when(v > 0, F.floor(size * 22)).when(v < 0, -F.floor(size * 22)).otherwise(F.lit(0)).cast("long")


def _by_range(order: list[str]) -> Column:
    even = [F.when(F.col(f"__lo_{c}") < F.col(f"__hi_{c}"), F.floor((F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")) * _PARTS)) for c in order]
    return F.coalesce(*even, F.lit(0)).cast("long")


def locate(rows: DataFrame, keys: list[str], order: list[str], aims: list[tuple[int, Column]], most: int = MOST) -> DataFrame:
    """Where running weights reach their aims: keys, t, the order columns there, __total (the group's weight).

    rows: keys, order columns (doubles without nulls) and __w, a weight; they are read two or three times, so a costly plan
    is better written first. aims: numbered columns over the keys and __total; null aims ask for nothing. An aim is met by the first
    row up to which the weights sum to at least it; one above the total by the last row, one below 0 by the first that weighs.
    """
    ends = [f(c).alias(f"__{k}_{c}") for c in order for k, f in (("lo", F.min), ("hi", F.max))]
    bounds = [f"__{k}_{c}" for c in order for k in ("lo", "hi")]
    sums_to = lambda by, over: F.sum("__held").over(Window.partitionBy(*keys, *by).orderBy(*over).rowsBetween(Window.unboundedPreceding, 0))

    def met(sums: DataFrame, by: list[str], over: list[str], start: Column) -> DataFrame:
        """Of running sums from start, the entries that first reach at."""
        one = Window.partitionBy(*keys, *by).orderBy(*over)
        return sums.withColumns({"__before": start + F.coalesce(F.lag("__sum").over(one), F.lit(0.0)), "__last": F.lead("__sum").over(one).isNull(), "__reached": start + F.col("__sum")})

    def hits(found: DataFrame) -> DataFrame:
        return found.filter((F.col("__before") < F.col("at")) & ((F.col("at") <= F.col("__reached")) | F.col("__last")))

    def aimed_at(sums: DataFrame) -> DataFrame:
        sums = sums.withColumn("__total", F.sum("__held").over(Window.partitionBy(*keys))).filter("__total > 0")
        # an aim of null has no entry; greatest() would take the other side
        each = F.array_compact(F.array(*(F.when(at.isNotNull(), F.struct(F.lit(t).alias("t"), F.greatest(at.cast("double"), F.lit(_SMALLEST)).alias("at"))) for t, at in aims)))
        return sums.withColumn("__a", F.explode(each)).select("*", "__a.t", "__a.at").drop("__a")

    if rows.limit(most + 1).count() <= most:
        alike = rows.groupBy(*keys, *order).agg(F.sum("__w").alias("__held"))
        alike = met(alike.withColumn("__sum", sums_to([], order)), [], order, F.lit(0.0))
        return hits(aimed_at(alike)).select(*keys, "t", "__total", *order)
    sliced = rows.withColumns({"__b": F.lit(0.0), "__s": _by_logarithm(F.col(order[0]))})
    aimed = None
    while True:
        sums = sliced.groupBy(*keys, "__b", "__s").agg(F.sum("__w").alias("__held"), F.count("*").alias("__n"), *ends)
        sums = met(sums.withColumn("__sum", sums_to(["__b"], ["__s"])), ["__b"], ["__s"], F.col("__b"))
        sums = aimed_at(sums) if aimed is None else sums.join(aimed, [*keys, "__b"])
        hit = settled(hits(sums).select(*keys, "t", "at", "__total", "__b", "__s", "__before", "__n", *bounds), "slices")  # a row for each group and aim
        open_ = F.lit(False)
        for c in order:
            open_ = open_ | (F.col(f"__lo_{c}") < F.col(f"__hi_{c}"))
        largest = hit.filter(open_).agg(F.max("__n")).first()[0] or 0
        slices = hit.select(*keys, "__b", "__s", F.col("__before").alias("__start"), *bounds).distinct()
        inside = sliced.join(slices, [*keys, "__b", "__s"])
        if largest <= most:
            break
        sliced = inside.withColumn("__s", _by_range(order)).withColumn("__b", F.col("__start")).select(*rows.columns, "__b", "__s")
        aimed = hit.select(*keys, F.col("__before").alias("__b"), "t", "at", "__total")
    alike = inside.groupBy(*keys, "__b", "__s", "__start", *order).agg(F.sum("__w").alias("__held"))
    alike = met(alike.withColumn("__sum", sums_to(["__b", "__s"], order)), ["__b", "__s"], order, F.col("__start"))
    return hits(alike.join(hit.select(*keys, "__b", "__s", "t", "at", "__total"), [*keys, "__b", "__s"])).select(*keys, "t", "__total", *order)


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float | Column]], keys: tuple[str, ...] | list[str] = (), weight: str | None = None, most: int = MOST) -> DataFrame:
    """AGG-15, AGG-16, AGG-28: exact quantiles, linear between neighbours, of any number of columns in the same passes.

    wanted: name -> (column, share from 0 to 1, which may be a column over the keys). One row per group that has a value at all;
    missing values are left out. With a weight each value counts as often as the whole part of its weight says.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    keys = list(keys)
    if weight:
        w = F.col(f"`{weight}`").cast("long").cast("double")
    items = [F.struct(F.lit(i).alias("__c"), F.col(f"`{c}`").cast("double").alias("__v")) for i, c in enumerate(columns)]
    rows = df.select(*keys, (w if weight else F.lit(1.0)).alias("__w"), F.explode(F.array(*items)).alias("__i")).select(*keys, "__i.*", "__w").filter("__v is not null and __w > 0")
    aims, place = [], {}
    for k, (name, (c, p)) in enumerate(wanted.items()):
        p = p if isinstance(p, Column) else F.lit(float(p))
        place[name] = lambda n, p=p: p * (n - 1)
        own = F.col("__c") == columns.index(c)
        at = p * (F.col("__total") - 1)
        aims += [(2 * k, F.when(own, F.floor(at) + 0.5)), (2 * k + 1, F.when(own, F.ceil(at) + 0.5))]
    met = locate(rows, [*keys, "__c"], ["__v"], aims, most)
    out = []
    for k, name in enumerate(wanted):
        low, high, n = (F.max(F.when(F.col("t") == t, F.col(c))) for t, c in ((2 * k, "__v"), (2 * k + 1, "__v"), (2 * k, "__total")))
        at = place[name](n)
        out.append(F.when(F.ceil(at) == F.floor(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    return met.groupBy(*keys).agg(*out)


def scalar_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], weight: str | None = None) -> dict[str, float | None]:
    """The same of a whole table, on the driver; null without any value."""
    found = quantiles(df, wanted, weight=weight).first()
    return found.asDict() if found is not None else dict.fromkeys(wanted)
