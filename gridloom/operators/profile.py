"""Table profile (AGG-27, SNK-8): one pass of aggregates, counted values for distinct ones, medians and top values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.numeric import safe_div
from gridloom.session import written


def value_counts(df: DataFrame) -> DataFrame:
    """How often each value of each column stands: i (the column's place), s (the value as text), v (as a number), n; no nulls."""
    items = []
    for i, f in enumerate(df.schema.fields):
        c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
        c = c + 0.0 if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType) else c  # -0.0 is 0.0
        items.append(F.struct(F.lit(i).alias("i"), c.cast("string").alias("s"), (c if number else F.lit(None)).cast("double").alias("v")))
    return df.select(F.explode(F.array(*items)).alias("r")).select("r.*").filter("s is not null").groupBy("i", "s").agg(F.max("v").alias("v"), F.count("*").alias("n"))


def counted_medians(counts: DataFrame) -> DataFrame:
    """Exact medians (i, med) of counted numbers: slices of the range are added up, and only those that hold a middle rank are sorted."""
    slices = written(counts.filter("v is not null").repartitionByRange("i", "v").withColumn("slice", F.spark_partition_id()), "slices")
    sums = slices.groupBy("i", "slice").agg(F.sum("n").alias("held"))
    whole, sofar = Window.partitionBy("i"), Window.partitionBy("i").orderBy("slice")
    sums = sums.select("i", "slice", (F.sum("held").over(sofar) - F.col("held")).alias("before"), "held", F.sum("held").over(whole).alias("all"))
    middle = sums.withColumns({"low": F.floor((F.col("all") - 1) / 2), "high": F.floor(F.col("all") / 2)}).filter("low < before + held and high >= before")
    ranked = slices.join(F.broadcast(middle), ["i", "slice"])  # two slices a column at most
    ranked = ranked.withColumn("to", F.col("before") + F.sum("n").over(Window.partitionBy("i", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.filter("to > low and to - n <= high")
    return ranked.groupBy("i").agg(((F.min("v") + F.max("v")) / 2).alias("med"))


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls, distinct values, their shares, and statistics of numbers. Values are counted by one
    shuffle of narrow rows; distinct values and medians come from the counts."""
    fields = df.schema.fields
    numbers = {f.name for f in fields if isinstance(f.dataType, T.NumericType)}
    aggs = [F.count("*").alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"n{i}"))
        if f.name in numbers:
            v = c.cast("double")
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"sd{i}"), F.count_if(v == 0).alias(f"z{i}")]
    rows = []
    for i, f in enumerate(fields):
        stat = lambda k, i=i, num=f.name in numbers: (F.col(f"{k}{i}") if num else F.lit(None)).cast("double")
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("__rows").alias("rows"), (F.col("__rows") - F.col(f"n{i}")).alias("nulls"), stat("lo").alias("min"), stat("hi").alias("max"), stat("mean").alias("mean"), stat("sd").alias("std"), stat("z").cast("long").alias("zeros")))
    counts = written(value_counts(df), "counts")
    distinct = counts.groupBy("i").agg(F.count("*").alias("distinct"))
    out = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*").join(distinct, "i", "left").join(counted_medians(counts), "i", "left")
    out = out.select("column", "type", "rows", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"), "min", "max", "mean", F.col("med").alias("median"), "std", "zeros")
    pct = lambda a: safe_div(100.0 * F.col(a), "rows")
    out = out.select("*", pct("nulls").alias("null_pct"), pct("distinct").alias("distinct_pct"))
    insight = F.array_compact(F.array(F.when((F.col("distinct") == F.col("rows")) & (F.col("rows") > 0), "id_like"), F.when(F.col("distinct") <= 1, "constant"), F.when((F.col("distinct_pct") > 90) & (F.col("distinct") < F.col("rows")), "mostly_unique"), F.when(F.col("null_pct") > 50, "mostly_null"), F.when(100.0 * F.col("zeros") > 50.0 * F.col("rows"), "mostly_zero")))
    return out.withColumn("insights", F.array_join(insight, ","))


def top_values(df: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent values of every column, the smaller value first among equals. Values are counted before they are
    ranked, and the rank's window keeps only n of each task."""
    long = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)).unpivot([], df.columns, "column", "value").filter("value is not null")
    g = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def profile_rows(df: DataFrame) -> DataFrame:
    """One row: rows, rows that repeat an earlier one, rows without nulls."""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(f"`{c}`").isNotNull()
    g = df.groupBy(*(F.col(f"`{c}`") for c in df.columns), complete.alias("__c")).agg(F.count("*").alias("__n"))
    return g.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum(F.when(F.col("__c"), F.col("__n")).otherwise(0)), F.lit(0)).alias("complete_rows"))
