"""Checks of inputs and results (VAL, WIN-8, WIN-10): each gives rows (check, ok, detail)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.cost import monotone_breaks
from gridloom.operators.grid import GridSpec
from gridloom.operators.zonal import asymmetry, weighted_mean

RESULT = "check string, ok boolean, detail string"


def _row(spark: SparkSession, check: str, ok: bool, detail: str = "") -> DataFrame:
    return spark.createDataFrame([(check, bool(ok), detail)], RESULT)


def required_columns(df: DataFrame, columns: list[str], name: str = "columns") -> DataFrame:
    """VAL-1, VAL-11."""
    missing = [c for c in columns if c not in df.columns]
    return _row(df.sparkSession, f"{name}:required", not missing, ",".join(missing))


def unique_key(df: DataFrame, keys: list[str], name: str = "key") -> DataFrame:
    """VAL-2."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("extra"))
    return g.select(F.lit(f"{name}:unique").alias("check"), (F.col("extra") == 0).alias("ok"), F.col("extra").cast("string").alias("detail"))


def in_range(df: DataFrame, ranges: dict[str, tuple[float, float]], name: str = "range") -> DataFrame:
    """VAL-3: how many values lie outside, one row per column, one pass."""
    g = df.agg(*(F.count_if((F.col(f"`{c}`") < lo) | (F.col(f"`{c}`") > hi)).alias(c) for c, (lo, hi) in ranges.items()))
    out = g.unpivot([], list(ranges), "check", "bad")
    return out.select(F.concat(F.lit(f"{name}:"), "check").alias("check"), (F.col("bad") == 0).alias("ok"), F.col("bad").cast("string").alias("detail"))


def monotone(df: DataFrame, keys: list[str], order: str, value: str, name: str = "monotone", tolerance: float = 1e-6) -> DataFrame:
    """VAL-4."""
    g = monotone_breaks(df, keys, order, value, tolerance).agg(F.count("*").alias("bad"))
    return g.select(F.lit(f"{name}:{value}").alias("check"), (F.col("bad") == 0).alias("ok"), F.col("bad").cast("string").alias("detail"))


def same_keys(a: DataFrame, b: DataFrame, key: str, name: str = "keys") -> DataFrame:
    """VAL-5, JON-17, SET-8: keys that only one side has, counted both ways."""
    ka, kb = (d.select(F.col(key).cast("string").alias("k")).filter("k is not null").distinct() for d in (a, b))
    only_a = ka.join(kb, "k", "left_anti").agg(F.count("*").alias("n")).withColumn("side", F.lit("left_only"))
    only_b = kb.join(ka, "k", "left_anti").agg(F.count("*").alias("n")).withColumn("side", F.lit("right_only"))
    both = only_a.unionByName(only_b)
    return both.select(F.concat(F.lit(f"{name}:"), "side").alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").cast("string").alias("detail"))


def flow_checks(flows: DataFrame, total: float, tolerance: float = 1e-6) -> DataFrame:
    """VAL-6, AGG-28, AGG-29: no negative flow, the total, mean distance and asymmetry as details."""
    g = flows.agg(F.count_if(F.col("flow") < 0).alias("negative"), F.sum("flow").alias("total"), weighted_mean("dist_km", "flow").alias("mean_km"))
    rows = g.select(F.explode(F.array(F.struct(F.lit("flow:non_negative").alias("check"), (F.col("negative") == 0).alias("ok"), F.col("negative").cast("string").alias("detail")), F.struct(F.lit("flow:total").alias("check"), (F.abs(F.col("total") - total) <= tolerance * total).alias("ok"), F.col("total").cast("string").alias("detail")), F.struct(F.lit("flow:mean_km").alias("check"), F.col("mean_km").isNotNull().alias("ok"), F.col("mean_km").cast("string").alias("detail")))).alias("r")).select("r.*")
    skew = asymmetry(flows).select(F.lit("flow:asymmetry").alias("check"), F.lit(True).alias("ok"), F.col("mean_asymmetry").cast("string").alias("detail"))
    return rows.unionByName(skew)


def inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """VAL-7, VAL-9: (path, exists, bytes) by the file system that each path belongs to."""
    rows = []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(conf)
        there = fs.exists(where)
        rows.append((p, bool(there), int(fs.getContentSummary(where).getLength()) if there else 0))
    return spark.createDataFrame(rows, "path string, exists boolean, bytes long")


def data_menu(spark: SparkSession, themes: dict[str, str], kind: str = "parquet") -> DataFrame:
    """VAL-7, VAL-9: (theme, path, exists, bytes, variables, rows) of a catalogue of tables; those that are missing have no variables."""
    files = inventory(spark, list(themes.values()))
    there = {r["path"] for r in files.filter("exists").collect()}  # a row a theme
    tables = {t: spark.read.format(kind).load(p) for t, p in themes.items() if p in there}
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(t).alias("theme"), F.lit(",".join(df.columns)).alias("variables"), "rows") for t, df in tables.items()]
    menu = spark.createDataFrame(list(themes.items()), "theme string, path string").join(files, "path")
    if not counts:
        return menu.select("theme", "path", "exists", "bytes", F.lit(None).cast("string").alias("variables"), F.lit(None).cast("long").alias("rows"))
    return menu.join(reduce(DataFrame.unionAll, counts), "theme", "left").select("theme", "path", "exists", "bytes", "variables", "rows")


def grid_checks(spark: SparkSession, specs: dict[str, GridSpec], cells: DataFrame, layers: list[str]) -> DataFrame:
    """VAL-8: specs agree with the first one; range of each layer."""
    first = next(iter(specs.values()))
    rows = [(f"grid:{k}", first.same_grid(v), f"{v.height}x{v.width}") for k, v in specs.items()]
    g = cells.agg(*(F.min(c).alias(f"lo_{c}") for c in layers), *(F.max(c).alias(f"hi_{c}") for c in layers)).first()
    rows += [(f"layer:{c}", g[f"lo_{c}"] is not None, f"{g[f'lo_{c}']}..{g[f'hi_{c}']}") for c in layers]
    return spark.createDataFrame(rows, RESULT)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """VAL-10: path, bytes, modification time and md5 of every file under a path; files are read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"))


#: Kinds of survey files by name.
FILE_KINDS = {"base": r"(?i)base", "adm2": r"(?i)adm2", "map": r"(?i)map_?(\d+)"}


def classify_files(files: DataFrame, name: str = "file") -> DataFrame:
    """VAL-12: kind by name (map before base and adm2), and a map's number."""
    n = F.regexp_extract(name, FILE_KINDS["map"], 1)
    kind = F.when(n != "", "map").when(F.col(name).rlike(FILE_KINDS["adm2"]), "adm2").when(F.col(name).rlike(FILE_KINDS["base"]), "base").otherwise("other")
    return files.select("*", kind.alias("kind"), F.when(n != "", n.cast("int")).alias("number"))


def survey_inputs(tables: dict[str, DataFrame]) -> DataFrame:
    """VAL-11: the columns that raw survey files must have."""
    need = {"base": ["adm2code", "muni_n_af"], "adm2": ["iso3", "adm0name", "adm1name", "adm1code", "adm2name", "adm2code"], "map": ["muni_n_af", "variable", "value"]}
    out = None
    for name, df in tables.items():
        kind = next((k for k in ("map", "adm2", "base") if re.search(FILE_KINDS[k], name)), None)
        if kind:
            row = required_columns(df, need[kind], name)
            out = row if out is None else out.unionByName(row)
    return out
