"""Schemas of inputs and result tables, and the lock that brings a result to its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.numeric import np_round


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """Flat columns "name type, ..." without the session that Spark's own parser needs."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in text.split(","))])


GRID_SPEC = _schema("aoi string, x0 double, y0 double, dx double, dy double, height int, width int, crs string")
ZONES = _schema("aoi string, zone_id int, adm2 string, nam_1 string, nam_2 string, lon double, lat double")
POINTS = _schema("aoi string, layer string, point_id string, lon double, lat double")
_VERTEX = _schema("x double, y double")
FEATURES = _schema("layer string, feature_id bigint, seq int, kind string, fclass string, value double").add("parts", T.ArrayType(T.ArrayType(_VERTEX)))
ISOCHRONE_KPIS = _schema("travel_cut_min double, pop_within double, cells_within bigint, area_km2_within double, pop_pct double, cropland_km2 double, cropland_pct double, electrified_cells bigint, electrified_pct double, pop_total double, cropland_total_km2 double, electrified_total_cells bigint, note_electrification_denominator_zero boolean")
ADMIN2_RANK = _schema("zone_id int, score double, rank int, selected boolean, share_selected double, selected_cells bigint, selected_km2 double, total_cells bigint, total_km2 double")
SITE_AUDIT = _schema("site_id int, lon double, lat double, row int, col int, travel_min double, veg_index double, ntl double, drought_pct double, cropland_cells_5km bigint, cropland_km2_5km double, electrified_cells_5km bigint, electrified_share_5km double, near_road_flag int")
CLUSTERS = _schema("cluster_id int, area_km2 double, pop double, cropland_km2 double, pct_electrified double, pct_rural double, mean_travel_min double, drought_mean_0_1 double, risk_roadcells bigint, flood_depth_mean_m double, rwi_mean double, centroid_lon double, centroid_lat double, zone_id int")
OD_FLOWS = _schema("oi string, dj string, flow double, dist_km double")
SYNERGIES = _schema("site_id string, lon double, lat double")


def enforce_schema(df: DataFrame, schema: T.StructType, defaults: dict | None = None, rounding: dict[str, int] | None = None) -> DataFrame:
    """df's columns in the schema's order and types: missing ones take a default (else null), text that is no number is null."""
    defaults, rounding = defaults or {}, rounding or {}
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(defaults.get(f.name))
        if f.name in df.columns and isinstance(df.schema[f.name].dataType, T.StringType) and isinstance(f.dataType, T.NumericType):
            c = c.try_cast(f.dataType)
        else:
            c = c.cast(f.dataType)
        if f.name in df.columns and defaults.get(f.name) is not None:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        if f.name in rounding:
            c = np_round(c, rounding[f.name]).cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table of the schema without rows, so that a step whose inputs are missing still writes its header."""
    return spark.createDataFrame([], schema)
