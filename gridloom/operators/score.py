"""Priority scores (PRJ): layers to 0..1 components, weighted blends, eligibility.

Thresholds that need the whole area (percentiles, medians, maxima) come from one aggregate over the cells, then everything
is a projection. cells: travel_min, pop, veg, ntl, drought, pov, food, mtt, rwi, rural, crop_frac. A layer is absent if its
column is, or holds no value at all: its component or mask is left out then. in_aoi is respected by nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import clamp, minmax_scale, normalize_linear
from gridloom.operators.focal import focal_mean
from gridloom.operators.ordered import scalar_quantiles
from gridloom.operators.select import percentile_of, select_top, top_percent
from gridloom.params import COMPONENTS, Params
from gridloom.session import written

#: Weights of the first version's blend.
V1_WEIGHTS = {"access": 0.35, "pop": 0.25, "veg": 0.20, "ntl": 0.10, "drought": 0.10}
OVERLAYS = ("pov", "food", "mtt", "rwi")
LAYERS = {"access": "travel_min", "pop": "pop", "veg": "veg", "ntl": "ntl", "drought": "drought", **{k: k for k in OVERLAYS}, "rural": "rural", "crop_frac": "crop_frac"}


def scalars(cells: DataFrame) -> dict[str, float | None]:
    """All thresholds of the area in the same passes, and how many values each layer has (n_<layer>; 0 where it is absent)."""
    has = set(cells.columns)
    want = {f"n_{c}": F.count(c) if c in has else F.lit(0) for c in LAYERS.values()}
    places: dict[str, tuple[str, float]] = {}
    if "pop" in has:
        want |= {"pop_max": F.max("pop")}
        places |= {"pop_p95": ("__pop", 0.95), "pop_p95_all": ("pop", 0.95)}
    if "drought" in has:
        places |= {"drought_median": ("drought", 0.5)}
    if "mtt" in has:
        want |= {"mtt_lo": F.min("mtt"), "mtt_hi": F.max("mtt")}
        places |= {"mtt_median": ("mtt", 0.5)}
    if "rwi" in has:
        places |= {"rwi_p5": ("rwi", 0.05), "rwi_p95": ("rwi", 0.95), "rwi_p1": ("rwi", 0.01), "rwi_p99": ("rwi", 0.99)}
    out = cells.agg(*(c.cast("double").alias(k) for k, c in want.items())).first().asDict()
    if places:
        out |= scalar_quantiles(cells.withColumn("__pop", F.when(F.col("pop") >= 0, F.col("pop"))) if "pop" in has else cells, places)
    return out


def percentile_cap(cells: DataFrame, value: str, p: float, out: str) -> tuple[DataFrame, float]:
    """PRJ-4: values capped at their percentile, and the percentile; without any value: zeros and 0."""
    cut = percentile_of(cells, value, p)
    return (cells.withColumn(out, clamp(value, None, float(cut))), float(cut)) if cut is not None else (cells.withColumn(out, F.lit(0.0)), 0.0)


def access_v1(travel: str = "travel_min") -> Column:
    """PRJ-5, PRJ-6: 1 - travel / 240 with travel held to 0..240."""
    return 1 - clamp(travel, 0.0, 240.0) / 240.0


def score_v1(cells: DataFrame) -> DataFrame:
    """The first version (PRJ-5..10, PRJ-15): fixed caps and weights; null if any component is."""
    s = scalars(cells)
    p95 = float(s["pop_p95_all"]) if (s["pop_p95_all"] or 0) > 0 else 1.0
    parts = {
        "access": access_v1(),
        "pop": normalize_linear("pop", 0.0, p95),
        "veg": normalize_linear("veg", 0.3, 1.0),
        "ntl": normalize_linear("ntl", 0.0, 0.3),
        "drought": 1 - normalize_linear("drought", 0.0, 30.0),
    }
    return cells.withColumn("score", sum((V1_WEIGHTS[k] * c for k, c in parts.items()), F.lit(0.0)))


def components(cells: DataFrame, p: Params = Params(), s: dict | None = None) -> dict[str, Column]:
    """PRJ-6..13, 19: each component in 0..1, larger is more urgent. Units are told by medians: drought above 1 is percent,
    municipal minutes below 6 are hours."""
    s = s or scalars(cells)
    pop_top = s.get("pop_p95") or s.get("pop_max") or 1.0
    percent = (s.get("drought_median") or 0) > 1
    every = {
        "access": lambda: minmax_scale("travel_min", 0.0, float(max(p.iso_thresholds)), invert=True),
        "pop": lambda: minmax_scale("pop", 0.0, float(pop_top)),
        "veg": lambda: minmax_scale("veg", p.veg_min, 1.0),
        "ntl": lambda: minmax_scale("ntl", 0.0, p.ntl_cap),
        "drought": lambda: minmax_scale(F.col("drought") / 100 if percent else F.col("drought"), 0.0, 0.30, invert=True),
        "pov": lambda: clamp("pov", 0.0, 1.0),
        "food": lambda: clamp("food", 0.0, 1.0),
        "mtt": lambda: minmax_scale(F.col("mtt") * (60.0 if s["mtt_median"] < 6 else 1.0), 0.0, float(max(p.iso_thresholds)), invert=True),
        "rwi": lambda: minmax_scale("rwi", s["rwi_p5"], s["rwi_p95"], invert=True),
    }
    return {k: make() for k, make in every.items() if s[f"n_{LAYERS[k]}"]}


def rwi_to_equity(cells: DataFrame, out: str = "equity") -> DataFrame:
    """PRJ-14: wealth within its 1st and 99th percentiles, scaled and inverted."""
    s = scalars(cells)
    return cells.withColumn(out, minmax_scale("rwi", s["rwi_p1"], s["rwi_p99"], invert=True) if s["rwi_p1"] is not None else F.lit(None).cast("double"))


def effective_weights(available, p: Params = Params(), overlays: bool = True) -> dict[str, float]:
    """PRJ-16: weights of the components that are switched on, present and above 0, made to sum to 1."""
    on = {k for k, use in zip(COMPONENTS, p.use_components, strict=True) if use} | (set(OVERLAYS) if overlays else set())
    w = {k: p.weights.get(k, 0.0) for k in available if k in on and p.weights.get(k, 0.0) > 0}
    total = sum(w.values())
    if total <= 0:
        raise ValueError("no component with a positive weight is available")
    return {k: v / total for k, v in w.items()}


def blend(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of weighted components held to 0..1; null if a used one is."""
    return clamp(sum((F.lit(w) * parts[k] for k, w in weights.items()), F.lit(0.0)), 0.0, 1.0)


def eligible(score: Column, p: Params, s: dict) -> Column:
    """PRJ-18: the score where the cell is rural and has the cropland asked for, else null; an absent layer masks nothing."""
    ok = F.lit(True)
    if p.mask_require_rural and s["n_rural"]:
        ok = ok & (F.col("rural") > 0.5)
    if p.mask_min_cropland > 0 and s["n_crop_frac"]:
        ok = ok & (F.col("crop_frac") >= p.mask_min_cropland)
    return F.when(ok, score)


def priority_score(cells: DataFrame, p: Params = Params(), overlays: bool = True) -> DataFrame:
    """Blend, eligibility and smoothing: cells with `score`."""
    s = scalars(cells)
    parts = components(cells, p, s)
    scored = cells.withColumn("score", eligible(blend(parts, effective_weights(parts, p, overlays)), p, s))
    return focal_mean(scored, "score", p.smooth_radius, preserve_nulls=p.smooth_preserve_nulls)


def priority_v1(cells: DataFrame, percent: float = 10.0) -> DataFrame:
    """Q03: first version's score and its top cells."""
    return top_percent(score_v1(cells), "score", percent)


def priority_mask(cells: DataFrame, p: Params = Params()) -> DataFrame:
    """Q07 up to the mask: score, top cells, without small groups."""
    from gridloom.operators.cluster import remove_small

    scored = written(priority_score(cells, p), "scored")
    chosen = select_top(scored, "score", p.top_pct_cells, p.top_km2)
    return remove_small(chosen, "selected", p.min_cluster_cells, p.prune_connectivity)
