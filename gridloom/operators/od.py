"""Gravity flows between zones (GRV). zones: code, lon, lat, mass; the model has all pairs, or those within the cutoff."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import haversine_km
from gridloom.functions.numeric import cutoff, equity_mass, impedance
from gridloom.operators.distance import radius_pairs
from gridloom.operators.ordered import scalar_quantiles
from gridloom.operators.raster import polygon_cells
from gridloom.operators.zonal import weighted_mean
from gridloom.params import Params
from gridloom.session import sized, written


def zone_population(cells: DataFrame, zones: DataFrame, spec, value: str = "pop") -> DataFrame:
    """GRV-1: people of the cells whose centres lie in each zone; zones without any are 0."""
    inside = cells.select("row", "col", value).join(polygon_cells(zones, spec), ["row", "col"]).groupBy("feature_id").agg(F.sum(value).alias("pop"))
    return zones.join(inside, "feature_id", "left").fillna(0.0, ["pop"])


def with_mass(zones: DataFrame, p: Params = Params(), pop: str = "pop", rwi: str = "rwi_z") -> DataFrame:
    return zones.withColumn("mass", equity_mass(pop, rwi if rwi in zones.columns else F.lit(None).cast("double"), p.rwi_weight, p.tilt_sign))


def distances(zones: DataFrame, code: str = "code") -> DataFrame:
    """JON-12: every ordered pair of zones, the diagonal included, with dist_km."""
    a = zones.select(F.col(code).alias("oi"), F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"), F.col("mass").alias("o_mass"))
    b = zones.select(F.col(code).alias("dj"), F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat"), F.col("mass").alias("d_mass"))
    return a.crossJoin(b).withColumn("dist_km", haversine_km("o_lon", "o_lat", "d_lon", "d_lat"))


def near_distances(zones: DataFrame, km: float, code: str = "code") -> DataFrame:
    """JON-12 within a distance: the ordered pairs at most `km` apart, anywhere on the Earth; zones without a place have none."""
    a = zones.select(F.col(code).alias("oi"), F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"), F.col("mass").alias("o_mass"))
    b = zones.select(F.col(code).alias("dj"), F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"), F.col("mass").alias("d_mass"))
    return radius_pairs(a, b, km).withColumnsRenamed({"p_lon": "o_lon", "p_lat": "o_lat", "t_lon": "d_lon", "t_lat": "d_lat"})


def bilateral(pairs: DataFrame, weights: DataFrame | None) -> DataFrame:
    """JON-18: pair weights (oi, dj, w), 1 where there is none."""
    if weights is None:
        return pairs.withColumn("w", F.lit(1.0))
    return pairs.join(weights.select("oi", "dj", F.col("w").cast("double").alias("w")), ["oi", "dj"], "left").fillna(1.0, ["w"])


def gravity(zones: DataFrame, p: Params = Params(), code: str = "code", weights: DataFrame | None = None, min_pop: float | None = None, beyond_cutoff: bool = True) -> DataFrame:
    """GRV-2, GRV-7: flows oi, dj, flow, dist_km that sum to the trips; an error if nothing can flow.

    All pairs have a row, as in the published tables; those beyond the cutoff carry nothing. Without `beyond_cutoff` they are
    never formed: a join by cubes gives the others, and their rows are the same.
    """
    if min_pop is not None:
        zones = zones.filter(F.col("pop") >= min_pop)
    pairs = distances(zones, code) if beyond_cutoff or p.od_cutoff_km is None else near_distances(zones, p.od_cutoff_km, code)
    d = bilateral(pairs, weights)
    f = impedance("dist_km", p.od_impedance, p.od_lambda, p.od_beta)
    raw = F.pow(F.greatest("o_mass", F.lit(0.0)), F.lit(p.od_alpha)) * F.pow(F.greatest("d_mass", F.lit(0.0)), F.lit(p.od_gamma)) * f * F.col("w")
    raw = F.greatest(F.lit(0.0), cutoff(raw, "dist_km", p.od_cutoff_km))
    flows = written(d.select("oi", "dj", "dist_km", raw.alias("raw")), "flows")
    total = flows.agg(F.sum("raw")).first()[0]
    if not total or total <= 0:
        raise ValueError("the flows sum to nothing")
    flows = flows.select("oi", "dj", (F.col("raw") * (F.lit(p.od_trips) / F.lit(float(total)))).alias("flow"), "dist_km")
    return ipf(flows, zones, p, code) if p.od_ipf else flows


def ipf_step(flows: DataFrame, targets: DataFrame, side: str) -> DataFrame:
    """Flows scaled so that the sums over one side (oi or dj) meet the targets (node, target); sums of 0 are left alone."""
    sums = flows.groupBy(side).agg(F.sum("flow").alias("__s")).join(targets.withColumnRenamed("node", side), side)
    factor = sums.select(side, F.when(F.col("__s") > 0, F.col("target") / F.when(F.col("__s") > 0, F.col("__s"))).otherwise(1.0).alias("__f"))
    return flows.join(factor, side, "left").withColumn("flow", F.col("flow") * F.coalesce("__f", F.lit(1.0))).drop("__f")


def ipf(flows: DataFrame, zones: DataFrame, p: Params = Params(), code: str = "code", rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """GRV-3: rows and columns in turn until both margins are met; targets are the zones' shares of mass times the trips.

    Balancing multiplies each flow by a factor of its origin and one of its destination, so only these two vectors, a number
    a zone, are iterated: a round reads the flows once where they lie, with the destinations' factors at hand, and adds up columns over
    partial sums; the flows are scaled once, at the end. No task holds more than an origin's flows. Sums of 0 are left alone. Warns if the margins are not met within the rounds.
    """
    total = zones.agg(F.sum("mass")).first()[0]
    goal = zones.select(F.col(code).alias("node"), (F.col("mass") / F.lit(float(total)) * p.od_trips).alias("target")).orderBy("node").toArrow()  # a row a zone
    nodes, target = goal["node"].to_pylist(), goal["target"].to_numpy().astype(float)
    places = flows.sparkSession.createDataFrame(pa.table({"node": goal["node"], "at": pa.array(np.arange(len(nodes), dtype=np.int32))}))
    numbered = flows.join(sized(places.select(F.col("node").alias("oi"), F.col("at").alias("i"))), "oi").join(sized(places.select(F.col("node").alias("dj"), F.col("at").alias("j"))), "dj")
    lines = written(numbered.groupBy("i").agg(F.collect_list(F.struct("j", "flow")).alias("to")), "lines")
    a, b, gap = np.ones(len(nodes)), np.ones(len(nodes)), np.inf
    for _ in range(rounds + 1):

        def sums(batches: Iterator[pa.RecordBatch], a: np.ndarray = a, b: np.ndarray = b) -> Iterator[pa.RecordBatch]:
            """Of each origin its new factor and how far the old one misses (j = -1 - i); of each destination the new column sum."""
            columns = np.zeros(len(b))
            for batch in batches:
                of, to = batch.column(0).to_numpy(), batch.column(1)
                j, flow = (to.flatten().field(k).to_numpy() for k in (0, 1))
                row = np.repeat(np.arange(len(of)), to.value_lengths().to_numpy())
                reached = np.bincount(row, flow * b[j], len(of))
                factor = np.where(reached > 0, target[of] / np.where(reached > 0, reached, 1), a[of])
                columns += np.bincount(j, flow * factor[row], len(b))
                yield pa.record_batch([pa.array(-1 - of.astype(np.int64)), pa.array(factor), pa.array(np.abs(a[of] * reached - target[of]))], names=["j", "x", "gap"])
            some = np.flatnonzero(columns)
            yield pa.record_batch([pa.array(some), pa.array(columns[some]), pa.array(np.zeros(len(some)))], names=["j", "x", "gap"])

        found = lines.mapInArrow(sums, "j long, x double, gap double").groupBy("j").agg(F.sum("x").alias("x"), F.max("gap").alias("gap")).toArrow()  # two rows a zone
        at, x = found["j"].to_numpy(), found["x"].to_numpy()
        # columns were met by the last factors, so the rows' misses are all that is left
        gap = float(found["gap"].to_numpy().max(initial=0.0))
        if gap < tolerance:
            break
        a, b = a.copy(), b.copy()
        a[-1 - at[at < 0]] = x[at < 0]
        met = at[at >= 0]
        b[met] = np.where(x[at >= 0] > 0, target[met] / x[at >= 0], b[met])
    else:
        warnings.warn(f"ipf: margins are off by up to {gap:.4g} after {rounds} rounds", stacklevel=2)
    factors = flows.sparkSession.createDataFrame(pa.table({"node": goal["node"], "a": pa.array(a), "b": pa.array(b)}))
    out = flows.join(sized(factors.select(F.col("node").alias("oi"), "a")), "oi").join(sized(factors.select(F.col("node").alias("dj"), "b")), "dj")
    return out.select("oi", "dj", (F.col("flow") * F.col("a") * F.col("b")).alias("flow"), "dist_km")


def agents_exact(flows: DataFrame, zones: DataFrame, p: Params = Params(), code: str = "code", most: int | None = None, most_zones: int = 2000) -> DataFrame:
    """GRV-4: draws of pairs by their flows from numpy's default generator, in row-major order of the codes; at most one per
    pair of zones unless `most` says otherwise. For at most most_zones zones, as one task holds the matrix; agents_drawn has no such bound."""
    if zones.limit(most_zones + 1).count() > most_zones:
        raise ValueError(f"more than {most_zones} zones: use agents_drawn")
    kind = zones.schema[code].dataType.simpleString()
    n_agents, seed = p.od_agents, p.od_seed

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["oi", "dj"], ignore_index=True)
        codes = sorted(pdf["oi"].unique())
        at = {c: i for i, c in enumerate(codes)}
        matrix = np.zeros((len(codes), len(codes)))
        matrix[[at[c] for c in pdf["oi"]], [at[c] for c in pdf["dj"]]] = pdf["flow"]
        flat = matrix.ravel()
        if flat.sum() <= 0:
            return pd.DataFrame({"agent": [], "oi": [], "dj": [], "o_code": [], "d_code": []})
        draws = np.random.default_rng(seed).choice(flat.size, size=min(n_agents, most or flat.size), replace=True, p=flat / flat.sum())
        i, j = draws // len(codes), draws % len(codes)
        return pd.DataFrame({"agent": np.arange(len(draws)), "oi": i, "dj": j, "o_code": [codes[k] for k in i], "d_code": [codes[k] for k in j]})

    drawn = flows.groupBy(F.lit(1).alias("all")).applyInPandas(lambda pdf: run(pdf), f"agent long, oi int, dj int, o_code {kind}, d_code {kind}")
    return _with_places(drawn, zones, code).select("agent", "oi", "dj", "o_code", "d_code", "o_lon", "o_lat", "d_lon", "d_lat")


def _with_places(drawn: DataFrame, zones: DataFrame, code: str) -> DataFrame:
    for side in "od":
        drawn = drawn.join(zones.select(F.col(code).alias(f"{side}_code"), F.col("lon").alias(f"{side}_lon"), F.col("lat").alias(f"{side}_lat")), f"{side}_code")
    return drawn


#: Whole units that the largest flow is cut into, and agents of an origin that are placed together.
_UNITS, _TOGETHER = 1 << 40, 1 << 16


def agents_drawn(flows: DataFrame, zones: DataFrame, n: int, seed: int = 42, code: str = "code") -> DataFrame:
    """GRV-4 for any number of zones and agents: exactly n draws of pairs, with replacement, by their flows.

    Flows are cut into whole units, so that sums don't depend on their order. Agent k draws a unit by a hash of the seed and k:
    the same agents under any partitioning. The unit falls to an origin by the running sums over origins (a number a
    zone), and inside it to a destination by those over the origin's flows; an origin's agents are placed in blocks.
    """
    largest = flows.agg(F.max("flow")).first()[0]
    if not largest or largest <= 0:
        raise ValueError("the flows sum to nothing")
    scale = _UNITS / 2.0 ** math.ceil(math.log2(largest))
    units = written(flows.select("oi", "dj", F.round(F.col("flow") * scale).cast("long").alias("units")).filter("units > 0"), "units")
    origins = units.groupBy("oi").agg(F.sum("units").alias("u")).orderBy("oi").toArrow()  # a row a zone
    ends = np.cumsum(origins["u"].to_numpy())
    names, total = origins["oi"], int(ends[-1])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = (batch.column(k).to_numpy().view(np.uint64) for k in (1, 2))
            # a unit from 0 to total - 1: the hashes' 128 bits times total, the whole part
            unit = np.array([(((int(h) << 64) | int(w)) * total) >> 128 for h, w in zip(high, low, strict=True)], np.int64)
            at = np.searchsorted(ends, unit, "right")
            yield pa.record_batch([batch.column(0), names.combine_chunks().take(pa.array(at)), pa.array(unit - np.concatenate(([0], ends))[at]), pa.array(batch.column(0).to_numpy() // _TOGETHER)], names=["agent", "oi", "unit", "block"])

    kind = {f.name: f.dataType.simpleString() for f in flows.schema.fields}
    agents = flows.sparkSession.range(n).select(F.col("id").alias("agent"), F.xxhash64(F.lit(seed), "id").alias("h"), F.xxhash64("id", F.lit(seed), F.lit(1)).alias("w"))
    placed = agents.mapInArrow(draw, f"agent long, oi {kind['oi']}, unit long, block long").groupBy("oi", "block").agg(F.collect_list(F.struct("agent", "unit")).alias("agents"))
    lists = units.groupBy("oi").agg(F.sort_array(F.collect_list(F.struct("dj", "units"))).alias("to"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                who, to = (batch.column(c).slice(k, 1).flatten() for c in (1, 2))
                at = np.searchsorted(np.cumsum(to.field(1).to_numpy()), who.field(1).to_numpy(), "right")
                yield pa.record_batch([who.field(0), batch.column(0).take(pa.array(np.full(len(at), k))), to.field(0).take(pa.array(at))], names=["agent", "o_code", "d_code"])

    drawn = placed.join(lists, "oi").select("oi", "agents", "to").mapInArrow(choose, f"agent long, o_code {kind['oi']}, d_code {kind['dj']}")
    return _with_places(drawn, zones, code).select("agent", "o_code", "d_code", "o_lon", "o_lat", "d_lon", "d_lat")


def diagnostics(flows: DataFrame, cutoff_km: float = 1500.0) -> DataFrame:
    """GRV-5: flow-weighted mean and median distance off the diagonal, and the share of flow within the cutoff."""
    off = flows.filter(F.col("oi") != F.col("dj"))
    median = scalar_quantiles(off, {"m": ("dist_km", 0.5)}, "flow")["m"]
    within = F.sum(F.when(F.col("dist_km") <= cutoff_km, F.col("flow")).otherwise(0.0)) / F.sum("flow")
    return off.agg(weighted_mean("dist_km", "flow").alias("mean_km"), F.lit(median).cast("double").alias("median_km"), within.alias("share_within"))


def zone_attributes(zones: DataFrame, code: str = "code") -> DataFrame:
    """GRV-6: attribute columns, ids first."""
    first = [c for c in (code, "NAM_1", "NAM_2", "lon", "lat", "pop", "rwi_z", "mass") if c in zones.columns]
    return zones.select(*first, *(c for c in zones.columns if c not in first))


def priority_flags(zones: DataFrame, shares: DataFrame | None, code: str = "code") -> DataFrame:
    """GRV-8: in_priority_mask by the first of: own flag, own share, a rank table's share, its selected flag; else false."""
    levels: list[Column] = []
    if "in_priority_mask" in zones.columns:
        levels.append(F.col("in_priority_mask").cast("boolean"))
    if "share_selected" in zones.columns:
        levels.append(F.col("share_selected") > 0)
    if shares is not None:
        more = shares.select(F.col(code), *(F.col(c).alias(f"__{c}") for c in ("share_selected", "selected") if c in shares.columns))
        zones = zones.join(more, code, "left")
        levels += [F.col("__share_selected") > 0] if "__share_selected" in zones.columns else []
        levels += [F.col("__selected").cast("boolean")] if "__selected" in zones.columns else []
    flag = reduce(lambda a, b: F.coalesce(a, b), [*levels, F.lit(False)])
    return zones.withColumn("in_priority_mask", flag).drop("__share_selected", "__selected")
