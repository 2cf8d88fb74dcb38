"""Travel cost over a friction grid (CST): tiles are solved by themselves and exchange the minutes of their borders."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.numeric import friction
from gridloom.operators.grid import GridSpec
from gridloom.operators.raster import class_max
from gridloom.params import Params
from gridloom.session import written

#: Kilometres of a degree of latitude, and of longitude at the equator.
KM_LAT, KM_LON = 110.574, 111.320


def sampling_km(spec: GridSpec) -> tuple[float, float]:
    """Kilometres of a step down and of a step along, at the grid's mean latitude."""
    middle = spec.y0 - spec.dy * spec.height / 2
    return KM_LAT * abs(spec.dy), KM_LON * math.cos(math.radians(middle)) * abs(spec.dx)


def friction_surface(cells: DataFrame, roads: DataFrame, spec: GridSpec, p: Params = Params()) -> DataFrame:
    """CST-1: cells with friction, minutes per kilometre of the fastest road class on the cell or of walking."""
    speed = class_max(roads, spec, p.road_speeds, p.road_classes).select("row", "col", F.col("value").alias("road_kmh"))
    return cells.join(speed, ["row", "col"], "left").withColumn("friction", friction("road_kmh", p.off_road_kmh))


def solve_tile(friction: np.ndarray, sources: list[tuple[np.ndarray, np.ndarray]], dy: float, dx: float, cutoff: float = math.inf) -> np.ndarray:
    """Least minutes to all cells of a block for many sites at once, from minutes at some of its cells; inf: barrier or not reached.

    friction: minutes per kilometre, NaN where nothing passes; a step costs the mean of both ends, to 8 neighbours. Of each
    site (places in the raveled block, minutes) is given. Cells whose minutes fell offer them to their neighbours, all
    sites' cells together, until none falls.
    """
    height, width = friction.shape
    cells = height * width
    f = friction.ravel()
    best = np.full(len(sources) * cells, np.inf)
    fell = np.zeros(len(best), bool)
    for k, (at, minutes) in enumerate(sources):
        ok = np.isfinite(f[at])
        np.minimum.at(best, k * cells + at[ok], minutes[ok])
        fell[k * cells + at[ok]] = True
    steps = []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            if i or j:
                padded = np.full((height + 2, width + 2), np.nan)
                padded[1:-1, 1:-1] = friction
                there = padded[1 + i : 1 + i + height, 1 + j : 1 + j + width]
                cost = math.hypot(i * dy, j * dx) * (friction + there) / 2
                steps.append((i * width + j, np.where(np.isfinite(cost), cost, np.inf).ravel()))
    front = np.flatnonzero(fell)
    while len(front):
        fell[front] = False
        now, place = best[front], front % cells
        for by, cost in steps:
            new = now + cost[place]
            ok = np.flatnonzero(new <= cutoff) if math.isfinite(cutoff) else np.flatnonzero(np.isfinite(new))
            to = front[ok] + by
            less = new[ok] < best[to]
            to = to[less]
            best[to] = new[ok][less]
            fell[to] = True
        front = np.flatnonzero(fell)
    return best.reshape(len(sources), height, width)


def _land(cells: DataFrame, friction_col: str, tile: int) -> DataFrame:
    """(tr, tc, block): friction of each tile and the ring of cells around it."""
    land = cells.select("row", "col", F.col(friction_col).cast("double").alias("f")).filter(F.col("f").isNotNull() & ~F.isnan("f") & (F.abs("f") != float("inf")))
    for out, c in (("tr", "row"), ("tc", "col")):
        near = F.array_distinct(F.array(*(F.floor((F.col(c) + k) / tile).cast("int") for k in (-1, 0, 1))))
        land = land.withColumn(out, F.explode(near))
    side = tile + 2

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        dense = np.full((side, side), np.nan)
        dense[pdf["row"].to_numpy() - tr * tile + 1, pdf["col"].to_numpy() - tc * tile + 1] = pdf["f"].to_numpy()
        return pd.DataFrame({"tr": [tr], "tc": [tc], "block": [dense.tobytes()]})

    return written(land.groupBy("tr", "tc").applyInPandas(lambda pdf: block(pdf), "tr int, tc int, block binary"), "land")


def _solved(work: DataFrame, land: DataFrame, tile: int, dy: float, dx: float, cutoff: float, key: str, kind: str, borders: bool, together: int, most: int) -> DataFrame:
    """Every (site, tile) of work (key, tr, tc, at, minutes) solved by itself.

    borders: minutes of the tile's outermost cells as (key, tr, tc, at, minutes) of the tiles around that hold them in their
    rings; else (key, row, col, minutes) of the tile's own cells. A tile's sites are dealt to groups of about `most`.
    """
    side = tile + 2
    groups = work.groupBy("tr", "tc").agg(F.approx_count_distinct(key).alias("__n")).select("tr", "tc", F.ceil(F.col("__n") / most).cast("int").alias("__parts"))
    dealt = work.join(groups, ["tr", "tc"]).withColumn("part", F.pmod(F.xxhash64(key), F.col("__parts")).cast("int")).drop("__parts")
    blocks = land.join(groups, ["tr", "tc"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).select("tr", "tc", "part", "block")
    ring = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    inner = np.arange(1, tile + 1)
    sent = []  # by neighbour: own places of the cells that lie in its ring, and their places there
    for i, j in ring:
        r = {-1: inner[:1], 0: inner, 1: inner[-1:]}[i]
        c = {-1: inner[:1], 0: inner, 1: inner[-1:]}[j]
        r, c = (x.ravel() for x in np.meshgrid(r, c, indexing="ij"))
        sent.append((i, j, r * side + c, (r - i * tile) * side + (c - j * tile)))

    def run(pdf: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        columns = [key, "tr", "tc", "at", "minutes"] if borders else [key, "row", "col", "minutes"]
        parts: dict[str, list[np.ndarray]] = {c: [] for c in columns}
        if len(pdf) and len(ground):
            tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
            friction = np.frombuffer(ground["block"].iloc[0]).reshape(side, side)
            code, names = pd.factorize(pdf[key].to_numpy(), use_na_sentinel=False)
            order = np.argsort(code, kind="stable")
            cut = np.searchsorted(code[order], np.arange(len(names) + 1))
            at, minutes = pdf["at"].to_numpy()[order], pdf["minutes"].to_numpy()[order]
            for lo in range(0, len(names), together):
                some = range(lo, min(len(names), lo + together))
                best = solve_tile(friction, [(at[cut[k] : cut[k + 1]], minutes[cut[k] : cut[k + 1]]) for k in some], dy, dx, cutoff)
                if borders:
                    flat = best.reshape(len(best), -1)
                    for i, j, own, there in sent:
                        k, p = np.nonzero(np.isfinite(flat[:, own]))
                        for c, v in zip(columns, (names[lo + k], np.full(len(k), tr + i), np.full(len(k), tc + j), there[p], flat[k, own[p]]), strict=True):
                            parts[c].append(np.asarray(v))
                else:
                    k, r, c = np.nonzero(np.isfinite(best[:, 1:-1, 1:-1]))
                    for name, v in zip(columns, (names[lo + k], r + tr * tile, c + tc * tile, best[k, r + 1, c + 1]), strict=True):
                        parts[name].append(np.asarray(v))
        return pd.DataFrame({c: pd.Series(np.concatenate(v), dtype=v[0].dtype) if v else pd.Series(dtype=object) for c, v in parts.items()})

    schema = f"`{key}` {kind}, " + ("tr int, tc int, at int, minutes double" if borders else "row int, col int, minutes double")
    return dealt.groupBy("tr", "tc", "part").cogroup(blocks.groupBy("tr", "tc", "part")).applyInPandas(lambda a, b: run(a, b), schema)


def travel_minutes(sites: DataFrame, cells: DataFrame, spec: GridSpec, cutoff: float = math.inf, key: str = "site_id", friction_col: str = "friction", tile: int = 256, together: int = 32, most: int = 256, most_rounds: int = 100_000) -> DataFrame:
    """CST-2: (site, row, col, minutes) of all cells reached. Sites: key, row, col; those off the grid or on a barrier reach nothing.

    The friction is cut into tiles with a ring of their neighbours' cells. A tile is solved by itself for all sites that have
    reached it, many sites at once; minutes of its outermost cells go to the tiles around, and only tiles that were offered
    fewer minutes than they knew are solved again, until none is. A grid of one tile needs no rounds.
    """
    dy, dx = sampling_km(spec)
    kind = sites.schema[key].dataType.simpleString()
    tile = min(tile, max(spec.height, spec.width))
    land = _land(cells, friction_col, tile)
    place = (F.col("row") - F.col("tr") * tile + 1) * (tile + 2) + F.col("col") - F.col("tc") * tile + 1
    start = sites.filter(F.col("row").between(0, spec.height - 1) & F.col("col").between(0, spec.width - 1))
    start = start.withColumns({c: F.floor(F.col(k) / tile).cast("int") for c, k in (("tr", "row"), ("tc", "col"))}).select(key, "tr", "tc", place.cast("int").alias("at"), F.lit(0.0).alias("minutes"))
    solve = lambda work, borders: _solved(work, land, tile, dy, dx, cutoff, key, kind, borders, together, most)
    known = front = written(start, "sources")
    if spec.height > tile or spec.width > tile:
        for _ in range(most_rounds):
            if front.isEmpty():
                break
            active = front.select(key, "tr", "tc").distinct()
            offers = solve(known.join(active, [key, "tr", "tc"], "left_semi"), True)
            both = known.withColumn("old", F.lit(True)).unionByName(offers.withColumn("old", F.lit(False)))
            # of equal minutes the known one wins, so nothing is offered twice
            best = written(both.groupBy(key, "tr", "tc", "at").agg(F.min(F.struct("minutes", (~F.col("old")).alias("fresh"))).alias("m")).select(key, "tr", "tc", "at", "m.minutes", "m.fresh"), "known")
            known, front = best.drop("fresh"), best.filter("fresh")
        else:
            raise RuntimeError("travel_minutes: tiles did not settle")
    return solve(known, False)


def isochrone_masks(surface: DataFrame, thresholds, minutes: str = "minutes") -> DataFrame:
    """CST-3, CST-6: one row per cell and threshold with mask 1 or 0; cells not reached are 0."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds)))
    return surface.withColumn("thresh_min", t).withColumn("mask", F.coalesce((F.col(minutes) <= F.col("thresh_min")).cast("int"), F.lit(0)))


def catchment_kpis(surface: DataFrame, cells: DataFrame, thresholds, key: str = "site_id") -> DataFrame:
    """CST-4, AGG-10: per site and threshold: area, people, cropland, mean and people-weighted rwi (over all people reached), mean minutes."""
    masks = isochrone_masks(surface, thresholds).filter("mask = 1")
    joined = masks.join(cells.select("row", "col", "area_km2", "pop", "crop_frac", "rwi"), ["row", "col"])
    w = F.coalesce(F.col("pop"), F.lit(0.0))
    return joined.groupBy(key, "thresh_min").agg(
        F.sum("area_km2").alias("area_km2"),
        F.sum("pop").alias("pop"),
        F.sum(F.col("crop_frac") * F.col("area_km2")).alias("cropland_km2"),
        F.avg("rwi").alias("rwi_mean"),
        F.when(F.sum(w) > 0, F.sum(F.col("rwi") * w) / F.when(F.sum(w) > 0, F.sum(w))).alias("rwi_pop_weighted"),
        F.avg("minutes").alias("mean_travel_min"),
    )


def union_of_catchments(surface: DataFrame, sites: DataFrame, thresholds, key: str = "site_id") -> DataFrame:
    """CST-5, SET-9: per threshold the cells that any of the given sites reaches."""
    return isochrone_masks(surface.join(sites.select(key), key, "left_semi"), thresholds).groupBy("thresh_min", "row", "col").agg(F.max("mask").alias("mask"))


def monotone_breaks(table: DataFrame, key: list[str], order: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """WIN-8, VAL-4: rows whose value falls below that of the row before by more than the tolerance."""
    w = Window.partitionBy(*key).orderBy(order) if key else Window.orderBy(order)
    return table.withColumn("__d", F.col(value) - F.lag(value).over(w)).filter(F.col("__d") < -tolerance).drop("__d")


