"""Connected cells (CLU): groups of each tile by itself, border equivalences contracted once, and what is done with the groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import sized, written

_HALF = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, 0), (1, 1), (1, -1)]}
_ROW = 1 << 32


def unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n things' groups, given pairs that belong together: the roots of all pairs are hooked
    to the smaller one and paths are halved, all at once, until no pair differs."""
    parent = np.arange(n)
    while len(a):
        pa, pb = parent[a], parent[b]
        differ = pa != pb
        a, b, pa, pb = a[differ], b[differ], pa[differ], pb[differ]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def _tile_groups(row: np.ndarray, col: np.ndarray, connectivity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells in scan order, and for each the place of the first cell of its group."""
    width = int(col.max() - col.min()) + 3
    code = np.unique((row - row.min()) * width + (col - col.min()) + 1)
    a, b = [], []
    for i, j in _HALF[connectivity]:
        there = code + i * width + j
        at = np.minimum(np.searchsorted(code, there), len(code) - 1)
        met = np.flatnonzero(code[at] == there)
        a.append(met)
        b.append(at[met])
    return code // width + row.min(), code % width - 1 + col.min(), unite(len(code), np.concatenate(a), np.concatenate(b))


def _contract(edges: DataFrame, keys: list[str], local_edges: int, most_rounds: int = 60) -> DataFrame:
    """(keys, root, least): of all nodes that have an edge (root, other) the smallest node of their group.

    Up to local_edges edges one task per key unites them. More are contracted in rounds: each node points to the least of
    itself and its neighbours by a hash that is another one each round, edges are redrawn between those, and about half of a
    group's nodes go in a round, whatever its shape.
    """
    if edges.limit(local_edges + 1).count() <= local_edges:
        schema = T.StructType([*(edges.schema[k] for k in keys), T.StructField("root", T.LongType()), T.StructField("least", T.LongType())])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            names, at = np.unique(pdf[["root", "other"]].to_numpy().ravel(), return_inverse=True)
            at = at.reshape(-1, 2)
            found = pd.DataFrame({"root": names, "least": names[unite(len(names), at[:, 0], at[:, 1])]})
            return found.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "root", "least"]]

        return written(edges.groupBy(*(keys or [F.lit(1).alias("all")])).applyInPandas(lambda pdf: run(pdf), schema), "united")
    node = lambda c: F.struct(*keys, F.col(c).alias("root"))
    left = written(edges.select(node("root").alias("a"), node("other").alias("b")), "edges")
    labels = left.select(F.col("a").alias("node")).unionAll(left.select("b")).distinct().withColumn("to", F.col("node"))
    for done in range(most_rounds):
        ranked = lambda c, done=done: F.struct(F.xxhash64(c, F.lit(done)).alias("h"), F.col(c).alias("node"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("from"), F.least(ranked("a"), "m")["node"].alias("next")), "pointers")
        labels = written(labels.join(step.withColumnRenamed("from", "to"), "to", "left").select("node", F.coalesce("next", "to").alias("to")), "labels")
        pa, pb = step.select(F.col("from").alias("a"), F.col("next").alias("ta")), step.select(F.col("from").alias("b"), F.col("next").alias("tb"))
        left = written(left.join(pa, "a").join(pb, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).filter("a <> b").distinct(), "edges")
        if left.isEmpty():
            least = labels.groupBy("to").agg(F.min("node.root").alias("least"))
            return written(labels.join(least, "to").select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.root").alias("root"), "least"), "united")
    raise RuntimeError("connected_components: contraction did not end")


def connected_components(selected: DataFrame, connectivity: int = 8, keys: tuple[str, ...] = ("aoi",), tile: int = 512, local_edges: int = 2_000_000, local_groups: int = 200_000) -> DataFrame:
    """CLU-1: selected cells (keys, row, col) with cluster_id 1..K per key in the order of their first cells by scan.

    Every tile joins its own cells, vectorised; groups that touch across tile borders are equivalent, and these equivalences,
    far fewer than cells, are contracted once. The number of rounds doesn't depend on the groups' shape or length.
    """
    if connectivity not in _HALF:
        raise ValueError("connectivity is 4 or 8")
    keys = [k for k in keys if k in selected.columns]
    cells = selected.select(*keys, "row", "col").withColumns({"__r": F.floor(F.col("row") / tile), "__c": F.floor(F.col("col") / tile)})
    schema = T.StructType([*(selected.schema[k] for k in keys), *(T.StructField(c, T.IntegerType()) for c in ("row", "col")), T.StructField("root", T.LongType())])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col, first = _tile_groups(pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64), connectivity)
        out = pd.DataFrame({"row": row.astype(np.int32), "col": col.astype(np.int32), "root": row[first] * _ROW + col[first]})
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "row", "col", "root"]]

    labels = written(cells.groupBy(*keys, "__r", "__c").applyInPandas(lambda pdf: local(pdf), schema), "labels")
    inside = lambda c: F.pmod(F.col(c), F.lit(tile)).between(1, tile - 2)
    border = labels.filter(~(inside("row") & inside("col")))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _HALF[connectivity])))
    there = border.select(*keys, "row", "col", "root", steps.alias("o")).select(*keys, "root", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    edges = there.join(border.withColumnRenamed("root", "other"), [*keys, "row", "col"]).filter("root <> other").select(*keys, "root", "other")
    if not edges.isEmpty():
        united = _contract(written(edges.distinct(), "edges"), keys, local_edges)
        labels = labels.join(sized(united), [*keys, "root"], "left").withColumn("root", F.coalesce("least", "root")).drop("least")
    firsts = labels.select(*keys, "root").distinct()
    if labels.limit(local_groups + 1).count() <= local_groups:
        numbered = firsts.withColumn("cluster_id", F.row_number().over(Window.partitionBy(*keys).orderBy("root")))
    else:  # ranges of groups are counted, and numbered on from the sum of those before
        ranged = written(firsts.repartitionByRange(*keys, "root").withColumn("__p", F.spark_partition_id()), "ranges")
        per = ranged.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
        per = per.select(*keys, "__p", (F.sum("__n").over(Window.partitionBy(*keys).orderBy("__p")) - F.col("__n")).alias("__before"))
        numbered = ranged.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__p").orderBy("root"))).join(per, [*keys, "__p"])
        numbered = numbered.select(*keys, "root", (F.col("__before") + F.col("__k")).cast("int").alias("cluster_id"))
    return labels.join(numbered, [*keys, "root"]).select(*keys, "row", "col", "cluster_id")


def prune(labelled: DataFrame, min_cells: int = 1, min_km2: float = 0.0, area: str | None = "area_km2", keys: tuple[str, ...] = ("aoi",)) -> DataFrame:
    """CLU-2, CLU-3: clusters with enough cells and area, renumbered 1..K in the old order."""
    keys = [k for k in keys if k in labelled.columns]
    km2 = F.sum(area) if area and area in labelled.columns else F.lit(float("inf"))
    size = labelled.groupBy(*keys, "cluster_id").agg(F.count("*").alias("cells"), km2.alias("km2")).filter((F.col("cells") >= min_cells) & (F.col("km2") >= min_km2))
    order = Window.partitionBy(*keys).orderBy("cluster_id") if keys else Window.orderBy("cluster_id")
    names = size.select(*keys, "cluster_id", F.row_number().over(order).alias("__new"))
    return labelled.join(names, [*keys, "cluster_id"]).drop("cluster_id").withColumnRenamed("__new", "cluster_id")


def remove_small(cells: DataFrame, mask: str, min_cells: int | Column, connectivity: int = 4, keys: tuple[str, ...] = ("aoi",)) -> DataFrame:
    """FOC-4: groups of mask = 1 with fewer cells become 0; 0 and null stay. min_cells may be a column over the keys."""
    if isinstance(min_cells, int) and min_cells <= 1:
        return cells
    use = [k for k in keys if k in cells.columns]
    labelled = connected_components(cells.filter(F.col(mask) == 1).select(*use, "row", "col"), connectivity, tuple(use))
    sizes = labelled.groupBy(*use, "cluster_id").agg(F.count("*").alias("__cells")).filter(F.col("__cells") < min_cells)
    small = labelled.join(sizes, [*use, "cluster_id"]).select(*use, "row", "col", F.lit(True).alias("__small"))
    return cells.join(small, [*use, "row", "col"], "left").withColumn(mask, F.when(F.col("__small"), 0).otherwise(F.col(mask))).drop("__small")


def order_clusters(stats: DataFrame) -> DataFrame:
    """CLU-4: by area, then population, largest first, no data last."""
    return stats.orderBy(F.desc_nulls_last("area_km2"), F.desc_nulls_last("pop"), "cluster_id")
