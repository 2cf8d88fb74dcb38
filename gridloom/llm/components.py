"""Connected components of a link table by repeated contraction, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import written


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the same for all nodes of a component.

    Each round every node points to the smallest of itself and its neighbours and the edges are redrawn between those, so a
    star vanishes in one round and a component at least halves. When no edge is left, the rounds' pointers, one ever smaller
    table each, are joined from the last to the first. Minima are combined before the shuffle; nothing is collected.
    """
    left = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    rounds = []
    for _ in range(most_rounds):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "pointers")
        rounds.append(to)
        pa, pb = to.select(F.col("node").alias("a"), F.col("root").alias("ta")), to.select(F.col("node").alias("b"), F.col("root").alias("tb"))
        left = written(left.join(pa, "a").join(pb, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).filter("a <> b").distinct(), "edges")
        if left.isEmpty():
            out = rounds.pop()
            while rounds:
                onward = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
                out = rounds.pop().join(onward, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
            return out
    raise RuntimeError("components: contraction did not end")
