"""Operator 3: mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words: shares of the whole corpus by weight, stopped at three times what the source
has, the excess shared anew. A source's target is then met by whole epochs of all its documents and one partial epoch: its
documents are counted by exact length, a proportional part of each count is taken (the lengths with the largest fractions get
one more each), and the last part of the budget is fitted by a bounded-knapsack dynamic programme. Which documents of a length
are taken follows from a seeded hash of their ids and texts, so reruns agree.

Columns are named by arguments. Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; a null id
hashes as null; equal rows are told apart only by their place in the order; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.kernel import free_name
from gridloom.session import written

#: Weights of the sources in order, repeating, and the most copies of a document.
WEIGHTS, COPIES = (5.0, 2.0, 1.0), 3
TOKEN = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, copies: int = COPIES, share: float = 1.0) -> dict[str | None, float]:
    """Target words by source: weights in code-point order (null last), none above copies * size, the excess reshared."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(share) * sum(sizes.values()), list(names), dict.fromkeys(names, 0.0)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] >= copies * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(copies * sizes[s])
            left -= out[s]
        left, open_ = max(left, 0.0), [s for s in open_ if s not in full]
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: float, cap: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take so that their total is as near to budget as the programme finds, on either side.

    Proportional parts first; while more than `cap` words are left, one more of each length in the order of the fractions that
    were cut off (all lengths' parts stay proportional to within one document); then an exact bounded-knapsack programme
    (bitsets over totals up to twice the rest, beyond which taking nothing more is nearer) over the counts that are still free.
    Of two totals that are equally near the smaller one is taken.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    taken = np.minimum(counts, np.floor(counts * (budget / total)).astype(np.int64))
    left = budget - int((taken * lengths).sum())
    fraction = counts * (budget / total) - taken
    for i in np.lexsort((lengths, -fraction)):
        if left <= cap:
            break
        if 0 < lengths[i] <= left and taken[i] < counts[i]:
            taken[i] += 1
            left -= int(lengths[i])
    if left <= 0:
        return taken
    most = int(2 * left)
    # items: (index, number) with numbers in powers of two, so that every count up to the free one can be formed
    items: list[tuple[int, int]] = []
    for i in np.flatnonzero((lengths > 0) & (lengths <= most) & (counts > taken)):
        free, part = int(min(counts[i] - taken[i], most // lengths[i])), 1
        while free > 0:
            items.append((int(i), min(part, free)))
            free, part = free - min(part, free), part * 2
    mask, reach, history = (1 << (most + 1)) - 1, 1, []
    for i, number in items:
        history.append(reach)
        reach |= (reach << (int(lengths[i]) * number)) & mask
        if reach >> round(left) & 1:
            break
    below = (reach & ((1 << (int(left) + 1)) - 1)).bit_length() - 1
    above = reach >> (below + 1)  # the totals beyond
    at = below
    if above:
        next_ = below + (above & -above).bit_length()
        at = next_ if next_ - left < left - below else below
    for (i, number), before in zip(reversed(items[: len(history)]), reversed(history), strict=True):
        if not before >> at & 1:
            taken[i] += number
            at -= int(lengths[i]) * number
    return taken


def sizes_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, copies: int = COPIES, share: float = 1.0, seed: int = 7, split: int = 1024, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies, hash (of the text).

    Only (id, source, size) rows are shuffled. The driver sees one total per source. Documents of one source and length
    are ordered in blocks of about `split` rows: a block's quota follows from the counts of the blocks before it, so a
    length that a third of all rows share is no single task. Memory of a fitting task: one row per distinct length.
    """
    text = F.col(f"`{text_col}`").cast("string")
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), sizes_of(text).alias("size"), F.xxhash64(text).alias("hash"))
    sized = written(base.withColumn("skey", _source_key(F.col("source"))).withColumn("draw", F.xxhash64("doc_id", "hash", F.lit(seed))), "sized")
    hist = sized.groupBy("skey", "size").agg(F.count("*").alias("n"))
    totals = {r["skey"]: int(r["t"]) for r in hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("t")).collect()}
    goal = targets({None if k == "0" else k[1:]: v for k, v in totals.items()}, weights, copies, share)
    goal = {"0" if s is None else "1" + s: t for s, t in goal.items()}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["skey"].iloc[0]
        pdf = pdf.sort_values("size", ignore_index=True)
        total, target = totals[key], goal[key]
        whole = min(copies, int(target // total)) if total else 0
        some = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), target - whole * total) if whole < copies else np.zeros(len(pdf), np.int64)
        return pd.DataFrame({"skey": key, "size": pdf["size"], "whole": whole, "some": some, "blocks": -(-pdf["n"] // split), "source_size": total, "target": target})

    plan = written(hist.groupBy("skey").applyInPandas(fit, "skey string, size long, whole long, some long, blocks long, source_size long, target double"), "mixplan")
    if plan.count() <= 200_000:  # at most about 20 MB; beyond it the join shuffles
        plan = F.broadcast(plan)
    dealt = sized.join(plan, ["skey", "size"]).withColumn("block", F.pmod(F.shiftright("draw", 20), F.col("blocks")))
    per_block = dealt.filter("blocks > 1").groupBy("skey", "size", "block", "some").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("skey", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = per_block.select("skey", "size", "block", F.greatest(F.lit(0), F.col("some") - earlier).alias("quota"))
    place = F.row_number().over(Window.partitionBy("skey", "size", "block").orderBy("draw", "doc_id", "hash"))
    single = dealt.filter("blocks <= 1").withColumn("quota", F.col("some"))
    many = dealt.filter("blocks > 1").join(quotas, ["skey", "size", "block"])
    rows = single.unionByName(many).withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + F.when(place <= F.col("quota"), 1).otherwise(0)))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("int").alias("copies"), "hash")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: df's rows and columns, each row as often as the mix takes it; documents of no words stay once.

    The mix's narrow rows meet the documents by id, source and text hash, in one shuffle of the texts. Rows equal in these are
    interchangeable: each gets their mean number of copies, the remainder going to the first of them.
    """
    names = dict(id_col=id_col, source_col=source_col, text_col=text_col)
    mine, theirs = ([free_name(f"{side}_{c}", df.columns) for c in ("id", "no_id", "source", "hash")] for side in ("own", "mix"))
    n, rows, copies, k = (free_name(c, df.columns) for c in ("mix_n", "mix_rows", "mix_copies", "mix_k"))

    def keys(id_: Column, source: Column, hash_: Column) -> list[Column]:
        return [F.coalesce(id_, F.lit(0).cast("long")), id_.isNull(), _source_key(source), hash_]  # none is null: plain equality joins them

    taken = mix(df, **names, **options).filter("size > 0")
    taken = taken.select(*(c.alias(t) for c, t in zip(keys(F.col("doc_id"), F.col("source"), F.col("hash")), theirs, strict=True)), "copies")
    taken = taken.groupBy(*theirs).agg(F.sum("copies").alias(n), F.count("*").alias(rows))
    text = F.col(f"`{text_col}`").cast("string")
    own = keys(F.col(f"`{id_col}`").cast("long"), F.col(f"`{source_col}`").cast("string"), F.xxhash64(text))
    left = df.select("*", *(c.alias(m) for c, m in zip(own, mine, strict=True)))
    same = F.lit(True)
    for m, t in zip(mine, theirs, strict=True):
        same &= F.col(m) == F.col(t)
    joined = left.join(taken, same, "left")
    place = F.row_number().over(Window.partitionBy(*mine).orderBy(F.lit(1))) - 1
    each = F.floor(F.col(n) / F.col(rows)) + F.when(place < F.col(n) % F.col(rows), 1).otherwise(0)
    counted = joined.withColumn(copies, F.when(F.col(n).isNotNull(), each).otherwise(F.lit(1)).cast("int")).filter(F.col(copies) > 0)
    return counted.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in df.columns))
