"""Operator 8: exact top-k search by multi-resolution segment statistics.

Vectors become integers floor(1024 * x). For segments of any length m, with means u, v and root-sum-square deviations s, t,
the inner product of two segments is at most m*u*v + s*t (Cauchy-Schwarz on what is left after the means), which is the
lower bound of the segments' distance in terms of the score. Summed over the segments of a level it bounds the whole score.
Levels go from 1 segment to ever finer ones; a pair that a level's bound puts below the query's current k-th best score is
dropped, and the pairs that survive are scored exactly. Bounds are batched matrix products over (means, deviations).

Defined cases: vectors that are null, or hold null or non-finite components, take no part; vectors of different lengths are
not compared; two empty vectors score 0; repeated rows count as often as they stand; ties go to the smaller id, nulls last.
Where scores could pass 2**52 the exact step uses integers of any size; a score beyond a long's range is the nearest long, and a
component whose 1024-fold is no finite double counts as non-finite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.kernel import tidy
from gridloom.session import written

SCALE = 1024.0
#: Segments by level, coarse to fine.
LEVELS = (1, 4, 16)
_NULL = np.iinfo(np.int64).max
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _rows(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and integer-valued float64 rows of the vectors that take part."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors, ids = vectors.combine_chunks(), ids.combine_chunks()
    ids = ids.cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False)
    ok = np.asarray(vectors.is_valid())
    lengths = np.where(ok, np.asarray(vectors.value_lengths().fill_null(0)), 0)
    flat = vectors.flatten().cast(pa.float64())
    holes = np.asarray(flat.is_null())
    x = np.floor(SCALE * flat.fill_null(0.0).to_numpy(zero_copy_only=False))
    bad = holes | ~np.isfinite(x)
    ends = np.cumsum(lengths)
    for row in np.unique(np.searchsorted(ends, np.flatnonzero(bad), "right")):
        ok[row] = False
    out = {}
    for d in np.unique(lengths[ok]):
        keep = np.flatnonzero(ok & (lengths == d))
        at = (ends - lengths)[keep][:, None] + np.arange(int(d))[None, :]
        out[int(d)] = (ids[keep], x[at] if d else np.zeros((len(keep), 0)))
    return out


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(m) * mean and the root-sum-square deviation: their inner products bound the score from above."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    out = np.empty((len(x), 2 * len(parts)))
    for i, p in enumerate(parts):
        seg = x[:, p]
        mean = seg.mean(axis=1) if len(p) else np.zeros(len(x))
        out[:, 2 * i] = mean * np.sqrt(len(p))
        out[:, 2 * i + 1] = np.sqrt(np.square(seg - mean[:, None]).sum(axis=1))
    return out


def _exact(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.square(q).sum(axis=1).max(initial=0) * np.square(c).sum(axis=1).max(initial=0))
    out = np.empty(len(qi), np.int64)
    for lo in range(0, len(qi), 1 << 16):
        a, b = qi[lo : lo + (1 << 16)], ci[lo : lo + (1 << 16)]
        if norm < 2.0**52:
            out[lo : lo + len(a)] = np.einsum("ij,ij->i", q[a], c[b]).astype(np.int64)
        else:
            out[lo : lo + len(a)] = [max(_LEAST, min(_MOST, sum(int(x) * int(y) for x, y in zip(q[i], c[j], strict=True)))) for i, j in zip(a, b, strict=True)]
    return out


class Search:
    """Keeps each query's best k of the candidates seen so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.stats = [_statistics(x, s) for s in LEVELS]
        self.best = np.zeros((len(x), 0), np.int64)
        self.best_id = np.zeros((len(x), 0), np.int64)

    def floor(self) -> np.ndarray:
        return self.best[:, self.k - 1].astype(float) if self.best.shape[1] >= self.k else np.full(len(self.x), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray, block: int = 512) -> None:
        for lo in range(0, len(x), block):
            self._block(ids[lo : lo + block], x[lo : lo + block])

    def _block(self, ids: np.ndarray, x: np.ndarray) -> None:
        floor = self.floor()
        stats = [_statistics(x, s) for s in LEVELS]
        bound = self.stats[0] @ stats[0].T
        # written as "not below": a bound that overflows into no number keeps its pair
        qi, ci = np.nonzero(~(bound < (floor - np.abs(floor) * 1e-9 - 1)[:, None])) if np.isfinite(floor).all() else np.indices(bound.shape).reshape(2, -1)
        for mine, theirs in zip(self.stats[1:], stats[1:], strict=True):
            if not len(qi):
                return
            if len(qi) * 4 > bound.size:
                value = (mine @ theirs.T)[qi, ci]
            else:
                value = np.einsum("ij,ij->i", mine[qi], theirs[ci])
            keep = ~(value < floor[qi] - np.where(np.isfinite(floor[qi]), np.abs(floor[qi]), 0) * 1e-9 - 1)
            qi, ci = qi[keep], ci[keep]
        if not len(qi):
            return
        score = _exact(self.x, x, qi, ci)
        keep = score >= floor[qi]
        qi, ci, score = qi[keep], ci[keep], score[keep]
        for q in np.unique(qi):
            a, b = np.searchsorted(qi, [q, q + 1])
            self._merge(q, score[a:b], ids[ci[a:b]])

    def _merge(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        if self.best.shape[1] < self.k:
            pad = self.k - self.best.shape[1]
            self.best = np.hstack([self.best, np.full((len(self.x), pad), np.iinfo(np.int64).min)])
            self.best_id = np.hstack([self.best_id, np.full((len(self.x), pad), -1)])
            self.held = np.zeros(len(self.x), np.int64)
        n = self.held[q]
        score, ids = np.concatenate([self.best[q, :n], score]), np.concatenate([self.best_id[q, :n], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.held[q] = len(order)
        self.best[q, : len(order)], self.best_id[q, : len(order)] = score[order], ids[order]

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if self.best.shape[1]:
            for q in range(len(self.x)):
                yield q, self.best_id[q, : self.held[q]], self.best[q, : self.held[q]]


def top_k(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """For every row where `is_query` holds, its k best other rows: query_id, rank (from 1), vec_id, score.

    Queries go out in blocks of at most about `block` rows, so what each candidate task holds and what the driver gathers
    is bounded; every block scans the candidates once and each task returns at most k + 1 rows a query.
    """
    spark = df.sparkSession
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    asked = base.filter(is_query)
    total = asked.count()
    schema = "query long, query_id long, self long, vec_id long, score long"
    blocks = max(1, -(-total // block))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        table = part.toArrow()
        found = written(_search(base, _rows(table["vec_id"], table["v"]), b, k, schema), "topk")
        out = found if out is None else out.unionByName(found)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    near = out.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k + 1)
    own = F.row_number().over(Window.partitionBy("query", "own").orderBy("place"))
    near = near.withColumn("own", F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("self")))
    near = near.withColumn("nth", own).filter(~(F.col("own") & (F.col("nth") == 1)))
    near = near.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return near.select("query_id", "rank", "vec_id", "score")


def _search(base: DataFrame, queries: dict, number: int, k: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {d: Search(ids, x, k + 1) for d, (ids, x) in queries.items()}
        for batch in batches:
            for d, (ids, x) in _rows(batch.column(0), batch.column(1)).items():
                if d in searches:
                    searches[d].add(ids, x)
        for nth, s in enumerate(searches.values()):
            own = _exact(s.x, s.x, np.arange(len(s.x)), np.arange(len(s.x)))
            cols: list[list] = [[], [], [], [], []]
            for q, ids, score in s.rows():
                n = len(ids)
                for col, value in zip(cols, (np.full(n, (number << 40) + (nth << 20) + q), np.full(n, s.ids[q]), np.full(n, own[q]), ids, score), strict=True):
                    col.append(value)
            if cols[0]:
                arrays = [np.concatenate(c) for c in cols]
                yield pa.record_batch([pa.array(a, pa.int64(), mask=(a == _NULL) if i in (1, 3) else None) for i, a in enumerate(arrays)], names=["query", "query_id", "self", "vec_id", "score"])

    return base.mapInArrow(tidy(run), schema)
