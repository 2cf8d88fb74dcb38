"""Operator 6: quality classifier as a sparse rule ensemble.

Each text gives a row of statistics. Small boosted regression trees are grown on labelled rows; every path from a root to a
node is a conjunctive rule over the statistics. A lasso logistic regression over the rules leaves few of them with weights,
and those are compiled into Spark column expressions over the statistics: the score is their logistic sum.

Statistics are taken of whole texts over Arrow buffers (one pass over the bytes). The model learns from at most
`max_rows` labelled rows, chosen by a hash of their ids.

Defined cases: null and empty texts have all statistics 0 and get a score too; null labels are ignored; a row that is
labelled twice counts twice; one class only, or no labels, gives the constant rate (0.5 without labels); statistics live in
columns whose names begin with `__q_`, or with more underscores where the table has such columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.kernel import IS_WORD, bounded_batches, free_name, position, slices, splitmix, tidy, utf8, word_hashes

STATISTICS = ("bytes", "words", "word_length", "upper", "digit", "space", "comma", "stop", "bang", "pipe", "symbol", "other", "high", "lines", "line_length", "line_repeats", "distinct", "stutter")
PREFIX = "__q_"
MAX_ROWS, THRESHOLD = 12_000, 0.3

_KINDS = 10


def _classes() -> np.ndarray:
    out = np.full(256, 8, np.uint8)  # other marks
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[[9, 10, 11, 12, 13, 32]] = 3
    out[ord(",")], out[ord(".")], out[ord("!")], out[ord("|")] = 4, 5, 6, 7
    out[128:] = 9
    return out


_CLASS = _classes()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#$%&*<>=@^_{}[]~\\/+", np.uint8)] = True


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text; shares are of the text's bytes, words or lines."""
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for lo, hi in slices(offsets, 1 << 20):
        b, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        rows, size = hi - lo, np.diff(at)
        row = np.repeat(np.arange(rows, dtype=np.int64), size)
        kinds = np.bincount(row * _KINDS + _CLASS[b], minlength=rows * _KINDS).reshape(rows, _KINDS).astype(float)
        symbols = np.bincount(row[_SYMBOL[b]], minlength=rows)
        hashes, words = word_hashes(b, at)
        word_bytes = np.bincount(row[IS_WORD[b]], minlength=rows)
        distinct = np.bincount(np.unique((hashes & np.uint64((1 << 40) - 1)) | (np.repeat(np.arange(rows, dtype=np.uint64), words) << np.uint64(40))) >> np.uint64(40), minlength=rows) if len(hashes) else np.zeros(rows)
        lines, repeats = _lines(b, at)
        word_row = np.repeat(np.arange(rows), words)
        stutter = np.bincount(word_row[1:][(hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])], minlength=rows)
        some = np.maximum(size, 1)
        out[lo:hi] = np.column_stack([size, words, word_bytes / np.maximum(words, 1), kinds[:, 1] / some, kinds[:, 2] / some, kinds[:, 3] / some, kinds[:, 4] / some, kinds[:, 5] / some, kinds[:, 6] / some, kinds[:, 7] / some, symbols / some, kinds[:, 8] / some, kinds[:, 9] / some, lines, size / np.maximum(lines, 1), repeats / np.maximum(lines, 1), distinct / np.maximum(words, 1), stutter / np.maximum(words, 1)])
    return out


def _lines(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each row that are not empty, and how many of them repeat an earlier line of the row."""
    rows = len(at) - 1
    if not len(b):
        return np.zeros(rows), np.zeros(rows)
    starts = np.unique(np.concatenate((at[:-1][np.diff(at) > 0], np.flatnonzero(b[:-1] == 10) + 1)))
    lengths = np.diff(np.append(starts, len(b)))
    position = (np.arange(len(b)) - np.repeat(starts, lengths)).astype(np.uint64)
    h = np.add.reduceat(splitmix(position * np.uint64(256) + b) * (b != 10), starts)
    keep = h != 0
    row = np.searchsorted(at, starts[keep], "right") - 1
    n = np.bincount(row, minlength=rows)
    order = np.lexsort((h[keep], row))
    same = (np.diff(row[order]) == 0) & (np.diff(h[keep][order]) == 0)
    return n.astype(float), np.bincount(row[order][1:][same], minlength=rows).astype(float)


@dataclass
class Rule:
    """A conjunction of (statistic, above, threshold); above: value > threshold, else value <= threshold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, t in self.terms:
            out &= (x[:, j] > t) if above else (x[:, j] <= t)
        return out

    def column(self, prefix: str = PREFIX) -> Column:
        out = F.lit(True)
        for j, above, t in self.terms:
            c = F.col(prefix + STATISTICS[j])
            out = out & ((c > F.lit(t)) if above else (c <= F.lit(t)))
        return out


@dataclass
class RuleModel:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str = PREFIX) -> Column:
        """The score as one Spark expression over the statistics' columns."""
        z = F.lit(float(self.bias))
        for rule, weight in self.rules:
            z = z + F.when(rule.column(prefix), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x: np.ndarray, r: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, depth: int, least: int, chosen: np.ndarray, terms: tuple, rules: list[Rule], fit: np.ndarray, rate: float) -> None:
    fit[rows] += rate * r[rows].mean()
    if depth == 0 or len(rows) < 2 * least:
        return
    best, gain0 = None, r[rows].sum() ** 2 / len(rows) + 1e-9
    for j in chosen:
        n = np.bincount(binned[rows, j], minlength=len(cuts[j]) + 1).cumsum()[:-1]
        s = np.bincount(binned[rows, j], r[rows], minlength=len(cuts[j]) + 1).cumsum()[:-1]
        ok = (n >= least) & (len(rows) - n >= least)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (r[rows].sum() - s) ** 2 / np.maximum(len(rows) - n, 1), -np.inf)
            k = int(gain.argmax())
            if gain[k] > gain0 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k)
    if best is None:
        return
    _, j, k = best
    left = binned[rows, j] <= k
    fit[rows] -= rate * r[rows].mean()
    for above, part in ((False, rows[left]), (True, rows[~left])):
        now = (*terms, (int(j), above, float(cuts[j][k])))
        rules.append(Rule(now))
        _tree(x, r, part, cuts, binned, depth - 1, least, chosen, now, rules, fit, rate)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, penalty: float = 0.002, turns: int = 400, seed: int = 11) -> RuleModel:
    """Boosted trees to rules, then lasso logistic weights by accelerated proximal gradient steps."""
    if not len(y):
        return RuleModel()
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = math.log(rate / (1 - rate))
    if y.min() == y.max():
        return RuleModel(base)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    rules, z, least = [], np.full(len(y), base), max(5, len(y) // 500)
    for _ in range(trees):
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        if len(rows) < 2 * least:
            rows = np.arange(len(y))
        p = 1 / (1 + np.exp(-z))
        grad, step = y - p, np.zeros(len(y))
        grown: list[Rule] = []
        chosen = rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)]
        _tree(x, grad, rows, cuts, binned, depth, least, chosen, (), grown, step, 1.0)
        rules += grown
        z = z + 0.8 * step
    unique, columns, seen = [], [], set()
    for rule in rules:
        held = rule.holds(x)
        key = held.tobytes()
        if key not in seen and 0 < held.sum() < len(y):
            seen.add(key)
            unique.append(rule)
            columns.append(held)
    if not unique:
        return RuleModel(base)
    a = np.column_stack(columns).astype(np.float32)
    spread = a.std(axis=0)
    a /= spread
    w, b, v, c, t = np.zeros(a.shape[1], np.float32), base, np.zeros(a.shape[1], np.float32), base, 1.0
    big = 0.25 * float(np.linalg.norm(a, 2) ** 2) / len(y) + 0.25
    for _ in range(turns):
        g = (1 / (1 + np.exp(-(a @ v + c))) - y).astype(np.float32)
        new = v - (a.T @ g) / len(y) / big
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / big, 0)
        nb = c - float(g.mean()) / big
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    live = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b), [(unique[i], float(w[i] / spread[i])) for i in live])


def free_prefix(columns: list[str]) -> str:
    """PREFIX, or a longer one that no column begins with."""
    prefix = PREFIX
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def with_statistics(df: DataFrame, text_col: str = "text", prefix: str = PREFIX) -> DataFrame:
    """df with one double column per statistic."""
    bounded_batches(df.sparkSession)
    at = position(text_col, df.columns)
    names = [prefix + s for s in STATISTICS]
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x[:, j]) for j in range(len(names)))], names=[*batch.schema.names, *names])

    return df.mapInArrow(tidy(run), schema)


def held_out(id_col: Column) -> Column:
    """Documents whose labels are never learned from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> RuleModel:
    """Learn from at most max_rows labelled rows (each some 200 bytes on the driver) that are not held out."""
    known = labels.select(F.col(id_col).cast("long").alias("__q_id"), F.col(label_col).cast("int").alias("__q_label"))
    known = known.filter(F.col("__q_label").isin(0, 1) & ~held_out(F.col("__q_id"))).orderBy(F.xxhash64("__q_id", F.lit(5)), "__q_id", "__q_label").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__q_doc"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(known), F.col("__q_doc") == F.col("__q_id")).select("__q_id", "__q_label", "text")
    table = with_statistics(joined).drop("text").orderBy(F.xxhash64("__q_id", F.lit(5)), "__q_id", "__q_label", *(PREFIX + s for s in STATISTICS)).limit(max_rows).toArrow()
    x = np.column_stack([table[PREFIX + s].to_numpy() for s in STATISTICS]) if table.num_rows else np.zeros((0, len(STATISTICS)))
    return fit_rules(x, table["__q_label"].to_numpy().astype(float) if table.num_rows else np.zeros(0))


def scored(docs: DataFrame, model: RuleModel, name: str = "score") -> DataFrame:
    """docs with the score column; the statistics are dropped again."""
    prefix = free_prefix(docs.columns)
    out = with_statistics(docs, prefix=prefix).withColumn(name, model.column(prefix))
    return out.drop(*(prefix + s for s in STATISTICS))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, max_rows=max_rows)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(base, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs without the rows that the classifier rejects; columns stay as they are."""
    name = free_name("score", docs.columns)
    return scored(docs, train(docs, labels, max_rows=max_rows), name).filter(F.col(name) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
