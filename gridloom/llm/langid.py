"""Operator 5: language identification with string kernels.

The kernel of two texts is the number of distinct 1-, 2- and 3-grams (bytes, ASCII folded, marks and digits as one symbol)
that both hold, divided by the root of their own numbers: a blended-spectrum presence kernel. Landmark texts give the
Nyström map phi(x) = K(x, L) K(L, L)^(-1/2); a one-versus-rest kernel ridge regression is fitted on phi. As the kernel with
each landmark is a sum over grams, the landmarks and weights fold into one matrix of (grams x languages): a batch of texts is
scored by one product of its presence matrix with it. Grams are those that the landmarks hold; of more than `most_grams`
(30,000) each language in turn gives the one that most of its own landmarks hold.

The model learns from at most `per_language` texts of each language (and `max_rows` in all): first texts of at most
`max_bytes`, chosen by a hash of the ids, then the shortest of the longer ones. All languages get the same part of `TOTAL`
bytes, and the first text of each is learned whatever its length; every whole text is scored.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text if nothing can be learned; with
one learned language every other text is that language; null languages are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.kernel import bounded_batches, slices, tidy, utf8

PER_LANGUAGE, MAX_ROWS, MAX_BYTES, LANDMARKS, MAX_GRAMS = 300, 6000, 20_000, 40, 30_000
#: Bytes of all texts that are learned from.
TOTAL = 64 << 20
#: Symbols: marks and digits (0), folded letters (1-26), bytes from 128 on (27-154).
SYMBOLS = 155


def _symbols() -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[97:123] = out[65:91] = np.arange(1, 27)
    out[128:] = np.arange(27, 155)
    return out


_SYMBOL = _symbols()
_BASES = (0, SYMBOLS, SYMBOLS + SYMBOLS**2)
CODES = SYMBOLS + SYMBOLS**2 + SYMBOLS**3


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, rows) of all 1-, 2- and 3-grams within rows."""
    s = _SYMBOL[data]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    yield s, row
    pair = s[:-1] * SYMBOLS + s[1:]
    same = row[:-1] == row[1:]
    yield _BASES[1] + pair[same], row[:-1][same]
    triple = pair[:-1] * SYMBOLS + s[2:]
    same = row[:-2] == row[2:]
    yield _BASES[2] + triple[same], row[:-2][same]


def _presence(data: np.ndarray, offsets: np.ndarray, index: np.ndarray, grams: int) -> np.ndarray:
    """Presence matrix (rows x grams) as float32; index: code -> column, or `grams` for none."""
    flags = np.zeros((len(offsets) - 1, grams + 1), bool)
    if len(data):
        for code, row in _grams(data, offsets):
            flags.reshape(-1)[row.astype(np.int64) * (grams + 1) + index[code]] = True
    return flags[:, :grams].astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # (grams, languages)
    bias: np.ndarray

    def index(self) -> np.ndarray:
        out = np.full(CODES, len(self.codes), np.uint16)
        out[self.codes] = np.arange(len(self.codes))
        return out

    def scores(self, present: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(present.sum(axis=1), 1))[:, None]
        return (present @ self.weights) / norm + self.bias


def _landmark_grams(texts: list[str], languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, how many texts hold each, and its best place in any language's order of what most of its texts hold."""
    own = {}
    for n in sorted(set(languages)):
        held = [np.zeros(0, np.int64)]
        for x in (x for x, y in zip(texts, languages, strict=True) if y == n):
            held.append(np.unique(np.concatenate([np.unique(code) for code, _ in _grams(*utf8(pa.array([x], pa.string())))])))
        own[n] = np.unique(np.concatenate(held), return_counts=True)
    codes = np.unique(np.concatenate([c for c, _ in own.values()]))
    row_counts, best = np.zeros(len(codes), np.int64), np.full(len(codes), len(codes))
    for c, k in own.values():
        at = np.searchsorted(codes, c)
        row_counts[at] += k
        place = np.empty(len(c), np.int64)
        place[np.argsort(-k, kind="stable")] = np.arange(len(c))
        best[at] = np.minimum(best[at], place)
    return codes, row_counts, best


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = 0.01, most_grams: int = MAX_GRAMS) -> Model | None:
    names = sorted(set(languages))
    if not names:
        return None
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in languages])
    chosen: list[int] = []
    for n in names:
        chosen += [i for i, x in enumerate(languages) if x == n][:landmarks]
    codes, row_counts, best = _landmark_grams([texts[i] for i in chosen], [languages[i] for i in chosen])
    if len(codes) > most_grams:
        codes = np.sort(codes[np.lexsort((codes, -row_counts, best))[:most_grams]])
    model = Model(names, codes, np.zeros((len(codes), len(names)), np.float32), np.zeros(len(names)))
    index = model.index()

    def rows(some: list[str]) -> np.ndarray:
        d, o = utf8(pa.array(some, pa.string()))
        return np.vstack([_presence(d[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], index, len(codes)) for lo, hi in slices(o, 1 << 18)])

    mark = rows([texts[i] for i in chosen])
    mark /= np.sqrt(np.maximum(mark.sum(axis=1), 1))[:, None]
    values, vectors = np.linalg.eigh(mark.astype(np.float64) @ mark.T)
    keep = values > 1e-6 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])
    kernel = np.zeros((len(texts), len(chosen)))
    for lo in range(0, len(texts), 256):
        x = rows(texts[lo : lo + 256])
        kernel[lo : lo + 256] = (x @ mark.T) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    phi = np.hstack([kernel @ half, np.ones((len(texts), 1))])
    # every language weighs the same, however many texts it has
    weight = np.zeros(len(texts))
    for j in range(len(names)):
        weight[y[:, j] > 0] = 1 / (len(names) * (y[:, j] > 0).sum())
    gram = phi.T @ (phi * weight[:, None]) + ridge / len(names) * np.diag([*np.ones(phi.shape[1] - 1), 0.0]) * 0.1
    beta = np.linalg.lstsq(gram, phi.T @ (y * weight[:, None]), rcond=None)[0]
    model.weights = (mark.T @ (half @ beta[:-1])).astype(np.float32)
    model.bias = beta[-1]
    return model


def held_out(id_col: Column) -> Column:
    """Documents never learned from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model | None:
    """Fit on a bounded sample: the driver holds at most max_rows texts, TOTAL bytes in all but for a long text of each language."""
    order = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    # a null id can be told apart from no other, so it is not learned from
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") > 0))
    key = ["doc_id", "lang", "bytes", "hash"]
    usable = usable.filter(F.col("text").rlike(r"\p{L}")).withColumns({"bytes": F.octet_length("text"), "hash": F.xxhash64("text")})
    long = F.when(F.col("bytes") > max_bytes, F.col("bytes")).otherwise(0)
    ranked = usable.select(*key).distinct().withColumn("part", F.pmod(F.xxhash64(*order, "hash"), F.lit(8)))
    # the first of eight parts of a language, then of these: no task gets all rows of a language
    for by in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(long, *order, "bytes", "hash"))).filter(F.col("n") <= per_language)
    ids = ranked.orderBy("n", *order, "lang").limit(max_rows).select(*key, "n").collect()
    spent, chosen = dict.fromkeys((r["lang"] for r in ids), 0), []
    for r in ids:
        if r["n"] == 1 or spent[r["lang"]] + r["bytes"] <= TOTAL // len(spent):
            spent[r["lang"]] += r["bytes"]
            chosen.append(tuple(r)[:4])
    if not chosen:
        return None
    picked = docs.sparkSession.createDataFrame(chosen, usable.select(*key).schema)
    table = usable.join(F.broadcast(picked), key).groupBy(*key).agg(F.min("text").alias("text")).orderBy(*order, "text").toArrow()
    return fit(table["text"].to_pylist(), table["lang"].to_pylist())


def identify(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    model = train(docs, **options)
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.index() if model else None
        for batch in batches:
            n = batch.num_rows
            langs, score = np.full(n, "und", object), np.zeros(n)
            if model and n:
                data, offsets = utf8(batch.column(1))
                for lo, hi in slices(offsets, 1 << 17):
                    z = 4 * model.scores(_presence(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], index, len(model.codes)))
                    p = np.exp(z - z.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    langs[lo:hi] = np.array(model.languages, object)[p.argmax(axis=1)]
                    score[lo:hi] = p.max(axis=1)
                none = ~np.asarray(batch.column(2))
                langs[none], score[none] = "und", 0.0
            yield pa.record_batch([batch.column(0), pa.array(langs.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    out = base.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
