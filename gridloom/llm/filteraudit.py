"""Operator 13: interactions of five document filters, audited over all 120 orders at once.

A document's five failure flags make a number from 0 to 31. One table of 32 x 120 entries says at which step of which order a
document with these flags fails first, so a document is judged once and never replayed: each task looks its documents up in
the table, np.bincount accumulates removals by part, order, step and label, and Spark sums the tasks' partial arrays.

Filters (a letter's bit is its place in `ABCDE`): A under 50 words, B under 65 distinct words in a hundred, C more than 5
capitals A-Z in a hundred characters, D any of `#$%&*|`, E identical to the text of a smaller id. Texts are told apart by a
128-bit hash; the smallest id of each text is found by one aggregate and joined on (text, id), so no group of copies ever
meets in one task. Partial arrays hold at most PARTS parts at a time.

Defined cases: a null text is empty; a null part is the empty string; a null id is neither smaller than another nor has one
that is smaller, and has no label; of several labels of an id any 1 counts; rows that repeat (equal id and text) are counted
each, and none of them is a copy of the other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.kernel import bounded_batches, slices, tidy, utf8
from gridloom.session import written

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
#: Parts whose partial arrays a task holds at a time (600 entries a part and figure).
PARTS = 512
#: Bytes of a text whose words are split at a time.
PIECE = 1 << 20
FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def first_failures() -> np.ndarray:
    """The step (0 to 4; 5: none) at which flags (row) fail first in an order (column)."""
    place = np.array([[order.index(x) for x in LETTERS] for order in ORDERS])
    failed = (np.arange(32)[:, None] >> np.arange(5)) & 1
    return np.where(failed[:, None, :] == 1, place[None], 5).min(axis=2)


def word_figures(text: bytes, piece: int = PIECE) -> tuple[int, int]:
    """Words (runs of bytes other than ASCII white space) and distinct ones; long texts in pieces that end between words."""
    if len(text) <= piece:
        words = text.split()
        return len(words), len(set(words))
    total, seen, at = 0, set(), 0
    while at < len(text):
        end = at + piece
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = text[at:end].split()
        total, at = total + len(words), end
        seen.update(words)
    return total, len(seen)


def text_flags(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Flags A to D of each text, and its 128-bit hash."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    out, keys = np.zeros(n, np.int32), []
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    view = memoryview(data)
    for lo, hi in slices(offsets, 1 << 21):
        b, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]

        def count(hit: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(hit)))[at])

        out[lo:hi] |= (100 * count((b >= 65) & (b <= 90)) > MOST_CAPITALS * count((b & 0xC0) != 0x80)) << 2
        out[lo:hi] |= (count(symbol[b]) > 0) << 3
    for i in range(n):
        text = bytes(view[offsets[i] : offsets[i + 1]])
        words, distinct = word_figures(text)
        out[i] |= (words < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * words) << 1
        keys.append(hashlib.blake2b(text, digest_size=16).digest())
    return out, keys


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags, keys = text_flags(batch.column(2))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(flags)], names=["id", "part", "key", "flags"])


def partial_sums(part: np.ndarray, flags: np.ndarray, good: np.ndarray, toxic: np.ndarray, parts: int, first: np.ndarray) -> dict[str, np.ndarray]:
    """Each figure as an array of (part, order, step) over these documents."""
    # documents of a part with equal flags and labels share their fate: each such class is looked up once and weighted
    kind, n = np.unique(((part * 32 + flags) * 2 + good) * 2 + toxic, return_counts=True)
    toxic, good, flags, part = kind & 1, (kind >> 1) & 1, (kind >> 2) & 31, kind >> 7
    orders = np.arange(len(ORDERS))
    step = first[flags]
    slot = (part[:, None] * len(ORDERS) + orders) * 6 + step

    def removals(weight: np.ndarray) -> np.ndarray:
        flat = np.bincount(slot.ravel(), np.broadcast_to(weight[:, None], slot.shape).ravel(), parts * len(ORDERS) * 6)
        return flat.reshape(parts, len(ORDERS), 6).astype(np.int64)

    fate = removals(n)
    removed = fate[:, :, :5]
    letters = np.array([[LETTERS.index(x) for x in order] for order in ORDERS])
    by_flags = np.bincount(part * 32 + flags, n, parts * 32).reshape(parts, 32).astype(np.int64)
    bit = (np.arange(32)[:, None] >> np.arange(5)) & 1
    failing, alone = by_flags @ bit, by_flags[:, 1 << np.arange(5)]
    shapley = np.zeros((parts, 5), np.int64)
    np.add.at(shapley.T, letters.ravel(), removed.reshape(parts, -1).T)
    return {
        "kept": fate.sum(axis=2)[:, :, None] - np.cumsum(removed, axis=2),
        "removed": removed,
        "redundant": failing[:, letters] - removed,
        "unique_fails": alone[:, letters],
        "good_lost": removals(n * good)[:, :, :5],
        "toxic_lost": removals(n * toxic)[:, :, :5],
        "shapley": shapley[:, letters],
    }


def _audit(batches: Iterator[pa.RecordBatch], parts: int = PARTS) -> Iterator[pa.RecordBatch]:
    first = first_failures()
    names: dict[str, int] = {}
    sums: dict[str, np.ndarray] = {}

    def arrays() -> pa.RecordBatch:
        flat = [pa.array(sums[f].ravel()) for f in FIGURES]
        per = len(ORDERS) * 5
        part = pa.array(list(names), pa.string()).take(pa.array(np.repeat(np.arange(len(names)), per)))
        place = np.tile(np.arange(per), len(names))
        return pa.record_batch([part, pa.array((place // 5).astype(np.int32)), pa.array((place % 5 + 1).astype(np.int32)), *flat], names=["part", "nth", "step", *FIGURES])

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        own, inverse = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        flags, good, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
        for at in range(0, len(own), parts):
            some = own[at : at + parts]
            if sums and len(names.keys() | set(some)) > parts:
                yield arrays()
                names, sums = {}, {}
            for x in some:
                names.setdefault(x, len(names))
            for f in sums:
                sums[f] = np.concatenate([sums[f], np.zeros((len(names) - len(sums[f]), *sums[f].shape[1:]), np.int64)])
            here = np.flatnonzero((inverse >= at) & (inverse < at + parts))
            part = np.array([names[x] for x in some], np.int64)[inverse[here] - at]
            for f, x in partial_sums(part, flags[here], good[here], toxic[here], len(names), first).items():
                sums[f] = sums[f] + x if f in sums else x
    if sums:
        yield arrays()


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", label_id: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", parts: int = PARTS) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    bounded_batches(df.sparkSession)
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = written(base.mapInArrow(tidy(_flag), "id long, part string, key binary, flags int"), "filter-flags")
    smallest = rows.groupBy("key").agg(F.min("id").alias("id")).filter("id is not null").withColumn("own", F.lit(True))
    marks = labels.select(F.col(f"`{label_id}`").cast("long").alias("id"), (F.col(f"`{quality_col}`") == 1).alias("good"), (F.col(f"`{toxic_col}`") == 1).alias("toxic"))
    marks = marks.filter("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    copy = F.col("id").isNotNull() & F.col("own").isNull()
    flagged = rows.join(smallest, ["key", "id"], "left").select("id", "part", (F.col("flags") + F.when(copy, 16).otherwise(0)).alias("flags"))
    judged = flagged.join(marks, "id", "left").select("part", "flags", *(F.coalesce(F.col(x).cast("int"), F.lit(0)).alias(x) for x in ("good", "toxic")))
    sums = judged.mapInArrow(partial(_audit, parts=parts), "part string, nth int, step int, " + ", ".join(f"{f} long" for f in FIGURES))
    orders = F.array(*(F.lit(x) for x in ORDERS))
    summed = sums.groupBy("part", "nth", "step").agg(*(F.sum(f).alias(f) for f in FIGURES))
    return summed.select("part", orders[F.col("nth")].alias("filter_order"), "step", *FIGURES)
