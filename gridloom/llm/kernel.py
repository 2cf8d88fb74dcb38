"""Vectorised text kernels over Arrow buffers, shared by the Arrow-style operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Word: a longest run of digits, ASCII letters and non-ASCII characters; A-Z count as a-z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same class after A-Z have been lower-cased.
WORD_LOWER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_M = (1 << 64) - 1


def splitmix(x: np.ndarray | int) -> np.ndarray:
    """The splitmix64 finaliser, elementwise modulo 2**64."""
    z = np.atleast_1d(np.asarray(x, np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _is_word() -> np.ndarray:
    b = np.arange(256)
    return (b >= 128) | ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))


IS_WORD = _is_word()
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1000))[_FOLD]
#: A random value for each of the first places and each byte.
_PLACES = 64
_TABLE = splitmix(_BYTE[None, :] ^ splitmix(np.arange(_PLACES, dtype=np.uint64) << np.uint64(20))[:, None]).reshape(-1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column without copying; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def spans_hash(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that lie one after another (none empty), A-Z as a-z.

    The sum of a random value for each pair of a place and a byte: nothing that the spans' structure could cancel.
    """
    firsts = np.cumsum(lengths) - lengths
    if not len(lengths):
        return np.zeros(0, np.uint64)
    position = np.arange(len(flat), dtype=np.int64) - np.repeat(firsts, lengths)
    if int(lengths.max()) <= _PLACES:
        values = _TABLE[(position << 8) + flat]
    else:
        values = _TABLE[(np.minimum(position, _PLACES - 1) << 8) + flat]
        far = np.flatnonzero(position >= _PLACES)
        values[far] = splitmix(_BYTE[flat[far]] ^ splitmix(position[far].astype(np.uint64) << np.uint64(20)))
    return splitmix(np.add.reduceat(values, firsts) ^ lengths.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each row's word count."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(offsets) - 1, np.int64)
    for lo, hi in slices(offsets, most):
        b, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if not len(b):
            continue
        is_word = IS_WORD[b]
        before, after = np.zeros(len(b), bool), np.zeros(len(b), bool)
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        before[at[:-1][at[:-1] < len(b)]] = False
        after[at[1:][at[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
        if not len(starts):
            continue
        hashes.append(spans_hash(b[is_word], ends - starts))
        counts[lo:hi] += np.diff(np.searchsorted(starts, at))
    return np.concatenate(hashes), counts


def windows(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words within rows (a shorter, non-empty row is one window), their rows and word starts."""
    ends = np.cumsum(counts)
    firsts = ends - counts
    per_row = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    total = int(per_row.sum())
    row = np.repeat(np.arange(len(counts)), per_row)
    start = firsts[row] + (np.arange(total) - np.repeat(np.cumsum(per_row) - per_row, per_row))
    length = np.minimum(counts, width)[row]
    out = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        live = length > k
        if live.all():
            out = splitmix(out ^ words[start + k])
        else:
            out[live] = splitmix(out[live] ^ words[start[live] + k])
    return out, row, start


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and their heaps would otherwise stay at their peaks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with its task's memory given back at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def free_name(name: str, taken: list[str]) -> str:
    """A column name like `name` that no column of `taken` has, whatever the case."""
    used = {c.lower() for c in taken}
    out = f"_{name}"
    while out.lower() in used:
        out = f"_{out}"
    return out


def position(name: str, columns: list[str]) -> int:
    """Where a column stands, found as Spark finds names: whatever the case."""
    if name in columns:
        return columns.index(name)
    return [c.lower() for c in columns].index(name.lower())


def row_key(id_col: str, text_col: str) -> Column:
    """16 bytes that tell rows apart by id and whole text; rows equal in both share them."""
    text, key = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(key, F.lit("null")), F.when(text.isNull(), F.lit("-")).otherwise(F.lit(":")), F.coalesce(text, F.lit("")))))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small; a setting that the user lowered further stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
