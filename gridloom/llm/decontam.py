"""Operator 2: benchmark decontamination with suffix arrays of the training text.

Each task gathers documents into shards of about half a million words and builds the shard's suffix array over words by prefix
multiplication: suffixes are sorted by their first d words, the ranks of several such prefixes are packed into one 64-bit
key, and sorting the keys gives the order by the first 2d, 3d ... words, until the order is as deep as a window. Every test
suffix that starts a window is then binary-searched; its range in the suffix array holds all its places. Places that no longer
place precedes are extended word by word to the longest verbatim matches: matches() returns them all, contamination() counts the
words that they hit and names the longest, decontaminate() removes the documents that have one.

A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window. Words are compared
by 64-bit hashes. Benchmark words go out in blocks of bounded size, some blocks at a time, for which a shard's suffix array is
built once; beyond that the texts are read again, and only hits are shuffled and united, so nothing grows with the benchmark
but the number of passes.

Defined cases: null texts have no words; items without words match nothing; a null item id is written `null`; rows that
repeat are judged alike; with an empty benchmark no document is hit; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.kernel import bounded_batches, position, row_key, tidy, utf8, word_hashes

WIDTH = 10
#: Words of a shard, and of the benchmark items that go out at once (8 bytes a word).
SHARD_WORDS, BLOCK_WORDS = 1 << 19, 1 << 19
#: Pairs of a text place and an item place that are looked at together; benchmark blocks that go out together.
PAIRS, TOGETHER = 1 << 20, 8


@dataclass
class Windows:
    """Distinct windows of some items: words (flat), starts, lengths, and the items of each (flat, by ends)."""

    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    item_ends: np.ndarray
    items: np.ndarray
    names: list[str]


def item_windows(names: list[str], texts: pa.Array, width: int = WIDTH) -> Windows:
    words, counts = word_hashes(*utf8(texts))
    ends = np.cumsum(counts)
    seen: dict[bytes, int] = {}
    starts, lengths, items = [], [], []
    for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        m = min(n, width)
        for s in range(end - n, end - m + 1) if m else ():
            key = words[s : s + m].tobytes()
            w = seen.setdefault(key, len(seen))
            if w == len(starts):
                starts.append(s)
                lengths.append(m)
                items.append({i})
            else:
                items[w].add(i)
    flat = np.array([i for x in items for i in sorted(x)], np.int64)
    return Windows(words, np.array(starts, np.int64), np.array(lengths, np.int64), np.cumsum([len(x) for x in items]).astype(np.int64), flat, names)


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ranks (0: end of a document) in the order of at least their first `depth` ranks."""
    n, d = len(ranks), 1
    order = None
    while order is None or d < depth:
        bits = max(1, int(ranks.max(initial=0)).bit_length())
        per = max(2, min(63 // bits, -(-depth // d)))
        key = np.zeros(n, np.int64)
        for j in range(per):
            key <<= bits
            if j * d < n:
                key[: n - j * d] |= ranks[j * d :]
        order = np.argsort(key)
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) + 1
        ranks, d = new, d * per
    return order


def _compare(text: np.ndarray, at: np.ndarray, query: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: the suffixes' first `lengths` ranks against the queries'."""
    out = np.zeros(len(at), np.int8)
    open_ = np.arange(len(at))
    k = 0
    while len(open_):
        open_ = open_[lengths[open_] > k]
        there = at[open_] + k
        a = np.where(there < len(text), text[np.minimum(there, len(text) - 1)], 0)
        b = query[starts[open_] + k]
        out[open_] = np.sign(a - b)
        open_ = open_[a == b]
        k += 1
    return out


class Shard:
    """Documents' words one after another, and, once a window may stand in them, their suffix array, which serves all blocks."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> None:
        self.words, self.counts, self.ends, self.width = words, counts, np.cumsum(counts), width
        self.order: np.ndarray | None = None

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words, and the words' ranks with an end after each document (even; 0 at ends)."""
        if self.order is None:
            self.distinct, inverse = np.unique(self.words, return_inverse=True)
            self.text = np.zeros(len(self.words) + len(self.counts), np.int64)
            self.text[np.arange(len(self.words)) + np.repeat(np.arange(len(self.counts)), self.counts)] = 2 * inverse + 2
        return self.distinct, self.text

    def suffixes(self) -> np.ndarray:
        if self.order is None:
            self.order = suffix_array(self.text >> 1, self.width)
        return self.order


def find_windows(shard: Shard, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places of all windows in a shard: word positions (documents one after another), their documents, and windows."""
    none = np.zeros(0, np.int64)
    if not len(shard.words) or not len(w.starts):
        return none, none, none
    distinct, text = shard.ranks()
    slot = np.searchsorted(distinct, w.words)
    known = (slot < len(distinct)) & (distinct[np.minimum(slot, len(distinct) - 1)] == w.words)
    query = np.where(known, 2 * slot + 2, 2 * slot + 1)
    # a window with a word that the shard lacks has no place in it
    lacking = np.concatenate(([0], np.cumsum(~known)))
    live = np.flatnonzero(lacking[w.starts + w.lengths] == lacking[w.starts])
    if not len(live):
        return none, none, none
    order = shard.suffixes()
    starts, lengths = w.starts[live], w.lengths[live]

    def bound(side: int) -> np.ndarray:
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(order))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            less = _compare(text, order[np.minimum(mid, len(order) - 1)], query, starts, lengths) < side
            lo, hi = np.where((lo < hi) & less, mid + 1, lo), np.where((lo < hi) & ~less, mid, hi)
        return lo

    first, last = bound(0), bound(1)
    n = last - first
    at = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    doc = np.searchsorted(shard.ends + np.arange(len(shard.counts)) + 1, at, "right")
    return at - doc, doc, np.repeat(live, n)


@dataclass
class Block:
    """Some items: their windows, and every place of each window in them (see _window_places)."""

    windows: Windows
    places: tuple[np.ndarray, ...]


def block_of(names: list[str], texts: pa.Array, width: int = WIDTH) -> Block:
    w = item_windows(names, texts, width)
    return Block(w, _window_places(w, texts, width))


def judge(shard: Shard, block: Block, pairs: int = PAIRS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the documents that hold a match: their matches' items, starts, starts in the items and lengths in words."""
    found = [x for x in _spans(shard, block.windows, block.places, pairs) if len(x[0])]
    if not found:
        return
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield int(columns[0][a]), *(c[a:b] for c in columns[1:])


def _window_places(w: Windows, texts: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """Every place of every window in the items: places in w.words, their items' numbers, starts and ends (all by `ends`)."""
    _, counts = word_hashes(*utf8(texts))
    number = {w.words[s : s + m].tobytes(): k for k, (s, m) in enumerate(zip(w.starts.tolist(), w.lengths.tolist(), strict=True))}
    found = []
    for i, (end, n) in enumerate(zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)):
        m = min(n, width)
        found += [(number[w.words[s : s + m].tobytes()], s, i, end - n, end) for s in range(end - n, end - m + 1) if m]
    flat = np.array(sorted(found), np.int64).reshape(-1, 5)
    return np.searchsorted(flat[:, 0], np.arange(len(w.starts)), "right"), *flat[:, 1:].T


def _spans(shard: Shard, w: Windows, places: tuple[np.ndarray, ...], pairs: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Maximal matches in a shard, some at a time: document, item, word start, item word start, words.

    Of all places of a window and of its words in items, those pairs begin a match before which the words differ or end.
    """
    words, ends = shard.words, shard.ends
    at, doc, window = find_windows(shard, w)
    place_ends, place, item, item_start, item_end = places
    begin, per = ends - shard.counts, np.diff(place_ends, prepend=0)[window]
    total = np.cumsum(per)
    lo = 0
    while lo < len(at):  # about so many pairs at a time
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + pairs, "right")))
        v, k = window[lo:hi], per[lo:hi]
        which = np.repeat(place_ends[v] - np.cumsum(k), k) + np.arange(int(k.sum()))
        x, d, y, n = np.repeat(at[lo:hi], k), np.repeat(doc[lo:hi], k), place[which], np.repeat(w.lengths[v], k)
        inside = (x > begin[d]) & (y > item_start[which])
        first = ~(inside & (words[np.maximum(x - 1, 0)] == w.words[np.maximum(y - 1, 0)]))
        x, d, y, n, which = x[first], d[first], y[first], n[first], which[first]
        open_ = np.arange(len(x))
        while len(open_):
            open_ = open_[(x[open_] + n[open_] < ends[d[open_]]) & (y[open_] + n[open_] < item_end[which[open_]])]
            open_ = open_[words[x[open_] + n[open_]] == w.words[y[open_] + n[open_]]]
            n[open_] += 1
        yield d, item[which], x - begin[d], y - item_start[which], n
        lo = hi


def _groups(benchmark: DataFrame, item_id: str, item_text: str, block_words: int, width: int) -> Iterator[list[Block]]:
    """The benchmark's blocks, TOGETHER of them at a time."""
    blocks = (block_of(*b, width) for b in _blocks(benchmark, item_id, item_text, block_words))
    while some := list(itertools.islice(blocks, TOGETHER)):
        yield some


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS, pairs: int = PAIRS) -> DataFrame:
    """All maximal verbatim matches of at least a window: doc_id, word_start, item_id, item_word_start, words; places from 0."""
    bounded_batches(df.sparkSession)
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = None
    for blocks in _groups(benchmark, item_id, item_text, block_words, width):

        def run(batches: Iterator[pa.RecordBatch], blocks: list[Block] = blocks) -> Iterator[pa.RecordBatch]:
            for held, words, counts in _shards(batches, 1):
                ids, shard = pa.concat_arrays([batch.column(0) for batch in held]), Shard(words, counts, width)
                for block in blocks:
                    for d, item, start, item_start, n in _spans(shard, block.windows, block.places, pairs):
                        yield pa.record_batch([ids.take(pa.array(d)), pa.array(start), pa.array([block.windows.names[i] for i in item.tolist()], pa.string()), pa.array(item_start), pa.array(n)], names=["doc_id", "word_start", "item_id", "item_word_start", "words"])

        part = base.mapInArrow(tidy(run), "doc_id long, word_start long, item_id string, item_word_start long, words long")
        out = part if out is None else out.unionAll(part)
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> list[tuple[list[str], pa.Array]]:
    base = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-size // (4 * block_words)))
    for b in range(number):
        part = base if number == 1 else base.filter(F.pmod(F.xxhash64("id", "text"), F.lit(number)) == b)
        table = part.toArrow()
        texts = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
        yield table["id"].to_pylist(), texts


def _shards(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    held, words, counts, total = [], [], [], 0
    for batch in batches:
        w, c = word_hashes(*utf8(batch.column(text)))
        held, words, counts, total = [*held, batch], [*words, w], [*counts, c], total + len(w)
        if total >= SHARD_WORDS:
            yield held, np.concatenate(words), np.concatenate(counts)
            held, words, counts, total = [], [], [], 0
    if held:
        yield held, np.concatenate(words), np.concatenate(counts)


_HITS = "doc_id long, key binary, n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest struct<back:long,item:string,start:long,item_start:long>"


def _found(shard: Shard, blocks: list[Block]) -> dict[int, tuple[list[tuple[int, int]], list[str], tuple[int, str, int, int]]]:
    """Of each document with a match: hit spans that are apart, items, and the longest match, of equals the first by item and places."""
    out: dict[int, tuple] = {}
    for block in blocks:
        names = block.windows.names
        for doc, item, start, item_start, n in judge(shard, block):
            spans, items, best = out.get(doc, ([], set(), None))
            spans = _apart([*spans, *zip(start.tolist(), (start + n).tolist(), strict=True)])
            items |= {names[i] for i in np.unique(item).tolist()}
            longest = int(n.max())
            for i, s, t in zip(*(c[n == longest].tolist() for c in (item, start, item_start)), strict=True):
                this = (-longest, names[i], s, t)
                best = this if best is None else min(best, this)
            out[doc] = spans, items, best
    return {d: (spans, sorted(items), best) for d, (spans, items, best) in out.items()}


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _hits(base: DataFrame, blocks: list[Block], width: int, every: bool) -> DataFrame:
    """Rows of _HITS: of the documents that the blocks' windows stand in, or of every one. base: doc_id, key, text."""
    names = [x.split()[0] for x in _HITS.split(", ")]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    best = pa.struct([("back", pa.int64()), ("item", pa.string()), ("start", pa.int64()), ("item_start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, words, counts in _shards(batches, 2):
            found = _found(Shard(words, counts, width), blocks)
            at = pa.array(range(len(counts)) if every else list(found), pa.int64())
            rows = [found.get(i) for i in at.to_pylist()]
            spans = pa.array([r and [{"start": a, "end": b} for a, b in r[0]] for r in rows], span)
            longest = pa.array([r and dict(zip(("back", "item", "start", "item_start"), r[2], strict=True)) for r in rows], best)
            ids, keys = (pa.concat_arrays([batch.column(k) for batch in held]).take(at) for k in (0, 1))
            yield pa.record_batch([ids, keys, pa.array(counts, pa.int64()).take(at), spans, pa.array([r and r[1] for r in rows], pa.list_(pa.string())), longest], names=names)

    return base.mapInArrow(tidy(run), _HITS)


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, and the longest verbatim match:
    longest_words (0 without one), longest_item, longest_start and longest_item_start (words from 0; of equal ones the first
    by item and places).

    Texts are read once for each group of benchmark blocks and never shuffled or written: of groups beyond the first only the
    hits are, which join the documents' rows by a key of 16 bytes.
    """
    bounded_batches(df.sparkSession)
    groups = _groups(benchmark, item_id, item_text, block_words, width)
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = _hits(base, next(groups), width, True)
    if more := [_hits(base, blocks, width, False) for blocks in groups]:
        # a document has a row for each group at most, but for rows that repeat
        others = reduce(DataFrame.unionAll, more).drop("doc_id", "n_words").distinct()
        others = others.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"), F.min("longest").alias("more_longest"))
        joined = lambda c: F.concat(*(F.coalesce(F.col(x), F.array().cast(out.schema[c].dataType)) for x in (c, f"more_{c}")))
        out = out.join(others, "key", "left").withColumns({"spans": F.array_sort(joined("spans")), "items": F.array_sort(F.array_distinct(joined("items"))), "longest": F.least("longest", "more_longest")})
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    length = F.aggregate("spans", zero, lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")), lambda s: s["n"])
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce(length, F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size(items) > 0).alias("contaminated"),
        items.alias("items"), F.coalesce(-F.col("longest.back"), F.lit(0)).cast("long").alias("longest_words"), F.col("longest.item").alias("longest_item"), F.col("longest.start").alias("longest_start"), F.col("longest.item_start").alias("longest_item_start"),
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """df without its contaminated rows, those that hold a match; all columns stay as they are. One filtering pass for each group of benchmark blocks."""
    bounded_batches(df.sparkSession)
    at = position(text_col, df.columns)
    for blocks in _groups(benchmark, item_id, item_text, block_words, width):

        def run(batches: Iterator[pa.RecordBatch], blocks: list[Block] = blocks) -> Iterator[pa.RecordBatch]:
            for held, words, counts in _shards(batches, at):
                shard, keep = Shard(words, counts, width), np.ones(len(counts), bool)
                for block in blocks:
                    for found in _spans(shard, block.windows, block.places, PAIRS):
                        keep[found[0]] = False
                row = 0
                for batch in held:
                    yield batch.filter(pa.array(keep[row : row + batch.num_rows]))
                    row += batch.num_rows

        df = df.mapInArrow(tidy(run), df.schema)
    return df
