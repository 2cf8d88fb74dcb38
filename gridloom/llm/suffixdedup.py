"""Operator 12: removal of repeated byte strings by a hash-compared suffix sort.

Every byte that a string of `length` bytes covers goes, if that string also starts earlier: in a document of a smaller id, or
in the same document before. All windows of that length are judged, in three steps that keep what is moved small.

1. A window's anchor is the 32-byte gram of the smallest hash in it, so equal windows have equal anchors at equal places, and
   the windows of a text fall into runs of one anchor (32 bytes of text each on average). Prefix polynomial hashes, one modulo
   2**64 and one modulo 2**31 - 1, give the hashes of grams and of runs. Runs that are alike as a whole are told apart from the
   first of them by one sort over (anchor, run, place); most of the text ends here, as its anchors are unique.
2. Where runs share an anchor and differ, the windows of these runs are suffixes to be sorted. Each task sorts the suffixes
   that share an anchor and the anchor's place by a merge sort of all groups at once: two suffixes are compared at their
   longest common extension, which is found by binary search over prefix hashes, so a comparison takes log2(length) steps. The
   finished order is verified byte by byte between neighbours; a collision, if one shows, has the suffixes sorted by their bytes.
3. Windows that are not the first of their kind are united per document.

A task's own repeats are settled before the shuffle, so a common passage sends one row a batch; runs of an anchor with more than
MOST_RUNS different surroundings are dealt out window by window, again after a pre-aggregation. All cases are exact.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; null ids come last; rows of equal id and text
are one document, which is its own first place; texts of one id come in the order of their hash; an empty table gives an empty
result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.kernel import bounded_batches, free_name, splitmix, tidy, utf8
from gridloom.session import settled, written

LENGTH, GRAM = 100, 32
#: Window starts that are hashed at a time, bytes of runs that are sorted at a time, different runs of an anchor beyond which it is dealt out.
TILE, SORT_BYTES, MOST_RUNS = 1 << 20, 1 << 21, 4096
PRIME = (1 << 31) - 1
_X, _Y = 0x9E3779B97F4A7C15, 1_220_703_125
_VALUES = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(7_000))
_SMALL = (splitmix(np.arange(256, dtype=np.uint64) + np.uint64(8_000)) % np.uint64(PRIME - 1)) + np.uint64(1)
_RUN = "h long, c long, d int, id long, sub long, pos int, lo int, hi int"
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of a hash's base or its inverse, kept by each worker."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, TILE + 256)
        if kind in ("x", "1/x"):
            base = _X if kind == "x" else pow(_X, -1, 1 << 64)
            have = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, base, np.uint64))))
        else:
            base = _Y if kind == "y" else pow(_Y, -1, PRIME)
            have = np.ones(1, np.uint64)
            while len(have) <= size:  # doubling: the powers so far times the next one
                have = np.concatenate((have, have * np.uint64(pow(base, len(have), PRIME)) % np.uint64(PRIME)))
        _powers[kind] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums of byte values times powers, modulo 2**64, from 0."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * _power("x", len(data)))))


def span_hash(prefix: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hashes of spans by two prefixes, whatever place they stand at."""
    return (prefix[start + size] - prefix[start]) * _power("1/x", len(prefix))[start]


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes, mixed hashes of all grams, and of each window the place of its least gram (the first of equal ones)."""
    prefix = prefix_hashes(data)
    gram = min(GRAM, length)
    n = len(data) - gram + 1
    h = (prefix[gram:] - prefix[:n]) * _power("1/x", n)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    least = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    width, need = 1, length - gram + 1
    while 2 * width <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if need > width:
        least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
    return prefix, h, (least & np.uint64(0xFFFFFF)).astype(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of window starts with one anchor, in order: document, anchor hash, two hashes of the run's bytes, anchor, first and last start."""
    for a in range(0, max(0, len(data) - length + 1), TILE):
        b = data[a : a + TILE + length - 1]
        whole = np.ones(len(b) - length + 1, bool)
        for k in range(int(np.searchsorted(offsets, a, "right")), len(offsets)):  # starts of which a document's end comes too soon
            end = int(offsets[k]) - a
            begin = max(int(offsets[k - 1]) - a, end - length + 1, 0)
            if begin >= len(whole):
                break
            whole[begin : max(0, end)] = False
        start = np.flatnonzero(whole)
        if not len(start):
            continue
        prefix, grams, anchor = anchors(b, length)
        at = anchor[start]
        cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
        lo, hi, at = start[cut], start[np.append(cut[1:], len(start)) - 1], at[cut]
        small = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_SMALL[b] * _power("y", len(b)) % np.uint64(PRIME))))
        d = (small[hi + length] - small[lo]) % np.uint64(PRIME) * _power("1/y", len(b))[lo] % np.uint64(PRIME)
        c = span_hash(prefix, lo, hi + length - lo)
        doc = np.searchsorted(offsets, a + lo, "right") - 1
        first = offsets[doc] - a
        yield doc, grams[at].view(np.int64), c.view(np.int64), d.astype(np.int32), at - first, lo - first, hi - first


_ROW = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("d", pa.int32()), ("id", pa.int64()), ("sub", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c).cast(f.type) for c, f in zip(columns, list(_ROW)[1:], strict=True))], schema=_ROW)


def _removed(ids: np.ndarray, subs: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Windows to remove (kind 1), spread over keys of no meaning; neighbours of a document that touch are one row."""
    if len(ids):
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (subs[1:] != subs[:-1]) | (lo[1:] != hi[:-1] + 1)))
        cut = np.flatnonzero(new)
        ids, subs, lo, hi = ids[cut], subs[cut], lo[cut], hi[np.append(cut[1:], len(hi)) - 1]
    zero = np.zeros(len(ids), np.int64)
    return _rows(1, splitmix(subs.view(np.uint64) ^ lo.astype(np.uint64)).view(np.int64), zero, zero, ids, subs, zero, lo, hi)


def _scan(length: int):
    """Documents (id, sub, text) to their runs (kind 0), without those that repeat an earlier one of the batch (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.lexsort((batch.column(1).to_numpy(), batch.column(0).to_numpy()))
            if (np.diff(order) != 1).any():
                batch = batch.take(pa.array(order))
            ids, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = utf8(batch.column(2))
            for doc, h, c, d, pos, lo, hi in runs(data, offsets, length):
                order = np.argsort(h ^ (c * np.int64(3)), kind="stable")
                g = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]) | (d[order][1:] != d[order][:-1])))
                first = np.zeros(len(h), np.int64)
                first[order] = order[np.maximum.accumulate(np.where(g, np.arange(len(g)), 0))]
                own = first == np.arange(len(h))
                i, s = ids[doc], subs[doc]
                gone = ~own & ~((i == i[first]) & (s == s[first]) & (lo == lo[first]))
                yield _rows(0, h[own], c[own], d[own], i[own], s[own], pos[own], lo[own], hi[own])
                if gone.any():
                    yield _removed(i[gone], s[gone], lo[gone], hi[gone])

    return run


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in the order of (h, c, d, place): those that repeat the first (kind 1), and first ones whose anchor has others (kind 0)."""
    before: tuple = ()  # the current run's h, c, d, and its first place
    waiting, several = None, False  # the only first run so far of the current anchor
    for batch in batches:
        done = batch.filter(pa.array(batch.column(0).to_numpy() == 1))
        if done.num_rows:
            yield done
        batch = batch.filter(pa.array(batch.column(0).to_numpy() == 0))
        if not batch.num_rows:
            continue
        h, c, d, ids, subs, pos, lo, hi = (batch.column(i).to_numpy().astype(np.int64) for i in range(1, 9))
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])))
        new[0] = before[:3] != (h[0], c[0], d[0])
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        carried = at < 0
        f = [np.where(carried, b, x[np.maximum(at, 0)]) for x, b in zip((ids, subs, lo), before[3:] or (0, 0, 0), strict=True)]
        gone = ~new & ~((ids == f[0]) & (subs == f[1]) & (lo == f[2]))
        if gone.any():
            yield _removed(ids[gone], subs[gone], lo[gone], hi[gone])
        before = (h[-1], c[-1], d[-1], *(int(x[-1]) for x in f))
        firsts = np.flatnonzero(new)
        if not len(firsts):
            continue
        anchor = h[firsts]
        begins = np.concatenate(([waiting is None or waiting[0][0] != anchor[0]], anchor[1:] != anchor[:-1]))
        group = np.cumsum(begins)  # 0: the anchor of the last batch goes on
        number = np.bincount(group, minlength=group[-1] + 1)
        if not begins[0]:
            number[0] += 1
            if not several:
                yield _rows(0, *waiting)
        alone = number[group] == 1
        hold = alone & (group == group[-1])
        emit = firsts[~alone]
        if len(emit):
            yield _rows(0, *(x[emit] for x in (h, c, d, ids, subs, pos, lo, hi)))
        last = firsts[-1:]
        waiting, several = tuple(x[last] for x in (h, c, d, ids, subs, pos, lo, hi)), not hold.any()


_CUT = "bucket long, id long, sub long, pos int, lo int, hi int, bytes binary"


def _cut(length: int):
    """Documents (id, sub, text, runs) to the runs' bytes by bucket; of anchors that are dealt out, window by window.

    A window that an earlier one of the batch equals is settled at once: it goes on without bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            seen: dict[bytes, tuple] = {}
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for (i, s), (text, own) in sorted({r[:2]: r[2:] for r in rows}.items(), key=lambda r: r[0]):  # rows of one document once
                for r in sorted(own, key=lambda r: r["lo"]):
                    if not r["dealt"]:
                        out.append((r["h"], i, s, r["pos"], r["lo"], r["hi"], text[r["lo"] : r["hi"] + length]))
                        continue
                    for at in range(r["lo"], r["hi"] + 1):
                        window = text[at : at + length]
                        before = seen.setdefault(window, (i, s, at))
                        if before == (i, s, at):
                            out.append((_bucket(window), i, s, at, at, at, window))
                        else:
                            out.append((s ^ at, i, s, at, at, at, None))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _CUT.split(", ")])

    return run


def _bucket(window: bytes) -> int:
    prefix = prefix_hashes(np.frombuffer(window, np.uint8))
    return int(splitmix(prefix[-1:]).view(np.int64)[0])


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, `most` at most, by binary search over the spans' hashes."""
    out = np.zeros(len(a), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        fits = np.flatnonzero(out + step <= most)
        i, j = a[fits] + out[fits], b[fits] + out[fits]
        out[fits[span_hash(prefix, i, step) == span_hash(prefix, j, step)]] += step
        step >>= 1
    return out


def merge_sort(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """The stable order of suffixes by their first `length` bytes inside groups, which lie one after another.

    All groups are merged at once, in runs of 1, 2, 4 ...: a suffix's new place is its own in its run and the number of
    suffixes of the neighbouring run before it, found by binary search.
    """
    prefix = prefix_hashes(data)
    n = len(start)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    base, size = np.repeat(first, size), np.repeat(size, size)
    width = 1
    while width < size.max(initial=0):
        slot = np.flatnonzero(size > width)
        q = slot - base[slot]
        run = q // width
        other = (run ^ 1) * width
        slot, q, run, other = (x[other < size[slot]] for x in (slot, q, run, other))
        here, right = start[order[slot]], run & 1 == 1
        lo = np.zeros(len(slot), np.int64)
        hi = np.minimum(width, size[slot] - other)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            there = start[order[base[slot[open_]] + other[open_] + mid]]
            same = common_extension(prefix, here[open_], there, length)
            equal = same == length
            i, j = (np.where(equal, x, x + same) for x in (here[open_], there))
            before = np.where(equal, right[open_], data[j] < data[i])
            lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
        new = order.copy()
        new[base[slot] + (run & ~1) * width + q - run * width + lo] = order[slot]
        order = new
        width *= 2
    return order


def verified(data: np.ndarray, start: np.ndarray, group: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """order, sorted again by bytes if the bytes of neighbours contradict it, and which suffixes equal the one before."""
    equal = np.zeros(len(order), bool)
    at = np.arange(length)
    for lo in range(1, len(order), 1 << 14):
        t = np.arange(lo, min(len(order), lo + (1 << 14)))
        t = t[group[t] == group[t - 1]]
        a, b = data[start[order[t - 1]][:, None] + at], data[start[order[t]][:, None] + at]
        unequal = a != b
        place = unequal.argmax(axis=1)
        equal[t] = ~unequal[np.arange(len(t)), place]
        rows = np.arange(len(t))
        if ((a[rows, place] > b[rows, place]) | (equal[t] & (order[t] < order[t - 1]))).any():
            suffix = {int(i): data[start[i] : start[i] + length].tobytes() for i in order}
            order = np.array(sorted(range(len(order)), key=lambda i: (group[i], suffix[i], i)), np.int64)
            same = [group[x] == group[y] and suffix[x] == suffix[y] for x, y in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
            return order, np.array([False, *same])
    return order, equal


def _sort(length: int, most: int):
    """Runs' bytes in the order of (bucket, place) to the windows that an earlier equal one precedes."""

    def judged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        bucket, ids, subs, pos, lo, hi = (t.column(i).to_numpy().astype(np.int64) for i in range(6))
        settled = t.column(6).is_null().to_numpy(zero_copy_only=False)
        column = t.column(6).fill_null(b"")
        data, offsets = utf8(pa.Array.from_buffers(pa.string(), len(column), column.buffers(), offset=column.offset))
        n = np.where(settled, 0, hi - lo + 1)
        row = np.repeat(np.arange(len(n)), n)
        s = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        number = np.cumsum(np.concatenate(([0], bucket[1:] != bucket[:-1])))
        group = number[row] * (2 * length) + (pos[row] - s)
        by = np.argsort(group, kind="stable")
        group, row, s = group[by], row[by], s[by]
        apart = np.concatenate(([True], group[1:] != group[:-1], [True]))
        several = np.flatnonzero(~(apart[:-1] & apart[1:]))
        group, row, s = group[several], row[several], s[several]
        start = offsets[row] + s - lo[row]
        order, equal = verified(data, start, group, merge_sort(data, start, group, length), length)
        first = order[np.maximum.accumulate(np.where(equal, 0, np.arange(len(equal))))]
        f, own = row[first], row[order]
        gone = equal & ~((ids[own] == ids[f]) & (subs[own] == subs[f]) & (s[order] == s[first]))
        own, at = own[gone], s[order][gone]
        own, at = np.concatenate([own, np.flatnonzero(settled)]), np.concatenate([at, lo[settled]])
        by = np.lexsort((at, subs[own], ids[own]))
        return _removed(ids[own[by]], subs[own[by]], at[by], at[by])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < most:
                continue
            # the last bucket may go on
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bucket = t.column(0).to_numpy()
            end = int(np.searchsorted(bucket, bucket[-1]))
            if end:
                yield judged([t.slice(0, end)])
                t = t.slice(end)
            held, size = [t], 0 if end else size
        if held:
            yield judged(held)

    return run


def _united(length: int, text: int, columns: int):
    """Rows with a list of windows to rows with the united spans and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for body, windows in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(columns).to_pylist(), strict=True):
                body = body or b""
                own: list[list[int]] = []
                for w in sorted((w["lo"], w["hi"]) for w in windows or []):
                    if own and w[0] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], w[1] + length)
                    else:
                        own.append([w[0], w[1] + length])
                spans.append([{"start": a, "end": b} for a, b in own])
                edges = [0, *(x for span in own for x in span), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([*batch.columns[:columns], pa.array(spans, kind), pa.array(kept, pa.binary())], names=[str(i) for i in range(columns + 2)])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_runs: int = MOST_RUNS, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """df's columns, the removed spans of each text's UTF-8 bytes (start, end) and the bytes that are kept."""
    bounded_batches(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    number = F.col(f"`{id_col}`").cast("long")
    taken = [*df.columns, "spans", "kept"]
    key = [F.coalesce(number, F.lit((1 << 63) - 1)), F.xxhash64(number.isNull(), text)]
    base = df.select(*(k.alias(a) for k, a in zip(key, ("id", "sub"), strict=True)), text.alias("text"))

    found = base.mapInArrow(tidy(_scan(length)), f"kind int, {_RUN}")
    placed = found.repartition("h").sortWithinPartitions("h", "c", "d", "id", "sub", "lo").mapInArrow(_first_runs, f"kind int, {_RUN}")
    repeats = written(placed, "repeats")

    shared = repeats.filter("kind = 0")
    dealt = settled(shared.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > most_runs).select("h", F.lit(True).alias("dealt")), "dealt")
    by_doc = shared.join(dealt, "h", "left").withColumn("dealt", F.coalesce("dealt", F.lit(False))).groupBy("id", "sub").agg(F.collect_list(F.struct("h", "pos", "lo", "hi", "dealt")).alias("runs"))
    pieces = base.join(by_doc, ["id", "sub"]).select("id", "sub", F.col("text").cast("binary"), "runs").mapInArrow(tidy(_cut(length)), _CUT)
    judged = written(pieces.repartition("bucket").sortWithinPartitions("bucket", "id", "sub", "lo").mapInArrow(tidy(_sort(length, sort_bytes)), f"kind int, {_RUN}"), "windows")

    k_id, k_sub, k_windows = (free_name(x, taken) for x in ("id", "sub", "windows"))
    gone = repeats.filter("kind = 1").unionAll(judged).groupBy(F.col("id").alias(k_id), F.col("sub").alias(k_sub)).agg(F.collect_list(F.struct("lo", "hi")).alias(k_windows))
    rows = df.select("*", key[0].alias(k_id), key[1].alias(k_sub)).join(gone, [k_id, k_sub], "left").select(*(F.col(f"`{c}`") for c in df.columns), k_windows)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*df.schema.fields, T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(tidy(_united(length, [c.lower() for c in df.columns].index(text_col.lower()), len(df.columns))), schema)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **limits: int) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return remove_repeats(own, length=length, **limits).select("doc_id", n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
