"""Operator 11: the prefix trie of conversations, as a Cartesian tree over the LCP array of the sorted conversations.

A turn is a 16-byte code (MD5 of role and text), a conversation the codes of its turns one after another, so that conversations
sort as bytes. Spark sorts the distinct ones by range; x[i] is the number of turns that conversation i shares with the one
before it. A node of depth v whose members branch is an interval of conversations between two nearest smaller values around
an x[i] = v: each task finds all nearest smaller values of its block of the order by descending through tables of block
minima, merges entries of equal value that belong to one node, and aggregates members, leaves and saved words over intervals.
Depths between a node and its parent hold the same members and are filled in at the end.

Intervals that reach over a block's edge are left as the block's skeleton: its running minima from either side, each at most
twice, with the sums between them. The skeletons of all blocks, one after another, are again such an array, and one pass of
the same function closes the rest. What a block could not know, the first member of a parent that reaches over its edge, is
joined on (block, skeleton entry). The hash of the ids that end in a node is taken from sorted runs, joined run by run.

Bounds: a conversation is one row of 20 bytes a turn; a block holds BLOCK_ROWS conversations or BLOCK_TURNS turns; the last
pass holds two entries for each value of a block's running minima.

Defined cases: rows with a null conv_id belong to no conversation; null role or text is empty; null turns come first, equal
turns by their code; rows that repeat are turns of their own; for negative ids % takes the sign of the id; a table without
conversations has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.kernel import tidy, utf8
from gridloom.session import written

BLOCK_ROWS, BLOCK_TURNS = 1 << 16, 1 << 21
#: Conversations of a family share the first turns of the family's first one, at most MOST_SHARED - 1 of them.
FAMILY, MOST_SHARED = 20, 4
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PART = "block long, entry long, shared long, times long, size long, ends string, single boolean, codes binary, words array<int>"


@dataclass
class Segments:
    """Consecutive runs of sorted conversations. shared: turns in common with the run before, counted `times` over.

    members, low, leaves, saved: sums and the smallest id over a run; size, ends: turns and id hash of its first conversation;
    single: one conversation whose own nodes are still to come; words: running word counts from 0, where at >= 0 points to.
    """

    shared: np.ndarray
    times: np.ndarray
    members: np.ndarray
    low: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    size: np.ndarray
    ends: np.ndarray
    single: np.ndarray
    words: np.ndarray
    at: np.ndarray


def minima(x: np.ndarray) -> list[np.ndarray]:
    """Minima over blocks of 1, 2, 4 ... entries from each place on."""
    out = [x]
    while 2 << (len(out) - 1) <= len(x):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def nearest_smaller(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest smaller values before and after each inner entry of x, whose first and last are its smallest.

    All entries at once: a search steps over a block if the block's minimum is not smaller, in blocks of falling size.
    """
    inner = np.arange(1, len(x) - 1)
    before, after = inner.copy(), inner + 1
    tables = minima(x)
    for k in range(len(tables) - 1, -1, -1):
        width, table = 1 << k, tables[k]
        step = (before >= width) & (table[np.maximum(before - width, 0)] >= x[inner])
        before = np.where(step, before - width, before)
        step = (after + width <= len(x)) & (table[np.minimum(after, len(table) - 1)] >= x[inner])
        after = np.where(step, after + width, after)
    return before - 1, after


def _lowest(tables: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima over [first, last]."""
    out = np.zeros(len(first), np.int64)
    level = np.frexp(last - first + 1)[1] - 1
    for k in np.unique(level):
        here = level == k
        out[here] = np.minimum(tables[k][first[here]], tables[k][last[here] - (1 << k) + 1])
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(x)))


def solve(s: Segments, last: bool) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of all intervals that close; then, of those that don't, the skeleton's first segments, entries' times, and entry of each place.

    last: nothing lies outside, so all intervals close. The last array gives each place's parent id there instead.
    """
    m = len(s.size)
    x = np.concatenate(([-1], s.shared[1:], [-1])) if m else np.zeros(0, np.int64)
    left, right = nearest_smaller(x)
    value = x[1:-1]
    closed = np.ones(m - 1, bool) if last else (left > 0) & (right < m)
    # entries of equal value in one interval are one node: the first stands for all
    span = int(x.max(initial=0)) + 2
    _, first, which = np.unique(left * span + value, return_index=True, return_inverse=True)
    times = np.bincount(which, s.times[1:], len(first)).astype(np.int64)
    lows, members = minima(s.low), _sums(s.members)
    via = np.minimum.accumulate(np.where(s.at >= 0, np.arange(m), m)[::-1])[::-1]  # the next segment that has words
    own = np.arange(m)
    known = s.single & (last | ((own > 0) & (own < m - 1)))
    leaf = s.single & (s.size > x[1:])

    def words(segment: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return s.words[s.at[via[segment]] + np.maximum(depth, 0)]

    f = first[closed[first]]
    a, b, v, p = left[f], right[f] - 1, value[f], np.maximum(x[left[f]], x[right[f]])
    n = members[b + 1] - members[a]
    gain = np.zeros(m + 1, np.int64)
    gain[f + 1] = (n - 1) * (words(a, v) - words(a, p))
    chain = np.flatnonzero(known)
    cp = np.maximum(x[chain], x[chain + 1])
    saved = s.saved.copy()
    saved[chain] += np.maximum(s.members[chain] - 1, 0) * np.where(s.size[chain] > cp, words(chain, s.size[chain]) - words(chain, np.minimum(cp, s.size[chain])), 0)
    gains, saves, leaves = _sums(gain), _sums(saved), _sums(np.where(s.single, leaf, s.leaves))
    low = _lowest(lows, a, b)
    # inner nodes, then leaves: intervals with the depth of their parents, p, and their own, v
    chain, cp = chain[s.size[chain] > cp], cp[s.size[chain] > cp]
    below = np.concatenate([saves[b + 1] - saves[a] + gains[b + 1] - gains[a + 1] - gain[f + 1], np.zeros(len(chain), np.int64)])
    up = np.concatenate([np.where(x[left[f]] >= x[right[f]], left[f], right[f]), np.where(x[chain] >= x[chain + 1], chain, chain + 1)])
    a, v, p = np.concatenate([a, chain]), np.concatenate([v, s.size[chain]]), np.concatenate([p, cp])
    children = np.concatenate([times[which[f]] + 1 - (s.size[left[f]] == value[f]), np.zeros(len(chain), np.int64)])
    n, low = np.concatenate([n, s.members[chain]]), np.concatenate([low, s.low[chain]])
    leafs = np.concatenate([leaves[b + 1] - leaves[left[f]], np.ones(len(chain), np.int64)])
    # the first member of a place's interval, where that is closed
    of_place = np.zeros(m + 1, np.int64)
    is_closed = np.zeros(m + 1, bool)
    place = np.zeros(len(first), np.int64)
    place[which[f]] = low[: len(f)]
    of_place[1:m], is_closed[1:m] = place[which], closed
    deep = v - p
    row = np.repeat(np.arange(len(a)), deep)
    depth = np.repeat(v - np.cumsum(deep), deep) + np.arange(1, len(row) + 1)
    top, end = depth == p[row] + 1, depth == v[row]
    inside = ~top | is_closed[up[row]]
    nodes = {
        "conv_id": low[row], "depth": depth,
        "parent_conv_id": np.where(top, of_place[up[row]], low[row]), "has_parent": inside & (depth > 0),
        "n_convs": n[row], "n_children": np.where(end, children[row], 1), "n_leaves": leafs[row],
        "saved_tokens": below[row] + (n[row] - 1) * (words(a[row], v[row]) - words(a[row], depth - 1)),
        "ends_sha256": np.where(end & (s.size[a[row]] == depth), s.ends[a[row]], NOTHING), "open": np.where(inside, -1, up[row]),
    }
    if last:
        return nodes, np.zeros(0, np.int64), np.zeros(0, np.int64), of_place
    kept = np.flatnonzero(~closed) + 1
    # of a run of equal entries the first, which takes over the counts of those between, and the last stay
    starts = np.ones(len(kept), bool)
    starts[1:] = x[kept[1:]] != x[kept[:-1]]
    ends = np.concatenate([starts[1:], [True]]) if len(kept) else starts
    run = np.cumsum(starts) - 1
    count = s.times[kept]
    total = np.bincount(run, np.where(ends & ~starts, 0, count), run.max(initial=-1) + 1).astype(np.int64)
    stay = starts | ends
    firsts = np.concatenate([[0], kept[stay]])
    entry = np.full(m + 1, -1, np.int64)
    entry[kept] = np.cumsum(stay)  # one between has the entry of its run's first
    nodes["open"] = np.where(nodes["open"] >= 0, entry[np.maximum(nodes["open"], 0)], -1)
    s.saved = saved + gain[:m]
    s.leaves = np.where(known, leaf, s.leaves)
    return nodes, firsts, np.concatenate([[0], np.where(starts, total[run], count)[stay]]), entry


def _rows(nodes: dict[str, np.ndarray], block: np.ndarray | int) -> dict[str, pa.Array]:
    out = {k: pa.array(v) for k, v in nodes.items() if k not in ("has_parent", "open", "ends_sha256")}
    out["parent_conv_id"] = pa.array(nodes["parent_conv_id"], mask=~nodes["has_parent"])
    out["ends_sha256"] = pa.array(nodes["ends_sha256"].tolist(), pa.string())
    out["block"] = pa.array(np.full(len(nodes["depth"]), block, np.int64))
    out["entry"] = pa.array(nodes["open"], mask=nodes["open"] < 0)
    return out


def _batch(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def shared_turns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Codes of 16 bytes that neighbours in an order have in common, from the second on."""
    code = data.view(np.uint64).reshape(-1, 2)
    start, size = offsets[:-1] // 16, np.diff(offsets) // 16
    out = np.zeros(max(0, len(size) - 1), np.int64)
    open_, d = np.arange(len(out)), 0
    while len(open_):
        open_ = open_[(size[open_] > d) & (size[open_ + 1] > d)]
        open_ = open_[(code[start[open_] + d] == code[start[open_ + 1] + d]).all(axis=1)]
        out[open_] += 1
        d += 1
    return out


def _blocks(rows: int, turns: int, schema: pa.Schema):
    """Sorted conversations (codes, words, conv_id, members, ends) to nodes (kind 0) and skeletons (kind 1), block by block."""

    def solved(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, offsets = utf8(_text(table.column(0)))
        data = np.ascontiguousarray(data)
        size = np.diff(offsets) // 16
        m = len(size)
        counts = table.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum(size + 1) - (size + 1)
        words = np.zeros(len(counts) + m, np.int64)
        inner = np.ones(len(words), bool)
        inner[at] = False
        words[inner] = counts
        total = np.cumsum(words)
        words = total - np.repeat(total[at], size + 1)
        low, members = (table.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
        zero = np.zeros(m, np.int64)
        s = Segments(np.concatenate([[-1], shared_turns(data, offsets)]), np.ones(m, np.int64), members, low, zero, zero, size, np.array(table.column(4).to_pylist(), object), np.ones(m, bool), words, at)
        nodes, firsts, times, _ = solve(s, last=False)
        block = (TaskContext.get().partitionId() << 32) + number
        if len(nodes["depth"]):
            yield _batch({"kind": pa.array(np.zeros(len(nodes["depth"]), np.int32)), **_rows(nodes, block)}, schema)
        edge = np.zeros(len(firsts), bool)
        edge[[0, -1]] = True
        add = lambda v: np.add.reduceat(v, firsts)
        yield _batch(
            {
                "kind": pa.array(np.ones(len(firsts), np.int32)), "block": pa.array(np.full(len(firsts), block)), "entry": pa.array(np.arange(len(firsts))),
                "shared": pa.array(s.shared[firsts]), "times": pa.array(times), "n_convs": pa.array(add(members)), "conv_id": pa.array(np.minimum.reduceat(low, firsts)),
                "n_leaves": pa.array(add(s.leaves)), "saved_tokens": pa.array(np.where(edge, 0, add(s.saved))), "size": pa.array(size[firsts]), "ends": pa.array(s.ends[firsts].tolist(), pa.string()),
                "single": pa.array(edge), "codes": table.column(0).take(pa.array(firsts, mask=~edge)), "words": table.column(1).take(pa.array(firsts, mask=~edge)),
            },
            schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, codes, number = [], 0, 0, 0
        for batch in batches:
            while batch.num_rows:
                ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
                take = int(min(rows - n, max(1, np.searchsorted(ends, turns - codes, "right")), batch.num_rows))
                held.append(batch.slice(0, take))
                n, codes, batch = n + take, codes + int(ends[take - 1]), batch.slice(take)
                if n >= rows or codes >= turns or batch.num_rows:
                    yield from solved(held, number)
                    held, n, codes, number = [], 0, 0, number + 1
        if held:
            yield from solved(held, number)

    return run


def _text(column: pa.Array) -> pa.Array:
    """A binary column as one whose bytes utf8() hands out."""
    return pa.Array.from_buffers(pa.large_string() if pa.types.is_large_binary(column.type) else pa.string(), len(column), column.buffers(), offset=column.offset)


def _seams(schema: pa.Schema):
    """The skeletons of all blocks in order to the nodes that reach over edges (kind 0) and the first members of entries' nodes (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(x.num_rows for x in held):
            return
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda name, fill=0: t[name].combine_chunks().fill_null(fill).to_numpy(zero_copy_only=False)
        block, entry, shared = column("block"), column("entry"), column("shared").copy()
        codes, words = t["codes"].to_pylist(), t["words"].to_pylist()
        at, flat, end = np.full(len(block), -1, np.int64), [], 0
        for i, x in enumerate(words):
            if x is not None:
                at[i] = end
                flat.append(np.concatenate(([0], np.cumsum(np.array(x, np.int64)))))
                end += len(flat[-1])
        for i in np.flatnonzero(entry[1:] == 0) + 1:  # the last conversation of a block and the first of the next
            pair = codes[i - 1], codes[i]
            shared[i] = shared_turns(np.array(bytearray(b"".join(pair))).astype(np.uint8), np.cumsum([0, *map(len, pair)]))[0]
        times = np.where(entry == 0, 1, column("times"))
        s = Segments(shared, times, column("n_convs"), column("conv_id"), column("n_leaves"), column("saved_tokens"), column("size"), np.array(t["ends"].to_pylist(), object), column("single", False).astype(bool), np.concatenate(flat), at)
        nodes, _, _, low = solve(s, last=True)
        yield _batch({"kind": pa.array(np.zeros(len(nodes["depth"]), np.int32)), **_rows(nodes, -1)}, schema)
        inner = np.flatnonzero(entry > 0)
        yield _batch({"kind": pa.array(np.full(len(inner), 2, np.int32)), "block": pa.array(block[inner]), "entry": pa.array(entry[inner]), "conv_id": pa.array(low[inner])}, schema)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in the order of (key, id) to comma-joined pieces of a key's ids, with the first id and the number of each."""
    for batch in batches:
        keys, ids = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        data, _ = utf8(_text(keys))
        pairs = np.ascontiguousarray(data).view(np.uint64).reshape(-1, 2)
        cut = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1))))
        ends = np.append(cut[1:], len(ids))
        joined = pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in zip(cut, ends, strict=True)])
        yield pa.record_batch([keys.take(pa.array(cut)), pa.array(ids[cut]), pa.array(ends - cut), joined], names=["key", "conv_id", "members", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of (key, first id) to each key's first id, number of ids and hash of the whole list."""
    key, low, members, sha = None, 0, 0, None
    for batch in batches:
        out = []
        for k, i, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if sha is not None:
                    out.append((low, members, sha.hexdigest()))
                key, low, members, sha = k, i, 0, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
            members += n
        yield _ended(out)
    if sha is not None:
        yield _ended([(low, members, sha.hexdigest())])


def _ended(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["conv_id", "members", "ends"])


def rebuilt(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, codes, words of every conversation, its first turns replaced by those of its family's first conversation."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    turns = df.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said)).alias("code"), F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    ).filter("conv_id is not null")
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "code", "words"))).alias("turns"))
    own = written(own.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["code"]), "")).alias("codes"), F.transform("turns", lambda x: x["words"]).alias("words")), "conversations")
    most = MOST_SHARED - 1
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.substring("codes", 1, 16 * most).alias("head_codes"), F.slice("words", 1, most).alias("head_words"))
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).cast("int")
    with_heads = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "family", "left").withColumn("h", h)
    head_codes = F.coalesce(F.substr("head_codes", F.lit(1), 16 * F.col("h")), F.lit(b""))
    head_words = F.coalesce(F.slice("head_words", F.lit(1), F.col("h")), F.array().cast("array<int>"))
    rest_words = F.slice("words", F.col("h") + 1, F.greatest(F.size("words") - F.col("h"), F.lit(0)))
    return with_heads.select("conv_id", F.concat(head_codes, F.substr("codes", 16 * F.col("h") + 1)).alias("codes"), F.concat(head_words, rest_words).alias("words"))


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """All nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, counts, saved_tokens, ends_sha256."""
    convs = written(rebuilt(df, conv, turn, role, text), "rebuilt")
    members = convs.select(F.unhex(F.md5("codes")).alias("key"), "conv_id")
    pieces = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_runs, "key binary, conv_id long, members long, ids string")
    distinct = pieces.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed, "conv_id long, members long, ends string")
    sequences = written(convs.join(distinct, "conv_id").select("codes", "words", "conv_id", "members", "ends"), "sequences")
    kinds = f"kind int, {NODE}, {_PART}"
    schema = _arrow(kinds)
    solved = written(sequences.repartitionByRange("codes").sortWithinPartitions("codes").mapInArrow(tidy(_blocks(block_rows, block_turns, schema)), kinds), "trie")
    seams = written(solved.filter("kind = 1").repartition(1).sortWithinPartitions("block", "entry").mapInArrow(tidy(_seams(schema)), kinds), "seams")
    columns = [x.split()[0] for x in NODE.split(", ")]
    inner = solved.filter("kind = 0")
    parents = seams.filter("kind = 2").select("block", "entry", F.col("conv_id").alias("parent"))
    open_ = inner.filter("entry is not null").join(parents, ["block", "entry"]).withColumn("parent_conv_id", F.col("parent"))
    return inner.filter("entry is null").select(columns).unionAll(open_.select(columns)).unionAll(seams.filter("kind = 0").select(columns))


def _arrow(kinds: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, types[kind]) for name, kind in (x.split() for x in kinds.split(", "))])
