"""Operators 11 to 13: brute force, SQL, and odd tables."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridloom.llm import filteraudit, oracles, prefixtrie, queries, suffixdedup
from tests.compare import same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_filter_audit"])
def test_query(spark, name):
    same(spark, queries.QUERIES[name], oracles.ORACLES[name], SF)


def audited(rows, labels):
    """Plain replay of all orders."""
    out = {}
    good, toxic = {r[0] for r in labels if r[0] is not None and r[1] == 1}, {r[0] for r in labels if r[0] is not None and r[2] == 1}
    judged = []
    for i, t, s in rows:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= x <= "Z" for x in t) > 5 * len(t), "D": any(x in "#$%&*|" for x in t)}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        judged.append((s or "", i, {k for k, v in fails.items() if v}))
    for part in {p for p, _, _ in judged}:
        own = [(i, f) for p, i, f in judged if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in filteraudit.ORDERS:
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_filter_audit_brute_force(spark):
    prose = " ".join(f"w{i % 61}" for i in range(80))
    odd = [None, "", prose, prose, prose.upper(), prose + " #", "a " * 60, "A", "x" * 300_000, "w " * 200_000, "é Ä " * 40, "tab\tfeed\x0bline\nend\x1f" * 20]
    rows = [(i, t, s) for i, (t, s) in enumerate((t, s) for t in odd for s in ("web", None, "", "book"))]
    rows += [(None, prose, "web"), (None, None, None), (2, prose, "web"), (2, prose, "web"), (-5, "A", "forum")]
    labels = [(2, 1, 0), (2, 0, 1), (5, 1, 1), (9, None, 1), (10, 1, None), (None, 1, 1), (-5, 1, 1)]
    got = filteraudit.audit(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS), parts=2).collect()
    want = audited(rows, labels)
    assert len(got) == len(want) == 4 * 600
    assert {(r.part, r.filter_order, r.step): [r[f] for f in filteraudit.FIGURES] for r in got} == want


def test_filter_audit_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert filteraudit.audit(none, spark.createDataFrame([], LABELS)).count() == 0
    clash = spark.createDataFrame([(1, "a b", "s", 5, "x", b"k"), (2, "a b", "s", 6, "y", b"k")], DOCS + ", flags int, part string, key binary")
    got = filteraudit.audit(clash, spark.createDataFrame([], LABELS + ", own string, good string")).filter("filter_order = 'EABCD'").orderBy("step").collect()
    assert [(r.removed, r.kept) for r in got] == [(1, 1), (1, 0), (0, 0), (0, 0), (0, 0)]
    assert {r.part for r in got} == {"s"}


def test_word_figures_pieces():
    text = b" ".join(b"abcdefghijklmnopqrstuvwxyz"[i % 17 :][:7] for i in range(3000)) + b"\x0b\x0c\r  end"
    assert filteraudit.word_figures(text, 100) == (len(text.split()), len(set(text.split())))


TURNS = "conv_id long, turn long, role string, text string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(rows):
    """Nodes by their whole sequences of turns."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    node = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple([*own.get(int(c - np.fmod(c, 20)), [])[:h], *turns[h:]])
        for d in range(len(whole) + 1):
            node.setdefault(whole[:d], [[], []])[0].append(c)
        node[whole][1].append(c)
    kids = {}
    for k in node:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(node, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + (len(node[k][0]) - 1) * (len(k[-1][1].encode().split()) if k else 0)
    return sorted((min(m), len(k), min(node[k[:-1]][0]) if k else -(1 << 62), len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for k, (m, e) in node.items())


def check_trie(spark, rows, **limits):
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS), **limits).collect()
    assert sorted(tuple(-(1 << 62) if f == "parent_conv_id" and r[f] is None else r[f] for f in FIELDS) for r in got) == trie(rows)


@pytest.mark.parametrize("seed, block_rows", [(0, 1), (1, 2), (2, 3), (3, 7), (4, 1000)])
def test_trie_brute_force(spark, seed, block_rows):
    draw = random.Random(seed)
    rows = [(c, t, draw.choice(["user", "assistant"]), " ".join("ab"[: draw.randint(1, 2)] for _ in range(draw.randint(0, 2)))) for c in draw.sample(range(-30, 200), 150) for t in range(draw.randint(1, 6))]
    check_trie(spark, rows, block_rows=block_rows)


def test_trie_odd_tables(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    check_trie(spark, [(7, None, None, None)])
    check_trie(spark, [(None, 1, "user", "x"), (21, 1, "user", "x")])  # 21 takes its first turn from the absent 20
    odd = [(40, 2, "u", "b c"), (40, None, None, None), (40, 1, "u", "a\x0bb\x1fc"), (20, 0, "u", "x" * 200_000), (20, 1, "u", "w " * 50_000)]
    odd += [(c, t, "u", "same") for c in range(100, 260) for t in range(3)] + [(60, t, "u", "long") for t in range(700)] + [(61, t, "u", "long") for t in range(701)]
    check_trie(spark, odd, block_rows=16)
    check_trie(spark, odd, block_turns=40)
    clash = spark.createDataFrame([(1, 0, "u", "a", 5, "k"), (1, 1, "u", "b", 6, "l")], TURNS + ", block int, codes string")
    assert prefixtrie.prefix_trie(clash).count() == len(trie([(1, 0, "u", "a"), (1, 1, "u", "b")]))


def test_nearest_smaller():
    draw = np.random.default_rng(1)
    for n in itertools.chain(range(40), [300]):
        x = np.concatenate(([-1], draw.integers(0, 5, n), [-1]))
        before, after = prefixtrie.nearest_smaller(x)
        for i in range(1, n + 1):
            assert before[i - 1] == max(j for j in range(i) if x[j] < x[i]) and after[i - 1] == min(j for j in range(i + 1, n + 2) if x[j] < x[i])


def repeats(rows, length):
    """Every window against all earlier ones; rows of equal id and text are one document."""
    out, seen = {}, set()
    last = 1 << 63
    key = {}
    for i, t in rows:
        key.setdefault((i, t or ""), len(key))
    # texts of one id come in an order of their own, so tests keep ids apart unless the texts share nothing
    for i, t in sorted(key, key=lambda r: (last if r[0] is None else r[0], r[1])):
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                hit[s : s + length] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(int)) == 1)
        out[i, t] = (len(b), int(hit.sum()), len(edges), hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest())
    return sorted(((last if i is None else i), *out[i, t or ""]) for i, t in rows)


def check_repeats(spark, rows, length=100, **limits):
    got = suffixdedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=length, **limits).collect()
    assert sorted(((1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats(rows, length)


def passages(seed, n=120):
    draw = random.Random(seed)
    text = lambda size: "".join(draw.choice("abcdeé ") for _ in range(size))
    shared = [text(draw.choice([60, 99, 100, 101, 130, 260, 700])) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [draw.choice(shared) if draw.random() < 0.4 else text(draw.randint(0, 160)) for _ in range(draw.randint(0, 6))]
        rows.append((3 * i - 40, draw.choice(["", "x" * draw.randint(0, 400), "ab" * draw.randint(0, 200)]).join(parts) if draw.random() < 0.2 else "".join(parts)))
    return rows


@pytest.mark.parametrize("seed, limits", [(0, {}), (1, {"most_runs": 2}), (2, {"sort_bytes": 1000}), (3, {"most_runs": 0})])
def test_suffix_dedup_brute_force(spark, seed, limits):
    rows = passages(seed)
    rows += [(1000 + i, rows[i][1]) for i in range(0, 120, 7)] + [rows[3], rows[3], rows[10]]
    check_repeats(spark, rows, **limits)


def test_suffix_dedup_short_strings(spark):
    check_repeats(spark, passages(5), length=20)


def test_suffix_dedup_odd_texts(spark):
    line = "GNU General Public License, version 3, with all of its sections and exceptions that hold here, and one more word."
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 100), (5, "a" * 5000), (6, line), (6, None), (None, line), (None, "b" * 300), (7, line + line), (-9, "x" + line), (8, ("word " * 3000) + line)]
    rows += [(100 + i, f"{i} some lead that differs {i * 7919} " + line + f" and a tail {i * 104729}") for i in range(60)]
    check_repeats(spark, rows)
    check_repeats(spark, rows, most_runs=5)
    assert suffixdedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, line, 5, "k", 1.5, b"z"), (2, line, 6, "l", 2.5, b"y")], "doc_id long, text string, id int, sub string, lo double, windows binary")
    got = suffixdedup.remove_repeats(clash).orderBy("doc_id").collect()
    assert [r.kept.decode() for r in got] == [line, ""] and [(r.id, r["sub"]) for r in got] == [(5, "k"), (6, "l")]
    assert [[(x.start, x.end) for x in r.spans] for r in got] == [[], [(0, len(line))]]


def test_suffix_dedup_tiles():
    """Runs of windows cover every window once, whatever the tiles, and long texts need no more than a tile."""
    texts = [t.encode() for _, t in passages(8, 40)] + [b"", b"q" * 3000]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = sorted((d, s) for d, t in enumerate(texts) for s in range(len(t) - 99))
    for tile in (1, 37, 1000, suffixdedup.TILE):
        before, suffixdedup.TILE = suffixdedup.TILE, tile
        try:
            got = [(int(d), s) for run in suffixdedup.runs(data, offsets, 100) for d, lo, hi in zip(run[0], run[5], run[6], strict=True) for s in range(lo, hi + 1)]
        finally:
            suffixdedup.TILE = before
        assert sorted(got) == want and len(set(got)) == len(got)


@pytest.mark.parametrize("broken", [False, True])
def test_merge_sort_and_collisions(monkeypatch, broken):
    draw = np.random.default_rng(2)
    data = draw.integers(97, 99, 4000).astype(np.uint8)
    group = np.sort(draw.integers(0, 40, 900))
    start = draw.integers(0, 3990, 900)
    if broken:  # hashes that say nothing: the bytes decide
        monkeypatch.setattr(suffixdedup, "span_hash", lambda prefix, start, size: np.zeros(len(start), np.uint64))
    order, equal = suffixdedup.verified(data, start, group, suffixdedup.merge_sort(data, start, group, 10), 10)
    text = [data[s : s + 10].tobytes() for s in start]
    want = sorted(range(900), key=lambda i: (group[i], text[i], i))
    assert order.tolist() == want
    assert equal.tolist() == [k > 0 and (group[want[k]], text[want[k]]) == (group[want[k - 1]], text[want[k - 1]]) for k in range(900)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_op12_brute_force(spark):
    path = f"{SF}/documents.parquet"
    t = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    got = sorted(tuple(r) for r in queries.QUERIES["op12_suffix_dedup"](spark, SF).collect())
    assert got == repeats([(r["doc_id"], r["text"]) for r in t], 100)
    assert sum(r[2] for r in got) > 0


def test_columns_with_dots(spark):
    """Names that need quoting, in operators that take names."""
    from pyspark.sql import functions as F

    from gridloom.llm import decontam, licenses, sharding, topk

    df = spark.createDataFrame([(1, "mit license and ten words of a test item that is long enough"), (2, "other")], "`a.id` long, `a.text` string")
    items = spark.createDataFrame([(7, "words of a test item that is long enough indeed")], "`b.id` long, `b.text` string")
    names = dict(id_col="a.id", text_col="a.text")
    assert [r.labels for r in licenses.scan(df, **names).orderBy("doc_id").collect()] == ["mit", ""]
    assert sharding.assign_shards(df, key="a.id", text="a.text").count() == 2
    assert decontam.contamination(df, items, **names, item_id="b.id", item_text="b.text").count() == 2
    assert decontam.matches(df, items, **names, item_id="b.id", item_text="b.text", width=5).select("doc_id", "words").collect() == [(1, 9)]
    assert suffixdedup.suffix_dedup(df, **names).count() == 2
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "`v.id` long, `v.e` array<double>")
    assert [r.vec_id for r in topk.top_k(vectors, F.col("`v.id`") == 1, id_col="v.id", vector_col="v.e").collect()] == [2]
