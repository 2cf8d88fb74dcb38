"""Operators 2 to 6, 8 and 10 against brute force, round trips and held-out labels; odd inputs."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam, kernel, langid, mixing, neardup, quality, tokenids, topk, wavelet
from gridloom.llm.components import components

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
LOW = str.maketrans(kernel.UPPER, kernel.LOWER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n string, fp string, score string, held_out string"


def words(t):
    return re.findall(kernel.WORD_LOWER, (t or "").translate(LOW))


def docs(spark, texts, ids=None, langs=None, sources=None):
    n = len(texts)
    ids, langs, sources = ids or list(range(n)), langs or [None] * n, sources or [None] * n
    return spark.createDataFrame([(ids[i], texts[i], langs[i], sources[i], None, "a", "b", "c", "d", "e") for i in range(n)], SCHEMA)


def test_word_hashes_equal_words():
    texts = ["", "Abc abc", None, "!!", "x1 é É", "a" * 700, "b c d"]
    h, n = kernel.word_hashes(*kernel.utf8(pa.array(texts)), most=8)
    assert list(n) == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(flat, h.tolist(), strict=True)))


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a int, b int")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


# 2 -----------------------------------------------------------------------------------------------------------------------


def brute_contamination(texts, items, width=10):
    grams = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            grams.setdefault(tuple(w[s : s + width]), set()).add("null" if i is None else str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for m in {len(g) for g in grams}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in grams:
                    hit |= set(range(s, s + m))
                    found |= grams[tuple(w[s : s + m])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_words", [1 << 19, 16])
def test_contamination(spark, block_words):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 24)))) for i in range(12)] + [(5, "alone Here"), (None, "never seen"), (13, None), (14, "--")]
    texts = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(20)] + [None, "", "w1", f"start {items[3][1].upper()} end", "x\nALONE,here y"] + ["same alone here"] * 3
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs(spark, texts), b, block_words=block_words).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == brute_contamination(texts, items)
    every = decontam.matches(docs(spark, texts), b, block_words=block_words).collect()
    for r in got:
        best = min(((-m.words, m.item_id, m.word_start, m.item_word_start) for m in every if m.doc_id == r.doc_id), default=(0, None, None, None))
        assert (-r.longest_words, r.longest_item, r.longest_start, r.longest_item_start) == best
    kept = decontam.decontaminate(docs(spark, texts), b, block_words=block_words)
    assert sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r in got if not r.contaminated] and kept.columns == docs(spark, []).columns


def test_contamination_of_nothing(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert not decontam.contamination(docs(spark, ["a b"]), b).first().contaminated
    assert decontam.contamination(docs(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    r = rng.integers(0, 3, 300)
    order = decontam.suffix_array(r, 10)
    keys = [tuple(r[i : i + 10]) + (-1,) * (10 - len(r[i : i + 10])) for i in order]
    assert sorted(order.tolist()) == list(range(300)) and all(a[:10] <= b[:10] or a[0] == 0 for a, b in zip(keys, keys[1:], strict=False))


@pytest.mark.parametrize(("block_words", "pairs"), [(1 << 19, 1 << 20), (16, 1)])
def test_distributed_matches(spark, block_words, pairs):
    rng = random.Random(3)
    vocab = ["a", "b", "c"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 14)))) for i in range(10)] + [(20, "a " * 9), (21, None), (22, "--")]
    texts = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(6)] + [None, "", "a " * 25, f"x {items[4][1].upper()}, y"] * 2
    got = decontam.matches(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), width=4, block_words=block_words, pairs=pairs).collect()
    want = []
    for d, t in enumerate(texts):
        for i, item in items:
            x, y = words(t), words(item)
            m = min(4, len(y))
            for p in range(len(x)):
                for q in range(len(y)):
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    if n >= m and not (p and q and x[p - 1] == y[q - 1]):
                        want.append((d, p, str(i), q, n))
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 100


# 3 -----------------------------------------------------------------------------------------------------------------------


def test_targets_reshare():
    t = mixing.targets({"a": 10, "b": 1000, "c": 10, None: 50})
    assert t["a"] == 30 and sum(t.values()) == pytest.approx(1070) and all(t[k] <= 3 * s + 1e-9 for k, s in {"a": 10, "b": 1000, "c": 10, None: 50}.items())
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


@pytest.mark.parametrize("seed", range(6))
def test_fit_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(rng.integers(1, 40, 6)), None
    counts = rng.integers(1, 4, len(lengths))
    budget = int(rng.integers(1, (lengths * counts).sum()))
    part = np.floor(counts * (budget / (lengths * counts).sum())).astype(int)
    reach = {int((part * lengths).sum())}
    for n, c in zip(lengths.tolist(), (counts - part).tolist(), strict=True):
        reach = {x + k * n for x in reach for k in range(c + 1)}
    got = mixing.fit_counts(lengths, counts, budget)
    assert (got >= part).all() and (got <= counts).all()
    total = int((got * lengths).sum())
    assert total in reach and abs(total - budget) == min(abs(x - budget) for x in reach)


@pytest.mark.parametrize("lengths, counts, budget, total", [([10], [1], 9.0, 10), ([10], [1], 5.0, 0), ([200_000, 300_000], [1, 1], 190_000, 200_000), ([200_000], [1], 90_000, 0), ([10], [500], 785.7, 790), ([200], [1], 114.3, 200), ([3, 5], [0, 2], 6.2, 5)])
def test_targets_from_either_side(lengths, counts, budget, total):
    assert int((mixing.fit_counts(np.array(lengths), np.array(counts), budget) * np.array(lengths)).sum()) == total


def test_mix(spark):
    rng = random.Random(2)
    texts = ["w " * rng.randint(1, 60) for _ in range(400)] + [None, "", "one\t two\n"]
    sources = [rng.choice(["a", "b", "c", "d"]) for _ in range(400)] + [None, "a", None]
    df = docs(spark, texts, sources=sources)
    rows = mixing.mix(df, split=16).collect()
    sizes = {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").split()) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = mixing.targets(sizes)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 3
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), split=16).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    out = mixing.mixed_documents(df)
    per = {r.doc_id: r.taken // r.size if r.size else 1 for r in rows}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in per.items() if v} and out.columns == df.columns


def test_mix_of_repeated_rows_and_nothing(spark):
    df = docs(spark, ["a b c"] * 5, ids=[1, 1, 1, 2, None], sources=["s"] * 5)
    assert mixing.mix(df).agg(F.sum("taken")).first()[0] == 15 and mixing.mixed_documents(df).count() == 5
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mixed_documents(docs(spark, [])).count() == 0


# 4 -----------------------------------------------------------------------------------------------------------------------


def brute_join(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    return [(find(i), links[i]) for i in range(len(texts))]


def near_texts():
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(80, 160))]
        for k in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(k // 2):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    return texts + [texts[0], texts[0].upper(), "tiny text", "Tiny, text!", None, "", "!!", None]


@pytest.mark.parametrize("block, most_blocks", [(1024, None), (3, None), (3, 1)])
def test_join(spark, monkeypatch, block, most_blocks):
    monkeypatch.setattr(neardup, "BLOCK_SETS", block)
    texts = near_texts()
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.jaccard_join(docs(spark, texts), most_blocks=most_blocks).collect()}
    assert got == dict(enumerate(brute_join(texts)))
    kept = neardup.keep_one(docs(spark, texts), most_blocks=most_blocks)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in got.values()}) and kept.columns == docs(spark, []).columns


def test_join_of_many_near_equal_texts(spark, monkeypatch):
    """Every pair is similar: no link is lost or counted twice, whichever way the component is dealt."""
    rng, base, n = random.Random(8), [f"w{i}" for i in range(200)], 1200
    texts = []
    for k in range(n):
        w = list(base)
        w[rng.randrange(200)] = f"new{k}"
        texts.append(" ".join(w))
    monkeypatch.setattr(neardup, "BLOCK_SETS", 250)
    for most_blocks in (None, 2):
        got = neardup.jaccard_join(docs(spark, texts), most_blocks=most_blocks).collect()
        assert {(r.class_id, r.n_links) for r in got} == {(0, n - 1)} and len(got) == n


def test_join_of_repeated_rows_and_nulls(spark):
    t = "one two three four five six seven"
    df = docs(spark, [t, t, t, "other words entirely here now yes", None], ids=[3, 3, None, 4, None])
    r = [(x.doc_id, x.class_id, x.n_links) for x in neardup.jaccard_join(df).collect()]
    assert sorted(r, key=str) == sorted([(3, 3, 2), (3, 3, 2), (None, 3, 2), (4, 4, 0), (None, None, 0)], key=str)
    assert sorted((x.doc_id for x in neardup.keep_one(df).collect()), key=str) == [3, 4, None]
    assert neardup.jaccard_join(docs(spark, [])).count() == 0 and neardup.keep_one(docs(spark, [])).count() == 0


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.999), (0.5, 0.9)):
        b, r = neardup.bands_for(t, recall)
        assert b * r <= neardup.HASHES and 1 - (1 - t**r) ** b >= recall


# 5, 6 --------------------------------------------------------------------------------------------------------------------


@here
def test_languages_held_out(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert {r.doc_id for r in test} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark):
    t = ["the house is here", "das haus ist hier", None, "", "123 !!", "the " * 20000, "le", "the house is here"]
    r = {x.doc_id: x for x in langid.identify(docs(spark, t, ids=[0, 1, 2, 3, 5, 8, 9, 12], langs=["en", "de", "en", None, "fr", "en", None, "en"])).collect()}
    assert all(r[i].lang_pred == "und" and r[i].score == 0 for i in (2, 3, 5)) and r[8].lang_pred in ("en", "de")
    assert {x.lang_pred for x in langid.identify(docs(spark, ["a", "b"])).collect()} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0


def test_language_of_long_texts_only(spark):
    t = ["the house is here and there"] * 8 + ["das haus ist hier und dort " * 1000, "wo ist das haus " * 2000, "das ist hier", "the house"]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][: len(t)]
    r = langid.identify(docs(spark, t, ids=ids, langs=["en"] * 8 + ["de", "de", None, None])).collect()
    assert [x.lang_pred for x in sorted(r, key=lambda x: x.doc_id)] == ["en"] * 8 + ["de", "de", "de", "en"]


def test_learning_keeps_to_its_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, langs: seen.extend(zip(langs, texts, strict=True)))
    monkeypatch.setattr(langid, "TOTAL", 200)
    t = ["a" * 300, "b" * 400, "c" * 30, "d" * 60, "e" * 30, "f" * 90] * 2
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:6] * 2
    langid.train(docs(spark, t, ids=ids, langs=["x", "x", "y", "y", "y", "y"] * 2), max_bytes=50)
    assert sorted(seen) == [("x", "a" * 300), ("y", "c" * 30), ("y", "e" * 30)]


def test_grams_of_a_language_with_few_landmarks():
    rng = random.Random(5)
    many = ["".join(rng.choice("abcdefghij") for _ in range(2000)) for _ in range(20)]
    m = langid.fit([*many, "xyz zyx xxyy"], ["a"] * 20 + ["b"], most_grams=40)
    index, few = m.index(), langid.utf8(pa.array(["zyx xyz"]))
    assert len(m.codes) == 40 and m.languages[m.scores(langid._presence(*few, index, 40)).argmax()] == "b" and langid._presence(*few, index, 40).sum() > 5


@here
def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01") if os.path.isdir(SF.replace("0.001", "0.01")) else SF
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in test) / len(test) > 0.95 and all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_rules_equal_their_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (400, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.6)).astype(float)
    m = quality.fit_rules(x, y, trees=20)
    assert 0 < len(m.rules) < 200 and ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{quality.PREFIX}{s} double" for s in quality.STATISTICS))
    assert [r[0] for r in df.select(m.column()).collect()] == pytest.approx(m.score(x[:50]).tolist())


def test_quality_of_odd_rows(spark):
    df = docs(spark, [None, "", "fine text here", "x " * 60000, "fine text here"])
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, None), (99, 0), (None, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(df, labels).collect())
    none = quality.classify(df, labels.limit(0)).collect()
    assert len(none) == 5 and {r.score for r in none} == {0.5}
    assert quality.classify(docs(spark, []), labels).count() == 0 and quality.keep_good(df, labels).columns == df.columns


def test_statistics_by_hand():
    s = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["Ab ab!\nAb ab!\nx|y", None]))[0], strict=True))
    assert s["words"] == 6 and s["lines"] == 3 and s["line_repeats"] == pytest.approx(1 / 3) and s["distinct"] == pytest.approx(3 / 6) and s["pipe"] == pytest.approx(1 / 17) and s["stutter"] == pytest.approx(3 / 6)


# 8 -----------------------------------------------------------------------------------------------------------------------


def brute_topk(rows, k=10):
    ok = [(i, [int(np.floor(1024 * float(v))) for v in e]) for i, e in rows if e is not None and all(v is not None and np.isfinite(v) for v in e)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q is None or q % 100:
            continue
        s = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), c) for m, (c, b) in enumerate(ok) if m != n and len(a) == len(b)), key=lambda t: (t[0], t[1] is None, t[1] or 0))
        out += [(q, r + 1, c, -v) for r, (v, c) in enumerate(s[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4096, 2])
def test_topk(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=9)]) for i in range(260)]
    rows += [(300, None), (400, [1.0, None] + [0.0] * 7), (500, [float("nan")] + [0.0] * 8), (600, [float("inf")] * 9), (200, rows[200][1]), (261, rows[100][1]), (700, [1.0, 2.0]), (701, [2.0, 1.0]), (800, []), (100, rows[7][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(i, e, 0, "r", "s") for i, e in rows], "vec_id long, embedding array<double>, label int, rank string, score string").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, block=block).collect()
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=str) == brute_topk(rows)


def test_topk_of_few_and_none(spark):
    s = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], s), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([], s), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], s), F.col("vec_id") % 100 == 0).first().score == 2048 * 1024


def test_bounds_hold():
    x = np.floor(np.random.default_rng(0).normal(size=(30, 10)) * 1024)
    for s in topk.LEVELS:
        t = topk._statistics(x, s)
        assert (t @ t.T >= x @ x.T - 1e-3).all()


# 10 ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 2048, 2049, 5000])
def test_wavelet_round_trip(n):
    a = np.random.default_rng(n).integers(0, 300, n).astype(np.uint16)
    p, r, z = wavelet.build(a, 16)
    assert (wavelet.decode(n, p, z) == a).all()
    w = wavelet.WaveletMatrix(n, p, r, z)
    for i in range(0, n, 101):
        assert w.access(i) == a[i] and w.rank(int(a[i]), i) == (a[:i] == a[i]).sum()
    for c in set(a[:4].tolist()):
        assert w.count(c) == (a == c).sum() and w.positions(c) == np.flatnonzero(a == c).tolist()
    assert w.count(999) == 0


def test_token_files(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = ["Hello, world!", None, "", "it's 42.5... <|endoftext|> a<|b|>", "İstanbul ß é 한글 ﬁ", "x  y\t\nz", "word. " * 3000, "<|ENDOFTEXT|>", "same", "same"]
    ids = [5, 4, 3, 2, 1, 0, 9, 8, 7, 7]
    df = docs(spark, texts, ids=ids)
    tokenids.write_token_files(df, f"file://{tmp_path}/t", path)
    rows = sorted(tokenids.read_token_files(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    t, start, flat = Tokenizer.from_file(path), 0, []
    for row, (i, text) in zip(rows, sorted(zip(ids, texts, strict=True), key=lambda x: x[0]), strict=True):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start, flat = start + len(want), flat + want
    shards = tokenids.open_shards(spark, f"file://{tmp_path}/t")
    assert [w.access(i) for _, _, w in shards for i in range(w.n)][:50] == flat[:50] and sum(w.count(1) for _, _, w in shards) == 10


def test_token_files_of_nothing(spark):
    P = pytest.importorskip("public_tokenizers")
    assert tokenids.token_ids(docs(spark, []), P.path("word_bpe_49k.json")).count() == 0
    r = tokenids.token_ids(docs(spark, ["a", "b"], ids=[None, 1]), P.path("word_bpe_49k.json")).collect()
    assert {x.doc_id: x.start for x in r} == {None: 0, 1: 2}


# pipeline ----------------------------------------------------------------------------------------------------------------


@here
def test_pipeline(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality_filter", "near_duplicates", "decontamination", "mixture", "token_files"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in start.collect()}
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    good = {r.doc_id for r in c.quality_filter(spark, start, SF).collect()}
    order = sorted(good)
    classes = brute_join([texts[i] for i in order])
    one = {order[k] for k, _ in classes}
    clean = {i for i, r in zip(sorted(one), brute_contamination([texts[i] for i in sorted(one)], [(x.item_id, x.text) for x in b.collect()]), strict=True) if not r[4]}
    left = start.filter(F.col("doc_id").isin(*clean))
    mixed = sorted(r.doc_id for r in c.mixture(spark, left, SF).collect())
    rows = c.run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == mixed and rows[0].asDict().keys() == {"doc_id", "start", "n_tokens", "ids_crc32"}
    assert start.columns == c.near_duplicates(spark, left, SF).columns
