"""Structured words that hash alike in weak hashes, large components, clashing names, odd inputs of the pipeline, independent recomputations."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam, kernel, langid, linededup, mixing, neardup, quality, tokenids, topk
from tests.llm.test_free import LOW, docs, words


def thue_morse(n):
    a = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in a), "".join("ba"[x] for x in a)


@pytest.mark.parametrize("n", [1024, 4096])
def test_structured_words_stay_apart(spark, n):
    s, t = thue_morse(n)
    h, _ = kernel.word_hashes(*kernel.utf8(pa.array([s, t])))
    assert h[0] != h[1]
    df = docs(spark, [s, t])
    assert {r.doc_id: r.n_removed for r in linededup.line_dedup(df).collect()} == {0: 0, 1: 0}
    got = decontam.contamination(df, spark.createDataFrame([(1, t)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_hit for r in got] == [0, 1]
    assert {(r.doc_id, r.class_id, r.n_links) for r in neardup.jaccard_join(df).collect()} == {(0, 0, 0), (1, 1, 0)}


def test_word_table_compares_bytes(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*thue_morse(1024), "some words", "other words here", ""]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    data, offsets = kernel.utf8(pa.array(texts))

    def check(table):
        flat, n = table.encode(data, offsets)
        ends = np.cumsum(n)
        assert [flat[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == want

    check(tokenids.WordTable(t))
    monkeypatch.setattr(tokenids, "spans_hash", lambda flat, lengths: lengths.astype(np.uint64))  # words of a length collide
    check(tokenids.WordTable(t))


def test_large_components_saturate(spark):
    rows = [(0, [1e10, 1.0]), (1, [1e10, 2.0]), (2, [-1e10, 0.0]), (3, [1e305, 1.0]), (100, [1e200, 0.0]), (4, [1e306, 0.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()}
    most, least = (1 << 63) - 1, -(1 << 63)
    assert [got[0, k] for k in range(1, 5)] == [(1, most), (3, most), (100, most), (2, least)] and (0, 5) not in got  # 4 is not finite 1024-fold


CLASH = ["__q_bytes", "__q_score", "_score", "__ld_key", "_key", "_own", "_held", "_kept", "_nth", "__mix_copies", "_mix_copies", "_mix_n", "_own_id", "row_key", "hash", "size", "fp", "draw"]


def clashing(spark, texts):
    df = docs(spark, texts).select("doc_id", F.col("text").alias("Text"), "lang", "source", "n_chars")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


def test_clashing_names(spark):
    t = "one two three four five six seven"
    df = clashing(spark, [t, t, "other words\nother words", None, ""])
    labels = spark.createDataFrame([(0, 1), (2, 1)], "doc_id long, quality int")
    b = spark.createDataFrame([(1, "zebra")], "item_id long, text string")
    for out in (quality.keep_good(df, labels), neardup.keep_one(df), linededup.deduplicated(df), mixing.mixed_documents(df), decontam.decontaminate(df, b)):
        assert out.columns == df.columns and out.select("_score").distinct().collect() == [(2,)]
    assert neardup.keep_one(df).count() == 4 and decontam.decontaminate(df, b).count() == 5
    assert {r.doc_id: r.Text for r in linededup.deduplicated(df).collect()}[2] == "other words"


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    df = docs(spark, [long, long + " more", "short text"], sources=["a", "a", "a"])
    b = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(110_000, 110_040)))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.contamination(df, b).collect()} == {0: 40, 1: 40, 2: 0}
    assert {r.doc_id: r.class_id for r in neardup.jaccard_join(df).collect()} == {0: 0, 1: 0, 2: 2}
    assert mixing.mix(df).agg(F.sum("taken")).first()[0] == 240_003


def test_mix_of_repeated_ids_is_whole(spark):
    df = docs(spark, [f"{'w ' * (i % 3 + 1)}" for i in range(60)], ids=[i % 4 or None for i in range(60)], sources=["a", "b", "c"] * 20)
    want = mixing.mix(df).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    got = {r.source: r["count"] for r in mixing.mixed_documents(df).groupBy("source").count().collect()}
    assert got == {r.source: r.n for r in want if r.n}


@pytest.mark.parametrize("budget", [150_000, 1_000_003])
def test_large_budgets_stay_proportional(budget):
    lengths, counts = np.array([7, 50, 333, 9001]), np.array([9000, 9000, 3000, 60])
    got = mixing.fit_counts(lengths, counts, budget)
    assert abs(int((got * lengths).sum()) - budget) <= 7 and (np.abs(got[1:] / counts[1:] - budget / (lengths * counts).sum()) < 0.15).all()


def brute_langid(texts, langs, tests):
    """Kernel ridge on the same kernel, straight from its definition: every text is a landmark."""

    def grams(t):
        s = [0 if b < 65 or 91 <= b < 97 or 123 <= b < 128 else (b if b >= 128 else (b | 32)) for b in t.encode()]
        return {tuple(s[i : i + k]) for k in (1, 2, 3) for i in range(len(s) - k + 1)}

    g = [grams(t) for t in texts]
    names = sorted(set(langs))

    def k(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))

    gram = np.array([[k(a, b) for b in g] for a in g])
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    alpha = np.linalg.solve(gram + 1e-3 * np.eye(len(g)), y)
    return [names[int(np.argmax(np.array([k(grams(t), b) for b in g]) @ alpha))] for t in tests]


def test_languages_by_brute_force():
    en, de = "the house and the garden of our friends are where we stay today", "das haus und der garten unserer freunde sind wo wir heute bleiben"
    fr = "la maison et le jardin de nos amis sont l'endroit où nous restons"
    rng = np.random.default_rng(0)

    def some(t, n):
        w = t.split()
        return [" ".join(rng.choice(w, 6)) for _ in range(n)]

    texts, langs = some(en, 12) + some(de, 12) + some(fr, 12), ["en"] * 12 + ["de"] * 12 + ["fr"] * 12
    tests = some(en, 8) + some(de, 8) + some(fr, 8)
    m = langid.fit(texts, langs)
    data, offsets = kernel.utf8(pa.array(tests))
    got = [m.languages[i] for i in m.scores(langid._presence(data, offsets, m.index(), len(m.codes))).argmax(axis=1)]
    assert got == brute_langid(texts, langs, tests) == ["en"] * 8 + ["de"] * 8 + ["fr"] * 8


def test_statistics_by_plain_python():
    rng = np.random.default_rng(1)
    alphabet = list("abC dE1.,!|\n é")
    for _ in range(40):
        t = "".join(rng.choice(alphabet, rng.integers(1, 200)))
        s = dict(zip(quality.STATISTICS, quality.statistics(pa.array([t]))[0], strict=True))
        w, lines = re.findall(kernel.WORD, t), [x for x in t.split("\n") if x]
        low = [x.translate(LOW) for x in w]
        assert s["words"] == len(w) == len(words(t)) and s["lines"] == len(lines)
        size = len(t.encode())
        assert s["upper"] == pytest.approx(sum(x in "CE" for x in t) / size) and s["pipe"] == pytest.approx(t.count("|") / size) and s["digit"] == pytest.approx(t.count("1") / size)
        if w:
            assert s["distinct"] == pytest.approx(len(set(low)) / len(w))


def test_lasso_is_optimal():
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (300, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.6) | (x[:, 5] < 0.2)).astype(float)
    m = quality.fit_rules(x, y, trees=8, turns=4000, penalty=0.01)
    a = np.column_stack([r.holds(x).astype(float) for r, _ in m.rules])
    spread, w = a.std(axis=0), np.array([v for _, v in m.rules])
    grad = (a / spread).T @ (m.score(x) - y) / len(y)
    assert np.abs(grad + 0.01 * np.sign(w)).max() < 2e-3 and abs((m.score(x) - y).mean()) < 1e-3


def test_ties_are_defined(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0)] * 5, "doc_id long, quality int")
    r = quality.classify(docs(spark, ["same text"] * 4), labels).collect()
    assert len({x.score for x in r}) == 1
    ids = [0, 1, 3, 5, 7, 9]
    r = langid.identify(docs(spark, ["same text"] * 6, ids=ids, langs=["b", "a"] * 3)).collect()
    assert {x.lang_pred for x in r} <= {"a", "b"} and len({x.lang_pred for x in r}) == 1


def test_pipeline_of_odd_tables(spark, tmp_path):
    c = pytest.importorskip("corpus_pipeline")
    t = " ".join(f"good words number {i} of a clean text" for i in range(9))
    rows = [(0, t, "en", "a", 1, 5), (0, t, "en", "a", 1, 5), (None, None, None, None, None, None), (1, "", "en", None, 0, 5), (2, t + " zebra", None, "b", 1, 5), (3, "x " * 40_000, "en", "b", 1, 5)]
    for name, some in (("odd", rows), ("none", [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long, hash int").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "never seen item")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        got = c.run(spark, sf).collect()
        assert (not got) if not some else (got and {r.doc_id for r in got} <= {0, 1, 2, 3, None} and sorted(r.start for r in got)[0] == 0)
