"""Operators 1, 7 and 9 (and all that SQL can express): SQL on the driver's tables, brute force and odd inputs on small ones."""

import os
import random
import re
import textwrap
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import kernel, licenses, linededup, sharding
from gridloom.llm.oracles import ORACLES
from gridloom.llm.queries import QUERIES
from tests.compare import same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score string, codes string"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", "w") for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SF)


def jump(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b, key = j, (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, 2, 12345, -1, -(1 << 63), (1 << 63) - 1]
    for n in (1, 2, 8, 9, 100, 1000):
        got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(sharding.jump_hash(F.col("k"), n)).collect()]
        assert got == [jump(k % (1 << 64), n) for k in keys]


def test_shards_move_only_into_the_new_one(spark):
    rows = sharding.assign_shards(docs(spark, [f"t{i}" for i in range(500)])).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and 20 < sum(r.grown_shard == 8 for r in rows) < 100
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_of_odd_rows(spark):
    rows = sharding.assign_shards(docs(spark, [None, "", "é", "same", "same", "x" * 100_000], [None, None, 3, 4, 4, 5])).collect()
    assert len(rows) == 6 and {r.size for r in rows if r.doc_id is None} == {1} and next(r for r in rows if r.doc_id == 3).size == 3
    assert all(r.text_crc32 == zlib.crc32("same".encode()) for r in rows if r.doc_id == 4)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.assign_shards(docs(spark, [])).count() == 0


def test_written_shards(spark, tmp_path):
    sharding.write_shards(docs(spark, ["a", "b", "c"]).drop("shard"), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 3


def brute_lines(texts, threshold=0.8):
    seen, order, gone = {}, [], {i: set() for i in range(len(texts))}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            w = frozenset(re.findall(kernel.WORD_LOWER, line.translate(str.maketrans(kernel.UPPER, kernel.LOWER))))
            if not w:
                continue
            if w in seen or any(len(w & o) / len(w | o) >= threshold for o in order):
                gone[i].add(k)
            if w not in seen:
                seen[w] = 1
                order.append(w)
    return gone


def test_lines_by_brute_force(spark):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    for line in list(lines):
        for _ in range(3):
            w = line.split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            lines.append(" ".join(w))
    lines += ["same words here again and more"] * 30 + ["", "  ", "once"]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)]
    want = brute_lines(texts)
    got = linededup.line_dedup(docs(spark, texts)).collect()
    assert {r.doc_id: set(r.removed_lines) for r in got} == want and sum(map(len, want.values())) > 60


def test_lines_of_odd_rows(spark):
    texts = [None, "", "a b c d\n\na b c d", "a b c d", "é ü\t", "long " * 5000]
    r = {x.doc_id: x for x in linededup.line_dedup(docs(spark, texts)).collect()}
    assert r[0].n_lines == 0 and r[1].n_lines == 1 and r[1].n_removed == 0 and r[2].removed_lines == [2] and r[3].removed_lines == [0] and r[4].n_removed == 0
    twice = linededup.line_dedup(docs(spark, ["q w e r", "q w e r"], [7, 7])).collect()
    assert sorted(x.n_removed for x in twice) == [0, 1]
    assert linededup.line_dedup(docs(spark, [])).count() == 0
    out = linededup.deduplicated(docs(spark, texts)).orderBy("doc_id")
    assert out.columns == docs(spark, []).columns and [x.text for x in out.collect()][2:4] == ["a b c d\n", ""]


def test_licenses_by_hand(spark):
    t = ["Under the GNU-General  public LICENSE, apache license!", "omit license submit-license", None, "", "x\n" + licenses.TEMPLATES["mpl"].upper().replace(" FORM", ""), "cc by", "é" * 10 + " mit license", "v. the " * 4000]
    r = {x.doc_id: x for x in licenses.scan(docs(spark, t)).collect()}
    assert (r[0].n_base, r[0].first_word, r[0].last_word, r[0].base_labels, r[0].score) == (2, 2, 6, "apache,gpl", 1.0)
    assert r[1].n_base == 0 and r[1].first_word is None and r[1].n_words == 4 and r[1].labels == ""
    assert (r[2].n_words, r[2].score, r[3].labels) == (0, 0.0, "")
    assert r[4].labels == "mpl" and 0.8 <= r[4].score < 1.0 and r[4].base_labels == ""
    assert r[5].labels == "cc-by" and r[6].first_word == 1 and r[7].labels == ""
    assert licenses.scan(docs(spark, [])).count() == 0


def test_licenses_ignore_case_of_ascii_only(spark):
    r = licenses.scan(docs(spark, ["mit licenſe", "Kapache license", "MIT\nLICENSE"])).orderBy("doc_id").collect()
    assert [x.n_base for x in r] == [0, 0, 1]


def wrapped(text, width):
    return "\n".join(f" * {line}" for line in textwrap.wrap(text, width))


def brute_licenses(text):
    """(labels without phrases, score) by all runs of words."""
    sets, own = licenses.template_words(licenses.TEMPLATES), {}
    w = re.findall(kernel.WORD_LOWER, text.translate(str.maketrans(kernel.UPPER, kernel.LOWER)))
    for name, t in sets.items():
        n = licenses.run_lengths(licenses.TEMPLATES)[name]
        share = max(len(set(t) & set(b)) / len(t) for b in (w[i : i + n] for i in range(max(1, len(w)))))
        own |= {name: share} if share >= licenses.THRESHOLD else {}
    return ",".join(sorted(own)), max(own.values(), default=0.0)


@pytest.mark.parametrize("width", [30, 55, 70])
def test_wrapped_notices(spark, width):
    names = sorted(licenses.TEMPLATES)
    t = ["some words before\n" + wrapped(licenses.TEMPLATES[k] + " and more text that goes on after the notice of the license itself", width) for k in names]
    for k, r in zip(names, licenses.scan(docs(spark, t)).orderBy("doc_id").collect(), strict=True):
        assert k in r.labels.split(",") and r.score == 1.0, k


def test_published_wrapped_notices(spark):
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software"
    r = licenses.scan(docs(spark, [mpl, mit])).orderBy("doc_id").collect()
    assert [(x.labels, x.score, x.n_base) for x in r] == [("mpl", 1.0, 0), ("mit-notice", 1.0, 0)]


def test_wrapped_notices_by_brute_force(spark):
    rng, texts = random.Random(7), []
    for _ in range(150):
        w = [x for k in rng.sample(sorted(licenses.TEMPLATES), 2) for x in licenses.TEMPLATES[k].split()]
        missing = rng.uniform(0.0, 0.5)
        w = [x for x in w if rng.random() > missing]
        for _ in range(rng.randrange(8)):
            w.insert(rng.randrange(len(w)), rng.choice(["the", "of", "zebra", "software", "v"]))
        texts.append("".join(x + rng.choice([" ", " ", " ", " ", "\n"]) for x in w))
    got = licenses.scan(docs(spark, texts), phrases={"no such phrase": "none"}).orderBy("doc_id").collect()
    want = [brute_licenses(t) for t in texts]
    assert [(r.labels, r.score) for r in got] == [(a, pytest.approx(b)) for a, b in want] and 20 < sum(b == 0 for _, b in want) < 130


def test_scattered_words_are_no_notice(spark):
    common = ["this", "is", "free", "and", "software", "into", "the", "public", "released"]
    long_line = " ".join(w + " filler" * 400 for w in common)
    inside = "x " * 3000 + licenses.TEMPLATES["mpl"].lower() + " y" * 3000
    t = [long_line, long_line.replace(" filler", "\nfiller"), inside, inside.replace("source", "source one two three four five six seven")]
    got = licenses.scan(docs(spark, t), phrases={"no such phrase": "none"}).orderBy("doc_id").collect()
    assert [(r.labels, r.score) for r in got] == [(a, pytest.approx(b)) for a, b in map(brute_licenses, t)]
    assert [r.labels for r in got][:3] == ["", "", "mpl"]
    assert [(b.label, b.first_word, b.share) for b in got[2].blocks] == [("mpl", 3000, 1.0)] and not got[0].blocks


def test_stepped_ids_use_all_blocks(spark):
    df = spark.range(2000).selectExpr("id * 256 as doc_id", "'a' as text")
    block = F.shiftrightunsigned(sharding._times(F.col("doc_id"), sharding.BLOCK_MULTIPLIER, 0), 56)
    assert df.select(block).distinct().count() == 256
    got = sharding.assign_shards(df).collect()
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
