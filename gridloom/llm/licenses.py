"""Operator 7: license scan, DataFrame functions only.

Two scans of whole texts. Phrases: places where the words of a known phrase stand one after another. Templates: text blocks
(runs of words, inside a line or across line ends: up to the template's words / threshold, repeats counted, from each of its
words on) that contain at least `threshold` of a license notice's distinct words, as an exact set-similarity join. A block is
never longer than that, so common words that lie scattered over a long line make no notice. The words of
the templates are counted over the whole corpus and ordered from the rarest; of a template of t words that needs a shared ones,
the first t - a + 1 are its prefix, and so for a block. A run is formed only where a of the template's words stand within
it, repeats counted. A block is compared with a template only if their prefixes share a
word (prefix filter), the block holds a template words at all (length filter), and the places of the first shared word leave
room for a shared ones (positional filter); survivors are verified. Templates are few and compiled into the plan, so texts
are neither shuffled nor copied.

Words: A-Z lower-cased, runs of digits, letters and non-ASCII characters. Defined cases: a null text is empty: no words, null
places, empty labels, score 0; rows that repeat or have null ids are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.kernel import LOWER, UPPER, WORD, WORD_LOWER

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices that licenses ask to be put into files.
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "gpl": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.8

_SEP, _IN = WORD.replace("[^", "["), WORD[:-1]


def _phrase_pattern(phrases: list[str]) -> str:
    return f"(?i)(?<!{_IN})(?:{'|'.join(_SEP.join(p.split()) for p in phrases)})(?!{_IN})"


def _count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    import re

    return {k: sorted(set(re.findall(WORD_LOWER, v.translate(str.maketrans(UPPER, LOWER))))) for k, v in templates.items()}


def run_lengths(templates: dict[str, str], threshold: float = THRESHOLD) -> dict[str, int]:
    """Words of a run across line ends, by template: a wrapped notice may have as many words added as may be missing."""
    import re

    return {k: math.ceil(len(re.findall(WORD_LOWER, v.translate(str.maketrans(UPPER, LOWER)))) / threshold - 1e-9) for k, v in templates.items()}


def word_counts(df: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """How often each of a bounded list of words stands in all texts; the driver gets one row per word."""
    tokens = df.select(F.explode(F.split(F.lower(F.col(f"`{text_col}`").cast("string")), WORD_LOWER.replace("[^", "["))).alias("w"))
    return {r["w"]: r["n"] for r in tokens.filter(F.col("w").isin(words)).groupBy("w").agg(F.count("*").alias("n")).collect()}


def _containment(template: list[int], prefix: list[int], need: int):
    """A function of a block's ranks: the template's share in it where the filters and the threshold let it through, else 0."""
    t, head, n = F.lit(template), F.lit(prefix), len(template)

    def of(b: Column) -> Column:
        shared = F.array_intersect(F.slice(b, 1, F.greatest(F.size(b) - need + 1, F.lit(0))), head)
        first = F.array_min(shared)
        room = 1 + F.least(n - F.array_position(t, first), F.size(b) - F.array_position(b, first))
        overlap = F.size(F.array_intersect(b, t))
        met = (F.size(b) >= need) & (F.size(shared) > 0) & F.coalesce(room >= need, F.lit(False))
        return F.when(met & (overlap >= need), overlap / F.lit(n)).otherwise(0.0)

    return of


def _best_run(template: list[int], prefix: list[int], need: int, length: int):
    """A function of a text's words (at, rank): (share, -place of the first word) of the best block of `length` words, the first of equals.

    A best run can be moved to start at one of the template's words; one is formed if the need-th such word lies within it.
    """
    share = _containment(template, prefix, need)
    none = F.struct(F.lit(0.0).alias("share"), F.lit(0).alias("back"))

    def of(words: Column) -> Column:
        own = F.filter(words, lambda w: F.array_contains(F.lit(template), w["rank"]))

        def best(hits: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(hits) - need), lambda j: F.get(hits, j + need - 1)["at"] < F.get(hits, j)["at"] + length)

            def run(j: Column) -> Column:
                near = F.filter(F.slice(hits, j + 1, F.lit(length)), lambda w: w["at"] < F.get(hits, j)["at"] + length)
                ranks = F.array_sort(F.array_distinct(F.transform(near, lambda w: w["rank"])))
                return F.struct(ranks.alias("ranks"), (-F.get(hits, j)["at"]).alias("back"))

            found = F.transform(F.transform(starts, run), lambda b: F.struct(share(b["ranks"]).alias("share"), b["back"].alias("back")))
            return F.when(F.size(hits) >= need, F.coalesce(F.array_max(found), none)).otherwise(none)

        # a one-element array binds the words to a variable, so that they are filtered once
        return F.get(F.transform(F.array(own), best), F.lit(0))

    return of


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    The score is 1 where a phrase stands, else the largest containment of a template that meets the threshold, else 0. blocks:
    of each template found, the best block's share, first word and length.
    """
    sets = template_words(templates)
    vocabulary = sorted(set().union(*sets.values()))
    counts = word_counts(df, vocabulary, text_col)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    ranked = {k: sorted(rank[w] for w in ws) for k, ws in sets.items()}
    need = {k: math.ceil(threshold * len(ws) - 1e-9) for k, ws in sets.items()}
    prefix = {k: r[: len(r) - need[k] + 1] for k, r in ranked.items()}
    rare = sorted({order[i - 1] for p in prefix.values() for i in p})
    words_of_phrases = sorted({p.split()[0] for p in phrases})

    base = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # Lower-casing beyond A-Z changes no boundary of words and only adds to what these gates let through.
    tokens = F.split(F.lower("text"), WORD_LOWER.replace("[^", "["))
    base = base.withColumn("tokens", tokens).select(
        "doc_id",
        "text",
        (F.size("tokens") - F.when(F.col("tokens")[0] == "", 1).otherwise(0) - F.when((F.size("tokens") > 1) & (F.element_at("tokens", -1) == ""), 1).otherwise(0)).cast("long").alias("n_words"),
        F.arrays_overlap("tokens", F.lit(words_of_phrases)).alias("may_phrase"),
        F.arrays_overlap("tokens", F.lit(rare)).alias("may_block"),
    )
    every = _phrase_pattern(list(phrases))
    base = base.withColumn("n_base", F.when(F.col("may_phrase"), F.regexp_count("text", F.lit(every))).otherwise(0).cast("long"))
    found = F.col("n_base") > 0
    before_first = F.expr("substring(text, 1, regexp_instr(text, pattern) - 1)")
    base = base.withColumn("pattern", F.lit(every))
    base = base.withColumn("first_word", F.when(found, _count_words(before_first)))
    base = base.withColumn("last_word", F.when(found, _count_words(F.regexp_extract("text", f"(?s)^(.*){every}", 1))))
    by_label: dict[str, list[str]] = {}
    for p, label in phrases.items():
        by_label.setdefault(label, []).append(p)
    marks = F.array(*(F.when(F.col("text").rlike(_phrase_pattern(ps)), F.lit(label)) for label, ps in sorted(by_label.items())))
    base = base.withColumn("base", F.when(found, F.array_compact(marks)).otherwise(F.array().cast("array<string>")))

    # places and ranks of all template words, of texts that hold a prefix word
    every_word = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD_LOWER), F.lit(0))
    placed = F.filter(F.transform(every_word, lambda w, i: F.struct(i.alias("at"), F.array_position(F.lit(order), w).cast("int").alias("rank"))), lambda w: w["rank"] > 0)
    base = base.withColumn("words", F.when(F.col("may_block"), placed))
    length = run_lengths(templates, threshold)
    held = {k: _best_run(r, prefix[k], need[k], length[k])(F.col("words")) for k, r in ranked.items()}
    base = base.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", *(F.coalesce(c["share"], F.lit(0.0)).alias(f"t_{k}") for k, c in held.items()), *(c["back"].alias(f"b_{k}") for k, c in held.items()))
    own = F.array_compact(F.array(*(F.when(F.col(f"`t_{k}`") > 0, F.lit(k)) for k in held)))
    block = lambda k: F.struct(F.lit(k).alias("label"), F.col(f"`t_{k}`").alias("share"), (-F.col(f"`b_{k}`")).cast("long").alias("first_word"), F.lit(length[k]).cast("long").alias("n_words"))
    blocks = F.array_compact(F.array(*(F.when(F.col(f"`t_{k}`") > 0, block(k)) for k in held)))
    best = F.greatest(*(F.col(f"`t_{k}`") for k in held))
    return base.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).cast("double").alias("score"),
        blocks.alias("blocks"),
    )
