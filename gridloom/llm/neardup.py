"""Operator 4: n-gram Jaccard join by MinHash banding.

Sets: the distinct runs of five words of a whole text (a shorter text that has words is one run). Texts with equal sets are
one set with a multiplicity. Each set has rows * bands minimum hashes; band and row numbers are chosen so that sets at the
threshold share a band with the target recall. Band hashes are shuffled; sets that share one are candidates, and candidates
are verified on their full sets.

Pairs are never rows. Each bucket links its members to its smallest member; components of those links hold all candidate
pairs. Components are dealt to tasks whole, or, beyond a size, as all pairs of blocks of bounded size, where the texts'
sets are compared and each set's links are counted. Where a component has more blocks than there are bands, its buckets are dealt
out instead (in blocks too, if need be), so a text is sent once a band and not once a block; a pair counts in the first band that
it shares. Components of verified links are the classes.

Defined cases: a null text, or one without words, is its own class and links nothing; equal rows are copies and link each
other; a null id counts as a document, and a class of null ids only has a null class_id; an empty table gives an empty
result; other columns are ignored by the join and kept by the filter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.kernel import bounded_batches, free_name, give_back, row_key, slices, splitmix, tidy, utf8, windows, word_hashes
from gridloom.session import written

WIDTH, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9995, 64
#: Sets of small components that are compared together; sets and set elements in a block of a large one; rows up to which a
#: table is broadcast (about 100 bytes each).
BIN_SETS, BLOCK_SETS, BLOCK_ELEMENTS, BROADCAST_ROWS = 512, 8192, 1 << 21, 300_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band that reach the recall at the threshold with at most `most` hashes."""
    for rows in range(16, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches the recall")


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, sorted within rows, and their numbers."""
    words, counts = word_hashes(data, offsets)
    grams, row, _ = windows(words, counts, width)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.bincount(row[new], minlength=len(counts))


def fingerprints(grams: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """16 bytes that depend on the set alone; None for an empty set."""
    live = np.flatnonzero(counts)
    out: list[bytes | None] = [None] * len(counts)
    if len(live):
        starts = (np.cumsum(counts) - counts)[live]
        one = np.add.reduceat(splitmix(grams ^ np.uint64(0x5851F42D4C957F2D)), starts)
        two = np.add.reduceat(splitmix(grams ^ np.uint64(0x14057B7EF767814F)), starts)
        for i, x, y in zip(live.tolist(), one.tolist(), two.tolist(), strict=True):
            out[i] = x.to_bytes(8, "big") + y.to_bytes(8, "big")
    return out


def band_hashes(grams: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(non-empty rows x bands) hashes of `rows` minimum hashes each."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(starts), bands), np.uint64)
    if len(starts):
        for b in range(bands):
            for r in range(rows):
                k = b * rows + r
                x = (grams ^ splitmix(2 * k + 1)) * (splitmix(2 * k + 2) | np.uint64(1))
                x ^= x >> np.uint64(29)
                out[:, b] = splitmix(out[:, b] ^ np.minimum.reduceat(x * np.uint64(0xBF58476D1CE4E5B9), starts))
    return out.view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """One narrow row per document: doc_id, row_key, fp, n (elements), bands."""
    bounded_batches(df.sparkSession)
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets, 1 << 20):
                grams, counts = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                found = band_hashes(grams, counts, bands, rows)
                ends = np.concatenate(([0], np.cumsum(np.where(counts > 0, bands, 0)))).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(fingerprints(grams, counts), pa.binary()), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1)))],
                    names=["doc_id", "row_key", "fp", "n", "bands"],
                )

    return base.mapInArrow(tidy(run), "doc_id long, row_key binary, fp binary, n long, bands array<long>")


def compare(fps: list[bytes], mult: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, threshold: float, band: int = -1) -> Iterator[tuple[bytes, int, bytes]]:
    """Verified links among some sets: (fp, linked documents of other sets, root) of each set that has one.

    With `side`, only sets of different sides are compared. Candidates share a band hash, or have `band` as the first one that
    they share, and pass the length filter.
    """
    m = len(fps)
    sizes = np.array([len(s) for s in sets], np.int64)
    links, parent = np.zeros(m, np.int64), np.arange(m)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    distinct, local = np.unique(flat, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(distinct), bool)
    for i in range(m):
        j = np.arange(i + 1, m)
        alike = bands[i + 1 :] == bands[i]
        ok = alike.any(axis=1) if band < 0 else alike[:, band] & ~alike[:, :band].any(axis=1)
        ok &= np.minimum(sizes[i + 1 :], sizes[i]) >= threshold * np.maximum(sizes[i + 1 :], sizes[i]) - 1e-9
        if side is not None:
            ok &= side[i + 1 :] != side[i]
        j = j[ok]
        if not len(j):
            continue
        own = local[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        n = sizes[j]
        first = np.cumsum(n) - n
        at = np.repeat(starts[j] - first, n) + np.arange(int(n.sum()))
        shared = np.add.reduceat(mark[local[at]].astype(np.int64), first)
        mark[own] = False
        j = j[shared >= threshold * (sizes[i] + n - shared) - 1e-9]
        links[i] += int(mult[j].sum())
        links[j] += int(mult[i])
        for x in j.tolist():
            p, q = find(i), find(x)
            if p != q:
                parent[max(p, q)] = min(p, q)
    roots: dict[int, bytes] = {}
    for i in range(m):
        r = find(i)
        roots[r] = min(roots.get(r, fps[i]), fps[i])
    for i in range(m):
        if links[i]:
            yield fps[i], int(links[i]), roots[find(i)]


def _sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it is small enough; else its join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, most_blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, row_key, fp, n; groups: fp, root, links, mult of the sets that have links or copies)."""
    bands, rows = bands_for(threshold, recall)
    docs = written(sketches(df, id_col, text_col, width, bands, rows), "sketches")
    sets = written(docs.filter("fp is not null").groupBy("fp").agg(F.count("*").alias("mult"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    in_band = sets.select("fp", F.posexplode("bands").alias("band", "hash"))
    heads = in_band.groupBy("band", "hash").agg(F.min("fp").alias("head"), F.count("*").alias("size")).filter("size > 1").drop("size")
    stars = in_band.join(heads, ["band", "hash"]).filter("fp <> head").select("fp", "head")
    comp = components(stars, "fp", "head").select(F.col("node").alias("fp"), F.col("root").alias("comp"))
    members = written(comp.join(sets, "fp"), "members")
    parts = lambda: F.greatest(F.lit(1), F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_ELEMENTS))).cast("int").alias("blocks")
    per_comp = members.groupBy("comp").agg(parts())
    total = members.agg(F.count("*"), F.sum("n")).first()
    bins = max(1, total[0] // BIN_SETS, (total[1] or 0) // (BLOCK_ELEMENTS // 2))
    members = members.join(_sized(written(per_comp.filter("blocks > 1"), "large")), "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    by_band = F.col("blocks") > (most_blocks or bands)
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pair = [F.least("block", "other"), F.greatest("block", "other")]
    split, cross = (F.col("blocks") > 1).alias("split"), (F.col("block") != F.col("other")).alias("cross")
    whole = members.filter(~by_band).select("*", block, other)
    whole = whole.select("fp", "mult", "row_key", "bands", "block", F.when(F.col("blocks") > 1, F.concat_ws(":", F.hex("comp"), *pair)).otherwise(F.concat(F.lit("bin"), F.pmod(F.xxhash64("comp"), F.lit(bins)))).alias("task"), split, cross, F.lit(-1).alias("band"))
    buckets = members.filter(by_band).drop("blocks").select("*", F.posexplode("bands").alias("band", "hash"))
    per_bucket = buckets.groupBy("band", "hash").agg(F.count("*").alias("size"), parts()).filter("size > 1").drop("size")
    buckets = buckets.join(per_bucket, ["band", "hash"]).select("*", block, other)
    buckets = buckets.select("fp", "mult", "row_key", "bands", "block", F.concat_ws(":", F.lit("band"), "band", "hash", *pair).alias("task"), F.lit(True).alias("split"), cross, "band")
    dealt = whole.unionAll(buckets)
    texts = df.select(row_key(id_col, text_col).alias("row_key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with_text = texts.join(_sized(written(dealt, "dealt")), "row_key")

    def verify(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table["fp"].to_pylist(), object), kind="stable")
        table = table.take(pa.array(order))
        grams, counts = shingles(*utf8(table["text"].combine_chunks()), width)
        ends = np.cumsum(counts)
        wanted, seen, keep = table["fp"].to_pylist(), set(), []
        for i, fp in enumerate(fingerprints(grams, counts)):
            if fp == wanted[i] and fp not in seen:  # equal rows share a key
                seen.add(fp)
                keep.append(i)
        side = table["block"].to_numpy()[keep]
        cross = bool(table["cross"][0].as_py())  # even if one of the two blocks is empty
        found = list(compare([wanted[i] for i in keep], table["mult"].to_numpy()[keep], np.array(table["bands"].to_pylist(), np.int64)[keep], [grams[ends[i] - counts[i] : ends[i]] for i in keep], side if cross else None, threshold, int(table["band"][0].as_py())))
        give_back()
        return pa.table([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary()))] + [pa.array([bool(table["split"][0].as_py())] * len(found), pa.bool_())], names=["fp", "links", "root", "split"])

    linked = written(with_text.groupBy("task").applyInArrow(verify, "fp binary, links long, root binary, split boolean"), "linked")
    per_set = linked.groupBy("fp").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    apart = linked.filter("split")
    if not apart.isEmpty():
        joined = components(apart.select("fp", F.col("root").alias("b")), "fp", "b")
        whole = joined.select(F.col("node").alias("fp"), F.col("root").alias("whole"))
        per_set = per_set.join(whole, "fp", "left").select("fp", "links", F.coalesce("whole", "root").alias("root"))
    copied = sets.select("fp", "mult").join(per_set, "fp", "left").filter("mult > 1 or links > 0")
    groups = written(copied.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "mult"), "groups")
    return docs, groups


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, class_id (smallest id of its class), n_links (documents it is similar to), n_copies (of its set)."""
    docs, groups = classes(df, id_col, text_col, **options)
    narrow = docs.select("doc_id", "fp")
    in_group = narrow.join(_sized(groups), "fp")
    ids = in_group.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    info = _sized(written(groups.join(ids, "root").select("fp", "links", "mult", "class_id"), "classes"))
    out = narrow.join(info, "fp", "left")
    return out.select("doc_id", F.when(F.col("mult").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("links") + F.col("mult") - 1, F.lit(0)).alias("n_links"), F.coalesce("mult", F.lit(1)).alias("n_copies"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one row of each class: that of the smallest id. Columns stay as they are."""
    docs, groups = classes(df, id_col, text_col, **options)
    in_group = written(docs.select("doc_id", "row_key", "fp").join(_sized(groups.select("fp", "root")), "fp"), "grouped")
    best = in_group.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("kept"))
    per_row = in_group.join(_sized(written(best, "best")), "root").groupBy("row_key", "kept").agg(F.count("*").alias("n"))
    key, own, kept, nth = (free_name(c, df.columns) for c in ("key", "own", "kept", "nth"))
    losers = per_row.filter("row_key <> kept or n > 1").select(F.col("row_key").alias(key), (F.col("row_key") == F.col("kept")).alias(kept))
    tagged = df.withColumn(own, row_key(id_col, text_col)).join(_sized(written(losers, "losers")), F.col(own) == F.col(key), "left")
    names = [F.col(f"`{c}`") for c in df.columns]
    # equal rows of which one stays: very few rows besides the broadcast key are needed to tell them apart
    repeated = tagged.filter(F.col(kept)).withColumn(nth, F.row_number().over(Window.partitionBy(own).orderBy(F.lit(1)))).filter(F.col(nth) == 1)
    return tagged.filter(F.col(kept).isNull()).select(*names).unionByName(repeated.select(*names))
