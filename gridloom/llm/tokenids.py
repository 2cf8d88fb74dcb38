"""Operator 10: token ids in binary files, a wavelet matrix per shard.

Documents are range-partitioned by id; each partition is encoded in order and written as one compressed file whose rows are
shards of bounded length: the wavelet matrix's bit planes and rank directories, and the ids and token counts of its
documents. Spark writes and reads the files, so a lost executor's file is written again and any store will do.

Encoding works word by word: the tokenizer's pieces never span a space, a line feed or the place between an ASCII letter or
digit and a mark after it, so texts are split there, each distinct word is encoded once per worker and looked up after that
(bounded memory; by 64-bit hashes of words, whose bytes are then compared; the ids equal those of whole texts). Another kind of tokenizer needs another word table.

Defined cases: a null or empty text is the end id alone; a null id comes first; rows that share an id stay together, in the
order of their texts' hashes; an empty table writes files of no documents; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import wavelet
from gridloom.llm.kernel import bounded_batches, slices, spans_hash, tidy, utf8
from gridloom.session import remove_at_end, shared_dir, written

#: Bytes of text a partition gets on average, and tokens at which a shard is closed.
TEXT_BYTES, SHARD_TOKENS = 16 << 20, 1 << 20
#: Shards up to which their offsets are broadcast (some 50 bytes each); beyond it their join shuffles.
BROADCAST_SHARDS = 200_000
FILE_SCHEMA = "part int, segment int, n long, bits int, zeros array<long>, planes array<binary>, ranks array<binary>, documents long, ids binary, null_ids binary, counts binary"


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[10] = 32
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
#: Marks that always begin a piece of their own after an ASCII letter or digit. No apostrophe (contractions), no < | > (special tokens).
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b'.,!?;:*&%$#()"', np.uint8)] = True


class WordTable:
    """Token ids of words by their 64-bit hashes (sorted arrays, some 100 bytes a word); unknown words are encoded together.

    The bytes of a word decide: words that share a hash with another are encoded by themselves, each time.

    For a tokenizer that drops white space, folds case and has pieces of letters, single digits or other marks.
    """

    def __init__(self, tokenizer, most_words: int = 900_000):
        self.tokenizer, self.most_words = tokenizer, most_words
        self.is_end = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            self.is_end[i] = token.endswith("</w>")
        self.reset()

    def reset(self) -> None:
        self.keys, self.index, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.byte_lengths = 0, np.zeros(0, np.int64)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are one piece each, encoded as one text: a piece ends with an end-of-word token."""
        flat = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.is_end[flat]) + 1
        if len(ends) != len(words):
            return self._each(words)
        return flat, np.diff(ends, prepend=0)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.array([len(x) for x in ids], np.int64)

    def _learn(self, new: list[str]) -> None:
        """Token ids of words that get the next indexes."""
        starts, lengths = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        letters = np.fromiter((w.isalpha() for w in new), bool, len(new))
        for at, how in ((np.flatnonzero(letters), self._joined), (np.flatnonzero(~letters), self._each)):
            for lo in range(0, len(at), 2000):
                part = at[lo : lo + 2000]
                flat, n = how([new[i] for i in part])
                while self.used + len(flat) > len(self.flat):
                    self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
                self.flat[self.used : self.used + len(flat)] = flat
                starts[part], lengths[part] = self.used + np.cumsum(n) - n, n
                self.used += len(flat)
        self.starts, self.lengths = np.concatenate((self.starts, starts)), np.concatenate((self.lengths, lengths))

    def _same(self, flat: np.ndarray, lengths: np.ndarray, place: np.ndarray) -> bool:
        """Whether the words that lie one after another in flat are those of the table at their places, byte for byte."""
        return b"".join(map(self.words.__getitem__, place.tolist())) == flat.tobytes() and (self.sizes()[place] == lengths).all()

    def sizes(self) -> np.ndarray:
        """The table's words' lengths in bytes."""
        known = len(self.byte_lengths)
        if known < len(self.words):
            self.byte_lengths = np.concatenate((self.byte_lengths, np.fromiter(map(len, self.words[known:]), np.int64, len(self.words) - known)))
        return self.byte_lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts (UTF-8 bytes and row offsets), and each text's number of ids.

        Words are what stands between spaces once ASCII letters are folded, line feeds are spaces, and a space stands
        before each mark that follows an ASCII letter or digit.
        """
        raw = data.tobytes()
        if b"<|" in raw:  # folding could make or break a special token
            return self._each([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        if len(self.keys) > self.most_words:
            self.reset()
        spaced = np.insert(data, offsets[1:-1], 32)  # a space between texts
        edges = offsets[1:] + np.arange(len(offsets) - 1)
        folded = _FOLD[spaced]
        marks = np.flatnonzero(_ALNUM[folded[:-1]] & _MARK[folded[1:]]) + 1
        text = np.insert(folded, marks, 32)
        edges = edges + np.searchsorted(marks, edges, "left")
        inside = text != 32
        turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begin, end = turns[::2], turns[1::2]
        hashes = spans_hash(text[inside], end - begin)
        order = np.argsort(hashes)
        new = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
        distinct = hashes[order[new]]
        slot = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside_keys = slot < len(self.keys)
        known[inside_keys] = self.keys[slot[inside_keys]] == distinct[inside_keys]
        index = np.zeros(len(distinct), np.int64)
        index[known] = self.index[slot[known]]
        unknown = np.flatnonzero(~known)
        if len(unknown):
            at = order[new][unknown]
            words = text.tobytes()
            index[unknown] = len(self.keys) + np.arange(len(unknown))
            self.keys = np.insert(self.keys, slot[unknown], distinct[unknown])
            self.index = np.insert(self.index, slot[unknown], index[unknown])
            fresh = [words[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            self.words += fresh
            self._learn([w.decode() for w in fresh])
        place = np.empty(len(hashes), np.int64)
        place[order] = index[np.cumsum(new) - 1]
        starts, lengths = self.starts[place], self.lengths[place]
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]
        if not self._same(text[inside], end - begin, place):
            return self._each([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return ids, np.diff(total[np.searchsorted(begin, edges, "left")], prepend=0)


def word_table(path: str) -> WordTable:
    """The worker's table for a tokenizer file: kept for later tasks of the same worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_gridloom_tables", {})
    if path not in kept:
        kept[path] = WordTable(tokenizers.Tokenizer.from_file(path))
    return kept[path]


def _pack(part: int, segment: int, bits: int, ids: list[np.ndarray], doc_ids: list, counts: list[np.ndarray]) -> pa.RecordBatch:
    tokens = np.concatenate(ids) if ids else np.zeros(0, np.uint16 if bits <= 16 else np.uint32)
    planes, ranks, zeros = wavelet.build(tokens, bits)
    keys = np.array([0 if i is None else i for i in doc_ids], "<i8")
    nulls = np.packbits(np.array([i is None for i in doc_ids], bool))
    lengths = (np.concatenate(counts) if counts else np.zeros(0)).astype("<i8")
    row = {"part": part, "segment": segment, "n": len(tokens), "bits": bits, "zeros": zeros, "planes": planes, "ranks": ranks, "documents": len(doc_ids), "ids": zlib.compress(keys.tobytes(), 1), "null_ids": zlib.compress(nulls.tobytes(), 1), "counts": zlib.compress(lengths.tobytes(), 1)}
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n", pa.int64()), ("bits", pa.int32()), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("documents", pa.int64()), ("ids", pa.binary()), ("null_ids", pa.binary()), ("counts", pa.binary())])
    return pa.RecordBatch.from_pylist([row], schema=schema)


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode df's texts in ascending id order and write one wavelet file per partition under path."""
    spark = df.sparkSession
    bounded_batches(spark)
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_BYTES)) if size > 1 << 20 else 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, part = word_table(tokenizer), TaskContext.get().partitionId()
        top = max(table.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
        bits = max(1, int(top).bit_length())
        kind = np.uint16 if bits <= 16 else np.uint32
        segment, ids, doc_ids, counts, held = 0, [], [], [], 0
        for batch in batches:
            (data, offsets), keys = utf8(batch.column(1)), batch.column(0).to_pylist()
            for lo, hi in slices(offsets, 1 << 21):
                flat, n = table.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids.append(np.insert(flat.astype(kind), np.cumsum(n), end_id))
                counts.append(n + 1)
                doc_ids += keys[lo:hi]
                held += len(ids[-1])
                if held >= SHARD_TOKENS:
                    yield _pack(part, segment, bits, ids, doc_ids, counts)
                    segment, ids, doc_ids, counts, held = segment + 1, [], [], [], 0
        if doc_ids:
            yield _pack(part, segment, bits, ids, doc_ids, counts)

    # the texts' hashes part the rows that share an id, or have none
    dealt = base.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    dealt.mapInArrow(tidy(encode), FILE_SCHEMA).write.mode("append").option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # a part is a file of some 16 MB of text: one task adds up one number a part, many add up the shards within parts
    totals = files.groupBy("part").agg(F.sum("n").alias("n"))
    starts = written(totals.withColumn("first", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n"), "starts")
    within = F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n")
    shards = written(files.select("part", "segment", "n").withColumn("within", within).join(starts, "part").select("part", "segment", (F.col("first") + F.col("within")).alias("before")), "shards")
    few = shards.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
    with_start = files.drop("ranks").join(F.broadcast(shards) if few else shards, ["part", "segment"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = wavelet.decode(r["n"], r["planes"], r["zeros"]).astype("<u4")
                keys = np.frombuffer(zlib.decompress(r["ids"]), "<i8")
                nulls = np.unpackbits(np.frombuffer(zlib.decompress(r["null_ids"]), np.uint8), count=r["documents"]).astype(bool)
                n = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
                ends = np.cumsum(n)
                crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(ends - n, ends, strict=True)), np.int64, len(n))
                yield pa.record_batch([pa.array(keys, pa.int64(), mask=nulls), pa.array(ends - n + r["before"]), pa.array(n.astype(np.int64)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    cols = ["n", "planes", "zeros", "documents", "ids", "null_ids", "counts", "before"]
    return with_start.select(*cols).mapInArrow(tidy(rows), "doc_id long, start long, n_tokens long, ids_crc32 long")


def open_shards(spark: SparkSession, path: str, part: int | None = None) -> list[tuple[int, int, wavelet.WaveletMatrix]]:
    """The wavelet matrices of one partition's file (or of all), for access, counting and lookup on the driver."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    chosen = files if part is None else files.filter(F.col("part") == part)
    return [(r["part"], r["segment"], wavelet.WaveletMatrix(r["n"], [bytes(p) for p in r["planes"]], [bytes(p) for p in r["ranks"]], list(r["zeros"]))) for r in chosen.orderBy("part", "segment").toLocalIterator()]


def token_ids(df: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = f"{shared_dir(df.sparkSession)}/gridloom/tokens-{uuid.uuid4().hex}"
    remove_at_end(df.sparkSession, path)
    write_token_files(df, path, tokenizer, end_id)
    return read_token_files(df.sparkSession, path)
