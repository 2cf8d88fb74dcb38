"""Operator 9: sharding by jump consistent hashing, DataFrame functions only.

A row's shard follows from its key and the shard count alone: no ring table is stored, and adding a shard moves rows only
into the new one. Slots number the rows of a shard from 0 without gaps; they are dealt in blocks of keys so that no task
ever orders a whole shard.

Defined cases: a null key is replaced by the text's CRC-32; a null text is empty (size 1, CRC-32 of nothing); rows that
repeat each get a slot of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import written

#: The multiplier of the published generator.
MULTIPLIER = 2862933555777941757
#: Another one, of which the highest bits deal keys into blocks: whatever the keys' steps, they fall into all blocks.
BLOCK_MULTIPLIER = 11400714819323198485


def _times(key: Column, multiplier: int, plus: int) -> Column:
    """key * multiplier + plus modulo 2**64: products of 16-bit limbs, as a long multiplication would overflow under ANSI rules."""
    k = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    m = [(multiplier >> (16 * i)) & 0xFFFF for i in range(4)]
    limbs, carry = [], F.lit(plus)
    for i in range(4):
        total = carry
        for j in range(i + 1):
            total = total + k[j] * F.lit(m[i - j])
        limbs.append(F.shiftleft(total.bitwiseAND(0xFFFF), 16 * i))
        carry = F.shiftright(total, 16)
    out = limbs[0]
    for limb in limbs[1:]:
        out = out.bitwiseOR(limb)
    return out


def jump_hash(key: Column, buckets: int, steps: int = 128) -> Column:
    """The jump consistent hash of a long key in 0..buckets-1.

    Each jump moves at least one bucket on, so `buckets` steps always do; above `steps` buckets the number of jumps has
    mean ln(buckets) and more than 128 have a chance below 1e-60.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")

    def jump(state: Column, _: Column) -> Column:
        key = _times(state["key"], MULTIPLIER, 1)
        there = ((state["at"] + 1) * (F.lit(2147483648.0) / (F.shiftrightunsigned(key, 33) + 1).cast("double"))).cast("long")
        moved = F.struct(state["at"].alias("from"), there.alias("at"), key.alias("key"))
        return F.when(state["at"] < buckets, moved).otherwise(state)

    start = F.struct(F.lit(-1).cast("long").alias("from"), F.lit(0).cast("long").alias("at"), key.cast("long").alias("key"))
    turns = F.sequence(F.lit(1), F.lit(min(buckets, steps)))
    return F.aggregate(turns, start, jump, lambda s: F.when(s["at"] < buckets, s["at"]).otherwise(s["from"])).cast("int")


def assign_shards(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", block_bits: int = 8) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    The text is read once and never shuffled. Each shard is numbered in 2**block_bits blocks of keys; the offsets are at most
    shards * blocks rows, which bounds what is broadcast.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"))
    stable = F.coalesce("doc_id", "text_crc32")
    placed = written(base.select("*", jump_hash(stable, shards).alias("shard"), jump_hash(stable, shards + 1).alias("grown_shard"), F.shiftrightunsigned(_times(stable.cast("long"), BLOCK_MULTIPLIER, 0), 64 - block_bits).cast("int").alias("block")), "shards")
    counted = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    offsets = counted.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("inside", inside).join(F.broadcast(offsets), ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("inside")).alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int = 8, key: str = "doc_id", text: str = "text") -> None:
    """Write whole rows into path/shard=N/; each shard is written by as many tasks as its rows came from."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    df.withColumn("shard", jump_hash(F.coalesce(F.col(f"`{key}`").cast("long"), F.crc32(body)), shards)).write.partitionBy("shard").parquet(path)
