"""Sharding by jump consistent hashing, with DataFrame functions only.

The key's 64-bit linear congruential sequence is computed in 32-bit halves (no product exceeds 2**49), folded over
at most ``shards`` jumps. Nearly every key needs about ln(shards) of them, so the fold runs in blocks and a later
block is entered only by rows that have not landed.

Defined cases: a null key hashes as 0; a null text has no bytes (size 1, crc 0); repeated rows get slots of their
own; an empty table gives no rows; other columns are kept by ``write_shards`` and dropped by ``shard``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_hash, slots, written

#: Multiplier of the 64-bit generator of jump hashing (fixed value), in 32-bit halves.
MUL = 2862933555777941757
HIGH, LOW, M32 = MUL >> 32, MUL & 0xFFFFFFFF, 0xFFFFFFFF


def _and(a: Column, m: int) -> Column:
    return a.bitwiseAND(F.lit(m))


def _times(x: Column, m: int) -> Column:
    """x * m modulo 2**32 for 32-bit x and m."""
    high = F.shiftleft(_and(F.shiftright(x, 16) * F.lit(m), 0xFFFF), 16)
    return _and(_and(x, 0xFFFF) * F.lit(m) + high, M32)


def _step(s: Column, shards: int) -> Column:
    """One jump, unless the key has landed: new state of the generator, bucket and next bucket."""
    p0, p1 = _and(s.lo, 0xFFFF) * F.lit(LOW), F.shiftright(s.lo, 16) * F.lit(LOW)
    low = p0 + F.shiftleft(_and(p1, 0xFFFF), 16) + F.lit(1)
    hi = _and(F.shiftright(low, 32) + F.shiftright(p1, 16) + _times(s.hi, LOW) + _times(s.lo, HIGH), M32)
    to = F.floor((s.j + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")))
    moved = F.struct(hi.alias("hi"), _and(low, M32).alias("lo"), s.j.alias("b"), to.cast("long").alias("j"))
    return F.when(s.j < F.lit(shards), moved).otherwise(s)


def jump_hash(key: Column, shards: int, block: int = 48) -> Column:
    """The shard (0 .. shards-1) of a 64-bit key."""
    key = F.coalesce(key.cast("long"), F.lit(0))
    long = lambda c: c.cast("long")
    state = F.struct(_and(F.shiftright(key, 32), M32).alias("hi"), _and(key, M32).alias("lo"), long(F.lit(-1)).alias("b"), long(F.lit(0)).alias("j"))
    steps = lambda s, a, n: F.aggregate(F.sequence(F.lit(a), F.lit(n - 1)), s, lambda acc, _: _step(acc, shards))
    out = steps(state, 0, min(block, shards))
    if shards > block:
        whole = steps(state, 0, shards)
        out = F.when(out.j >= F.lit(shards), out).otherwise(whole)
    return out.b.cast("int")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", grow_to: int | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row; slots are gapless from 0 in each shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_hash(F.col(key), shards).alias("shard"),
        jump_hash(F.col(key), grow_to or shards + 1).alias("grown_shard"),
    )
    out = slots(written(rows.withColumn("_row", row_hash(F.col(key), F.col("text_crc32"), F.col("size")))), "shard", "_row")
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("_slot").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write all columns of the documents as Parquet, one folder ``shard_no=i`` per shard, in one pass without a shuffle."""
    docs.withColumn("shard_no", jump_hash(F.col(key), shards)).write.partitionBy("shard_no").parquet(path)
