"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL functions only.

The generator of the paper, key' = key * 2862933555777941757 + 1 mod 2**64, is kept as two unsigned
32-bit halves in longs and multiplied by 16-bit limbs, so nothing overflows and nothing leaves the JVM.

The sequence of jumps of a key doesn't depend on the shard count; the shard among n is the last jump
below n. One fold therefore finds the shards among n and among n + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._common import cut

# The multiplier of the paper's generator, in halves.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
LOW32 = 0xFFFFFFFF


def _next_key(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) * multiplier + 1 mod 2**64 in 32-bit halves."""
    l0, l1 = low.bitwiseAND(F.lit(0xFFFF)), F.shiftright(low, 16)
    h0, h1 = high.bitwiseAND(F.lit(0xFFFF)), F.shiftright(high, 16)

    def low_half(x0: Column, x1: Column, m: int) -> Column:
        """The low 32 bits of x * m."""
        return (x0 * F.lit(m) + F.shiftleft((x1 * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(LOW32))

    p0, p1 = l0 * F.lit(MULTIPLIER_LOW), l1 * F.lit(MULTIPLIER_LOW)
    part = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    up = F.shiftright(part, 32) + F.shiftright(p1, 16) + low_half(h0, h1, MULTIPLIER_LOW) + low_half(l0, l1, MULTIPLIER_HIGH)
    return up.bitwiseAND(F.lit(LOW32)), part.bitwiseAND(F.lit(LOW32))


def jump_shards(key: Column, shards: int) -> Column:
    """A struct (shard, grown): the shards of a long key among `shards` and among `shards + 1`."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(s: Column, _: Column) -> Column:
        high, low = _next_key(s["high"], s["low"])
        live = s["jump"] < F.lit(shards + 1)
        jump = F.floor((s["jump"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double")))
        shard = F.when(s["jump"] < F.lit(shards), s["jump"]).otherwise(s["shard"])
        return F.when(live, F.struct(high.alias("high"), low.alias("low"), jump.alias("jump"), shard.alias("shard"), s["jump"].alias("grown"))).otherwise(s)

    zero = F.lit(0).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(LOW32)).alias("low"), zero.alias("jump"), zero.alias("shard"), zero.alias("grown"))
    # Each jump moves on by one at least, so shards + 1 steps always suffice.
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def shard_documents(docs: DataFrame, shards: int = 40, buckets: int = 1024) -> DataFrame:
    """Deal documents into shards by key, and number the rows of each shard from 0 without gaps.

    Returns doc_id, size (UTF-8 bytes plus 16), text_crc32, law ('key'), shard, slot, grown_shard (with one more
    shard). A null doc_id counts as key 0. A null text has size 16 and the checksum of no bytes. Repeated rows stay and get
    slots of their own. Other columns of docs, whatever their names, aren't read. An empty table gives an empty result.

    Slots: rows are numbered within (shard, bucket), where bucket is a hash of the key, and a bucket starts where the one
    before it ends. The table of starts has shards * buckets rows at most, whatever the input. Rows that share a doc_id
    and a text share a bucket; the checksum of the text picks the bucket too, so that equal ids with other texts spread.
    """
    text = F.coalesce(docs["text"].cast("binary"), F.lit(b""))
    jumps = jump_shards(F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")), shards)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), jumps.alias("j"))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("j.shard").alias("shard"), F.col("j.grown").alias("grown_shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"))
    rows = cut(rows)  # a few dozen bytes a row: the texts are read once
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1)
    out = numbered.join(F.broadcast(starts), ["shard", "bucket"])  # at most shards * buckets rows of 24 bytes
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")
