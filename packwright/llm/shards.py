"""Sharding by jump consistent hashing, with DataFrame functions only.

A key walks through growing shard counts: at every count it stays or jumps to the shard
just added, and a generator seeded by the key says directly where the next jump goes. No
ring table is needed, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.common import bytes_of

# Fixed values of the published generator: its multiplier in two halves of 32 bits.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 0x27BB2EE6, 0x87B0B0FD
LOW32 = 0xFFFFFFFF
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Rows of a shard are numbered in so many parts, each on its own.
PARTS = 1024


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64, on halves, as no product may leave 63 bits."""
    first = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(MULTIPLIER_LOW)
    second = F.shiftright(low, 16) * F.lit(MULTIPLIER_LOW)
    bottom = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    top = (F.shiftright(second, 16) + F.shiftright(bottom, 32)
           + (low * F.lit(MULTIPLIER_HIGH)).bitwiseAND(F.lit(LOW32))
           + F.shiftleft((F.shiftright(high, 16) * F.lit(MULTIPLIER_LOW)).bitwiseAND(F.lit(0xFFFF)), 16)
           + high.bitwiseAND(F.lit(0xFFFF)) * F.lit(MULTIPLIER_LOW))
    return top.bitwiseAND(F.lit(LOW32)), bottom.bitwiseAND(F.lit(LOW32))


def jump_hash(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard of ``shards``, and of one more.

    ``key`` is a long whose 64 bits seed the generator; null gives null. A key jumps at
    most once to every shard, so a fold of ``shards + 1`` steps follows its whole walk.
    """
    if shards < 1:
        raise ValueError("there must be a shard at least")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(LOW32)).alias("low"),
        F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("jump"))

    def step(state: Column, _: Column) -> Column:
        high, low = _next(state["high"], state["low"])
        jump = F.floor((state["jump"] + 1).cast("double")
                       * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = F.struct(high.alias("high"), low.alias("low"), state["jump"].alias("at"),
                         jump.cast("long").alias("jump"))
        return F.when(state["jump"] < shards, moved).otherwise(state)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards + 1)), start, step,
        lambda s: F.struct(
            s["at"].cast("int").alias("shard"),
            F.when(s["jump"] == shards, F.lit(shards)).otherwise(s["at"]).cast("int").alias("grown")))


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
                  parts: int = PARTS) -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, law, shard, slot, grown_shard.

    The key's text is hashed (a null key like an empty text), so keys of any type are dealt
    evenly; key and shard count alone decide. ``size`` is the text's UTF-8 bytes and 16. Slots
    count a shard's rows from 0 without a gap: rows are numbered within ``parts`` parts of a
    shard and moved by the rows of the parts before, so no task holds a whole shard. Repeated
    rows get slots of their own; which of two equal rows comes first is open. A null or empty
    text has size 16 and CRC 0. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    body = bytes_of(F.col(text))
    rows = df.select(
        F.col(key).alias("key"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"))
    rows = rows.withColumn("dealt", jump_hash(
        F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit(""))), shards)).select(
        "key", "size", "text_crc32", F.col("dealt.shard").alias("shard"),
        F.col("dealt.grown").alias("grown_shard"),
        # The text takes part, so that a key with very many rows is split as well.
        F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(parts)).alias("part"))
    before = (rows.groupBy("shard", "part").count()
              .select("shard", "part", F.coalesce(
                  F.sum("count").over(Window.partitionBy("shard").orderBy("part")
                                      .rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0)).alias("before")))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "text_crc32", "size"))
    return (rows.withColumn("within", within - 1).join(before, ["shard", "part"])
            .select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("before") + F.col("within")).alias("slot"), "grown_shard"))
