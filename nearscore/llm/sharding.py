"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A row's shard is a function of its key and the number of shards. Going from n to n + 1 shards, a row either
keeps its shard or moves to the new one, and one row in n + 1 moves. There is no ring table and nothing to
look up, so a shard is computed in the scan; only narrow rows are shuffled, to number the rows of a shard.

Cases: a null key is replaced by the xxhash64 of the row's size and text checksum, so rows without a key spread
as others do; null text has no bytes; a text of any length is read once and not moved; repeated rows, which tie, share
their shard and get slots of their own in any order; an empty table gives an empty result; columns of the input that carry
the names made here are not read, and write_sharded() names its folder column so that it clashes with none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearscore.llm.common import BROADCAST_BYTES, free_names, table, text_or_empty

#: Fixed values of the method: the multiplier of its 64-bit linear congruential generator, and 2 to the 31.
MULTIPLIER = 2862933555777941757
TWO_31 = 2147483648.0
M16, M32 = 0xFFFF, 0xFFFFFFFF
#: Jumps of a walk: their number is a sum of independent trials with mean H(n) < ln(n) + 1, so 256 is beyond reach
#: for any n that fits a long; a walk that has not ended by then raises an error and never gives a wrong shard.
MOST_JUMPS = 256


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64 on 32-bit halves; no product passes 2**49, so ANSI mode never overflows."""
    c0, c1, c2, c3 = (_long(MULTIPLIER >> s & M16) for s in (0, 16, 32, 48))
    m16, m32 = _long(M16), _long(M32)
    p1 = lo * c1
    low = lo * c0 + F.shiftleft(p1.bitwiseAND(m16), 16) + _long(1)
    high = (
        F.shiftright(low, 32) + F.shiftright(p1, 16) + hi * c0 + F.shiftleft((hi * c1).bitwiseAND(m16), 16)
        + lo * c2 + F.shiftleft((lo * c3).bitwiseAND(m16), 16)
    )
    return high.bitwiseAND(m32), low.bitwiseAND(m32)


def jump_walk(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among `shards`, and among one more, from one walk."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(TWO_31) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(
            hi.alias("hi"), lo.alias("lo"), jump.alias("j"),
            F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"), s["j"].alias("grown"),
        )
        return F.when(s["j"] <= shards, moved).otherwise(s)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_long(M32)).alias("lo"),
        _long(0).alias("j"), _long(0).alias("shard"), _long(0).alias("grown"),
    )
    most = min(shards + 1, MOST_JUMPS)

    def finish(s: Column) -> Column:
        done = F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown"))
        return done if most == shards + 1 else F.when(s["j"] > shards, done).otherwise(F.raise_error(F.lit("jump walk did not end")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, finish)


def _key_or_content(key: Column, text: Column) -> Column:
    """The key; for rows without one, a hash of size and checksum, so that they spread as others do."""
    return F.coalesce(key, F.xxhash64(F.octet_length(text).cast("long") + 8, F.crc32(text.cast("binary"))))


def _steps(df: DataFrame, key: Column, shards: int, text: Column) -> DataFrame:
    size = F.octet_length(text).cast("long") + 8
    return df.select(
        key.alias("key"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_walk(_key_or_content(key, text), shards).alias("walk"),
    )


def shard_rows(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """key, size, text_crc32, shard, grown_shard and slot (0, 1, ... in each shard) for every row of df.

    Slots in two steps, so that no task numbers a whole shard: each shard is cut into as many blocks as there
    are shuffle partitions, by a hash of the key; the blocks' row counts (shards times blocks numbers, whatever
    the data) give each block its first slot; rows are numbered within their block.
    """
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _steps(df, F.col(key).cast("long"), shards, text_or_empty(text)).select(
        "key", "size", "text_crc32", F.col("walk.shard").alias("shard"), F.col("walk.grown").alias("grown_shard"),
        F.pmod(F.xxhash64("key", "size", "text_crc32"), F.lit(blocks)).cast("int").alias("block"),
    )
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    first = F.broadcast(first) if shards * blocks * 24 <= BROADCAST_BYTES else first
    within = W.partitionBy("shard", "block").orderBy("key", "size", "text_crc32")
    numbered = rows.withColumn("rank", F.row_number().over(within))
    return numbered.join(first, ["shard", "block"]).select(
        "key", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), "grown_shard"
    )


def moved_fraction(df: DataFrame) -> DataFrame:
    """What appending one shard moves: rows and bytes in all, and those that go to the new shard."""
    move = F.col("shard") != F.col("grown_shard")
    sums = {"rows": F.count(F.lit(1)), "moved": F.count_if(move), "bytes": F.sum("size"), "moved_bytes": F.sum(F.when(move, F.col("size")).otherwise(0))}
    return df.agg(*(v.alias(k) for k, v in sums.items()))


def write_sharded(df: DataFrame, path: str, key: str, text: str, shards: int) -> None:
    """df by shard, one folder a shard; appending a shard rewrites only the rows that moved_fraction counts."""
    walk = jump_walk(_key_or_content(F.col(f"`{key}`").cast("long"), text_or_empty(text)), shards)
    (name,) = free_names(df, "shard")
    df.withColumn(name, walk["shard"]).write.partitionBy(name).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), "doc_id", "text", 24).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
