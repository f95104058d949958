"""Exact dedup by progressive refinement: rows are grouped by length, then by a hash of a prefix, then by a hash of
the whole text, and a step looks only at rows whose group still has two or more after the step before.

What crosses the network to find groups is never text. Group keys are counted with map-side combining, so a group that holds a
third of all rows is one row for each map task; groups of one are dropped before the next step. The surviving keys
of the first two steps go back to the scan as a map of bits (KeyMap): 64 bits a key, and never more than `limit` bytes, so
the same steps run at every size. A key that survives always has its bit; other keys with the same bit only cost their rows
the next hash, which tells them apart (a map of 2^27 bits, the largest by default, is a fifth full at 30 million keys).

Cases: null text counts as empty; rows that repeat a document's id and text are rows of the group, counted in
group_size and all kept or all dropped with it; of ties by id all rows stay; a null id never stays while its group has
another; very long texts are hashed in place (exact_dedup() moves rows only where
groups are too many to be broadcast); an empty table gives an empty result; extra columns come back
as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearscore.llm.common import BROADCAST_BYTES, cut, free_names, small, table, text_or_empty

PREFIX_CHARS = 128


#: Bits in one row of a KeyMap, as Spark's bitmap functions have them.
ROW_BITS = 1 << 15


class KeyMap:
    """A set of keys as bits at their hashes, in rows of 4 KB that are broadcast: at most `limit` bytes, one row at least."""

    def __init__(self, keys: DataFrame, limit: int):
        keys = cut(keys.select(F.xxhash64(*keys.columns).alias("hash")))
        self.bits = max(ROW_BITS, min(1 << (64 * keys.count()).bit_length(), 8 * limit))
        row, bit = self._place(F.col("hash"))
        self.map = keys.select(row.alias("row"), bit.alias("bit")).repartition("row").groupBy("row").agg(F.bitmap_construct_agg("bit").alias("map"))

    def _place(self, hashed):
        at = F.pmod(hashed, F.lit(self.bits).cast("long"))
        return F.shiftright(at, 15), at.bitwiseAND(F.lit(ROW_BITS - 1).cast("long"))

    def mark(self, rows: DataFrame, keys: list, name: str) -> DataFrame:
        """rows with a column `name`: whether the bit of keys (columns, in the order of the set's) is there."""
        row_name, map_name = free_names(rows, "row", "map")
        row, bit = self._place(F.xxhash64(*keys))
        byte = F.conv(F.hex(F.substring(F.col(map_name), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        there = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1, F.lit(False))
        joined = rows.join(F.broadcast(self.map.toDF(row_name, map_name)), row == F.col(row_name), "left")
        return joined.select(*(F.col(f"`{c}`") for c in rows.columns), there.alias(name))


def _survivors(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """rows without those whose keys no other row has."""
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return KeyMap(several, limit).mark(rows, [F.col(k) for k in keys], "again").where("again").drop("again")


def duplicate_groups(df: DataFrame, id_col: str, text_col: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """text_sha256, keep_id, group_size, n_bytes and prefix_hash of every text that two rows or more have."""
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("n_bytes", F.octet_length("text"))
    rows = _survivors(rows, ["n_bytes"], limit)
    rows = rows.withColumn("prefix_hash", F.xxhash64(F.substring("text", 1, PREFIX_CHARS)))
    rows = _survivors(rows, ["n_bytes", "prefix_hash"], limit)
    whole = rows.select("id", "n_bytes", "prefix_hash", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    groups = whole.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), *(F.first(c).alias(c) for c in ("n_bytes", "prefix_hash")))
    return groups.where("group_size > 1")


def dedup_decisions(df: DataFrame, id_col: str, text_col: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """id, text_sha256, keep_id, group_size and kept for every row."""
    groups = cut(duplicate_groups(df, id_col, text_col, limit))
    rows = df.select(F.col(id_col).alias("id"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("text_sha256"))
    of = rows.join(small(groups.select("text_sha256", "keep_id", "group_size"), 96, limit), "text_sha256", "left")
    keep = F.coalesce("keep_id", "id")
    return of.select(
        "id", "text_sha256", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | F.col("id").eqNullSafe(keep)).alias("kept"),
    )


def exact_dedup(df: DataFrame, id_col: str, text_col: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of df that stay, all columns as they were. The few keys of groups go to the rows; where these are too many to
    be broadcast, the rows that may be in a group are shuffled, and no others."""
    sha, keep, again = free_names(df, "sha", "keep", "again")
    groups = cut(duplicate_groups(df, id_col, text_col, limit))
    text = text_or_empty(text_col)
    keys = [F.octet_length(text), F.xxhash64(F.substring(text, 1, PREFIX_CHARS))]
    rows = KeyMap(groups.select("n_bytes", "prefix_hash"), limit).mark(df, keys, again)
    whole = F.when(F.col(again), F.sha2(text.cast("binary"), 256)).alias(sha)  # of survivors only
    of = groups.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep))
    stays = F.col(keep).isNull() | F.col(f"`{id_col}`").eqNullSafe(F.col(keep))
    columns = [F.col(f"`{c}`") for c in df.columns]
    if groups.count() * 96 <= limit:
        return rows.select("*", whole).join(F.broadcast(of), sha, "left").where(stays).select(*columns)
    several = rows.where(F.col(again)).select("*", whole).join(of, sha, "left").where(stays)
    return rows.where(~F.col(again)).select(*columns).union(several.select(*columns))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_decisions(table(spark, sf_dir, "documents"), "doc_id", "text").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
