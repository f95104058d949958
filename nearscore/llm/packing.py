"""Bulk-synchronous best-fit packing of token sequences.

Documents are range-sorted by length and gaps by size. As lengths are whole numbers up to the capacity, both orders
are sequences of runs: pieces of equal length, and sequences with equal room left. A sweep over the runs matches each
document with its successor among the gaps; where documents want the same gap, the k-th by rank gets the k-th gap;
gaps shrink by what they took, and the next round begins, with the next length once a length is placed. Documents
without a gap open new sequences. The rounds see runs only: at most `capacity` runs of documents, however large the
corpus, so the plan (length, ranks from and to, first sequence, offset) is made on the driver from `capacity`
counters. What is distributed is what grows: encoding, ranking pieces within their length, and matching each piece
with its plan row.

Cases: null text is empty (a document is then its end token alone); texts longer than the capacity are cut into full
pieces and a rest; equal rows get places of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearscore.llm import bpe
from nearscore.llm.common import BROADCAST_BYTES, cut, map_batches, ranked, table
from nearscore.llm.tokens import word_bpe

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of at most capacity tokens: where it starts in its document, its length and checksum."""

    def cut_up(b, text):
        held, end = b"", end_id.to_bytes(4, "little")
        for part in (*b.encode_pieces(text), end):
            held = held + part if held else part
            while len(held) > 4 * capacity:
                yield held[: 4 * capacity]
                held = held[4 * capacity :]
        yield held

    def rows(batches):
        b = bpe.load(path, library_merges=True)
        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, ids in enumerate(cut_up(b, t.as_py())):
                    for name, v in zip(out, (i, k, k * capacity, len(ids) // 4, zlib.crc32(ids))):
                        out[name].append(v)
            yield out

    return map_batches(df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text"), rows, PIECES)


class Gaps:
    """Sequences by the room they have left, as runs of consecutive sequence numbers."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.runs, self.sizes = capacity, 0, defaultdict(list), []

    def add(self, size: int, first: int, n: int) -> None:
        if size:
            if not self.runs[size]:
                insort(self.sizes, size)
            self.runs[size].append((first, n))

    def open(self, n: int) -> None:
        self.add(self.capacity, self.next, n)
        self.next += n

    def sweep(self, length: int, n: int) -> list[tuple[int, int, int]]:
        """Takes up to n gaps of at least length, the smallest first, one document each: (size, first, taken)."""
        taken = []
        while n and (at := bisect_left(self.sizes, length)) < len(self.sizes):
            size = self.sizes[at]
            first, have = self.runs[size].pop()
            k = min(n, have)
            if have > k:
                self.runs[size].append((first + k, have - k))
            if not self.runs[size]:
                del self.sizes[at]
            taken.append((size, first, k))
            n -= k
        return taken


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, from_rank, to_rank, first_sequence, offset): pieces of a length by rank, to sequences and places."""
    gaps, out = Gaps(capacity), []
    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            taken = gaps.sweep(length, n - done)
            if not taken:
                gaps.open(-(-(n - done) // (capacity // length)))
                continue
            for size, first, k in taken:
                out.append((length, done, done + k, first, capacity - size))
                gaps.add(size - length, first, k)
                done += k
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length and others; materialised) with sequence_id and offset.

    A piece finds its row of the plan by its length and the block of its rank: each length's ranks are cut into about
    as many blocks as it has rows in the plan, and a row is listed under the blocks that it touches, so a piece meets two
    rows or three, however many there are."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    rows = plan(counts, capacity)
    per_length = Counter(r[0] for r in rows)
    width = {n: -(-counts[n] // per_length[n]) for n in counts}
    listed = [(length, block, *more) for length, lo, hi, *more in ((r[0], r[1], r[2], *r[1:]) for r in rows) for block in range(lo // width[length], (hi - 1) // width[length] + 1)]
    where = spark.createDataFrame(listed, "length long, block long, from_rank long, to_rank long, first_sequence long, offset long")
    where = F.broadcast(where) if len(listed) * 48 <= BROADCAST_BYTES else where
    widths = F.broadcast(spark.createDataFrame([*width.items()], "length long, width long"))  # at most capacity rows
    at = ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"], "rank").join(widths, "length")
    at = at.withColumn("block", F.floor(F.col("rank") / F.col("width")).cast("long"))
    return at.join(where, ["length", "block"]).where("rank >= from_rank AND rank < to_rank").select(
        *pieces.columns, (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset"
    )


def pack_documents(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(cut(token_pieces(df, id_col, text_col, path, capacity, end_id)), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", word_bpe())
