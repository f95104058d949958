"""Suffix-array dedup: removes every byte that a string of LENGTH bytes covers which also starts somewhere else.

The index is a sparse one, and shards merge by refining the interleave of their suffixes; suffixes are never sorted as a
whole. In the order of the steps:

1. Texts that another row repeats in full need no suffixes: every string of theirs is repeated. One row of each such
   group stays in the index, as a partner for others.
2. Each shard (a task's texts) takes the suffixes that start at anchors: the leftmost least 8-byte hash of every
   window of WINDOW hashes. Anchors depend on nothing but the bytes around them, and any LENGTH bytes hold one among
   their first WINDOW positions, at the same place in each occurrence. So a repeated string shows up as an anchor with
   CORE = LENGTH - WINDOW + 1 common bytes after it and up to WINDOW - 1 before it: looking at anchors loses nothing.
3. Shards merge at depth CORE: a suffix is known by a hash of its first CORE bytes, equal ones form a block, and a
   block with one suffix is settled. Those whose whole context (WINDOW - 1 bytes before the anchor to LENGTH after) a
   second suffix of the block has are settled too: all their strings are repeated. This leaves the suffixes
   where a repeat begins or ends. Each shard does this for its own suffixes first and sends the others one row for what
   it has found repeated, so no block grows with the texts that share it, only with the shards.
4. These are merged symbol by symbol, as Burrows-Wheeler transforms are (Holt and McMillan, 2014): in each
   iteration the blocks of the interleave are split, stably, by the next byte on the right; the iteration in which a
   suffix is alone in its block is its longest common prefix (Egidi and Manzini, 2017). The transform's symbols, the
   bytes that precede the suffixes, split blocks on the left in the same way. A string that starts d bytes before an
   anchor is a repeated interval if another suffix shares both its left block at depth d and its right block at depth
   LENGTH - d. Bytes are compared here, not hashes. A block of more than LARGE suffixes is spread over tasks by what its
   intervals hold.
5. Repeated intervals go back to their texts, overlaps count once, and the rest of the text is kept.

Blocks are known by hashes, so their order among each other is not alphabetical; nothing here needs it. A block's 64 bits
only bring suffixes together. What is equal is decided by bytes, or by 128 bits of BLAKE2b under a key that is drawn for
each run, so no texts can be made to collide. What is shuffled: 40 bytes or so for each anchor (one in 32 bytes of text), the texts that have
a repeat, and 126 bytes for each suffix of step 4 (16 bytes for each interval, up to 64, in large blocks). Long texts are cut into overlapping blocks. No step caps a block.

Cases: null text is empty; texts under LENGTH bytes keep all; rows that repeat an id or a whole row are documents of
their own; ties cannot matter, as strings are judged on the input; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import secrets
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearscore.llm.common import cut, delete, ensure_checkpoint_dir, free_names, map_batches, release, small, table, text_or_empty
from nearscore.llm.exact import duplicate_groups

LENGTH, WINDOW, GRAM = 200, 64, 8
CORE, SIDE = LENGTH - WINDOW + 1, WINDOW - 1
BLOCK, HALO = 1 << 18, 512
#: Anchors that a shard merges at once (some 8 MB of text), and rows of an Arrow batch.
SHARD, SENT = 1 << 18, 1 << 14
#: Blocks of more suffixes than this are not merged in one task.
LARGE = 1024
#: What is known of an anchor; a sum of these.
ALL, EDGE, PARTNER = 1, 2, 4
#: Odd multipliers of the hashes: of 8-byte grams, of running sums, and of the last mixing.
GRAM_MIX, BASE, LAST_MIX = 0x9E3779B97F4A7C15, 0xA0761D6478BD642F, 0xD6E8FEB86659FD93

_powers: list = []


def powers(n: int):
    """BASE and its inverse modulo 2**64, to the powers 0 to n - 1."""
    import numpy as np

    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            out = np.ones(max(n, BLOCK + 4 * HALO), np.uint64)
            done = 1
            while done < len(out):
                k = min(done, len(out) - done)
                out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
                done += k
            _powers.append(out)
    return _powers


def anchors(data, ends):
    """Ascending positions of the anchors of texts that lie end to end in data; no window crosses an end."""
    import numpy as np

    if len(data) < WINDOW + GRAM - 1:
        return np.empty(0, np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(data, GRAM).copy().view("<u8").ravel()
    least = ((grams * np.uint64(GRAM_MIX)) >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have < WINDOW:
        step = min(have, WINDOW - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(at), bool)
    for end in ends[:-1]:
        inside[max(0, end - WINDOW - GRAM + 2) : end] = False
    at = at[inside]
    return np.unique(at)


class Sums:
    """Running sums of a block, from which the hash of any of its ranges is read off."""

    def __init__(self, data):
        import numpy as np

        self.up, down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=self.sums[1:])

    def hashes(self, begin, end):
        import numpy as np

        x = (self.sums[end] - self.sums[begin]) * self.up[begin]
        x ^= x >> np.uint64(32)
        x *= np.uint64(LAST_MIX)
        return x ^ (x >> np.uint64(29))


def blocks(column):
    """(first row, data, bounds, shift) over a binary Arrow array: rows together up to BLOCK bytes, or parts of a long
    one with HALO bytes around them; shift is where data begins in its row, or None for whole rows."""
    import numpy as np

    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = row + 1
        while end < len(column) and offsets[end + 1] - offsets[row] <= BLOCK:
            end += 1
        part = data[offsets[row] : offsets[end]]
        if len(part) <= BLOCK:
            yield row, part, offsets[row : end + 1] - offsets[row], None
        else:
            for at in range(0, len(part), BLOCK):
                lo, hi = max(0, at - HALO), min(len(part), at + BLOCK + HALO)
                yield row, part[lo:hi], np.array([0, hi - lo]), (lo, at, min(len(part), at + BLOCK))
        row = end


def keyed(data, begin, end, left, right, key: bytes):
    """128-bit keyed hashes (two columns) of the contexts data[begin:end], which reach left and right of their anchors."""
    import numpy as np

    blake, whole = hashlib.blake2b, memoryview(data)
    inner = (left == SIDE) & (right == LENGTH)
    if inner.all():
        digests = [blake(whole[a:b], digest_size=16, key=key).digest() for a, b in zip(begin.tolist(), end.tolist())]
    else:  # at a text's ends it is also known how far the context reaches
        short = key + b"end"
        digests = [
            blake(whole[a:b], digest_size=16, key=key).digest() if i else blake(bytes(whole[a:b]) + x.to_bytes(2, "little") + y.to_bytes(2, "little"), digest_size=16, key=short).digest()
            for a, b, i, x, y in zip(begin.tolist(), end.tolist(), inner.tolist(), left.tolist(), right.tolist())
        ]
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def anchor_rows(column, key: bytes = b""):
    """(row, position, core hash, context hashes) of all anchors with CORE bytes after them, as arrays, block by block."""
    import numpy as np

    for row, data, bounds, part in blocks(column):
        at = anchors(data, bounds[1:])
        of = np.searchsorted(bounds, at, "right") - 1
        lo, hi = bounds[of], bounds[of + 1]
        fits = (at + CORE <= hi) & (hi - lo >= LENGTH)
        if part:
            fits &= (at + part[0] >= part[1]) & (at + part[0] < part[2])
        at, of, lo, hi = at[fits], of[fits], lo[fits], hi[fits]
        begin, end = np.maximum(lo, at - SIDE), np.minimum(hi, at + LENGTH)
        context = keyed(np.ascontiguousarray(data), begin, end, at - begin, end - at, key)
        yield row + of, at - lo + (part[0] if part else 0), Sums(data).hashes(at, at + CORE), context


def index_texts(df: DataFrame, id_col: str, text_col: str, groups: DataFrame, path: str) -> DataFrame:
    """Writes the texts of the index, with a number for each, and reads them back: number, id, n_bytes, sha, passive
    (one row of a group of equal texts), text. Groups of equal texts have one row, those under LENGTH bytes none."""
    text = text_or_empty(text_col).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("text_sha256")).join(small(groups, 96), "text_sha256", "left")
    passive, size = F.col("group_size").isNotNull(), F.octet_length("text").cast("long")
    rows = rows.where(~passive | (F.col("id").eqNullSafe(F.col("keep_id")) & (size >= LENGTH)))
    numbered = rows.select(F.monotonically_increasing_id().alias("number"), "id", size.alias("n_bytes"), "text_sha256", passive.alias("passive"), "text")
    numbered.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Kinds of rows that shards send: a suffix that is alone with its context in its shard; one of several with it (or a
#: passive one); one for the several suffixes of a block whose contexts are alone; and what a shard can tell by itself.
ALONE, SAME, SOME, IS_ALL, IS_EDGE = range(5)


def shard_merge(core, context, passive):
    """A shard's own interleave at depth CORE, merged: (positions, kinds) of the rows that it sends. A block of any
    number of suffixes sends one row for each repeated context and one for all others; suffixes about which that
    settles everything need no block elsewhere."""
    import numpy as np

    order = np.lexsort((context[:, 1], context[:, 0], core))
    new_core = np.r_[True, np.diff(core[order]) != 0]
    new = new_core | np.r_[True, (context[order][1:] != context[order][:-1]).any(axis=1)]
    group, block = np.cumsum(new) - 1, np.cumsum(new_core) - 1
    weight = np.bincount(group, 1 + passive[order])[group]
    alone = weight == 1
    several = alone & (np.bincount(block, alone)[block] > 1)
    first_several = np.zeros(len(order), bool)
    at = np.flatnonzero(several)
    first_several[at[np.r_[True, np.diff(block[at]) != 0]] if len(at) else at] = True
    sent = (
        (alone & ~several, ALONE), (new & ~alone, SAME), (first_several, SOME),
        (~alone & ~passive[order].astype(bool), IS_ALL), (several, IS_EDGE),
    )
    rows = np.concatenate([order[m] for m, _ in sent])
    return rows, np.repeat(np.arange(5, dtype=np.int32), [int(m.sum()) for m, _ in sent])


def known(texts: DataFrame, secret: bytes) -> DataFrame:
    """number and known, an array of 8 * position + (ALL, EDGE, PARTNER), of every text with such anchors.

    Shards merge their own suffixes first, so a block that a large part of all texts share is a few rows a shard. Rows
    that a shard has settled go along under keys of their own, spread evenly, on their way to their texts.
    """

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        def sent(held):
            of, at, core, context, passive = map(np.concatenate, zip(*held))
            rows, kind = shard_merge(core, context, passive.astype(np.int64))
            of, at = of[rows], at[rows]
            own = (of.view("u8") * np.uint64(GRAM_MIX) ^ at.astype(np.uint64)) * np.uint64(LAST_MIX)
            key, (one, two) = np.where(kind >= IS_ALL, own, core[rows]), context[rows].view("i8").T
            for k in range(0, len(rows), SENT):
                part = slice(k, k + SENT)
                yield dict(zip(("core", "context", "context2", "number", "at", "kind"), (pa.array(np.ascontiguousarray(x[part])) for x in (key.view("i8"), one, two, of, at, kind))))

        held, n = [], 0
        for batch in batches:
            number, passive = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for row, at, core, context in anchor_rows(batch.column(2), secret):
                if len(at):
                    held.append((number[row], at, core, context, passive[row]))
                    n += len(at)
                if n >= SHARD:
                    yield from sent(held)
                    held, n = [], 0
        if held:
            yield from sent(held)

    found = map_batches(texts.where(F.col("n_bytes") >= LENGTH).select("number", "passive", "text"), rows, "core long, context long, context2 long, number long, at int, kind int")
    kind = F.col("kind")
    block, same = W.partitionBy("core"), W.partitionBy("core", "context", "context2")
    more = found.withColumn("n", F.count(F.lit(1)).over(block)).where((F.col("n") > 1) | (kind >= IS_ALL))
    more = more.withColumn("n", F.count(F.lit(1)).over(same)).withColumn("first", F.row_number().over(same.orderBy("kind", "number", "at")) == 1)
    edge = (kind == ALONE) & (F.col("n") == 1)
    more = more.withColumn("edges", F.max(edge | (kind == SOME)).over(block))
    whole = (kind == IS_ALL) | ((kind == ALONE) & (F.col("n") > 1))
    partner = F.col("edges") & F.col("first") & ((kind == SAME) | ((kind == ALONE) & (F.col("n") > 1)))
    code = F.when(whole, ALL).otherwise(0) + F.when(edge | (kind == IS_EDGE), EDGE).otherwise(0) + F.when(partner, PARTNER).otherwise(0)
    return more.select("number", (F.col("at").cast("long") * 8 + code).alias("x")).where("x % 8 > 0").groupBy("number").agg(F.collect_list("x").alias("known"))


CONTEXTS = "core long, core2 long, number long, at int, active boolean, n_left int, n_right int, sides binary"


def contexts(repeats: DataFrame, secret: bytes) -> DataFrame:
    """What step 4 merges: the bytes around the core of every anchor of an EDGE or PARTNER, SIDE on each side."""

    def rows(batches):
        import numpy as np

        for batch in batches:
            out = {k: [] for k in ("core", "core2", "number", "at", "active", "n_left", "n_right", "sides")}
            for number, text, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                x = np.asarray(x.values)
                x = np.sort(x[(x & (EDGE | PARTNER)) > 0])
                if not len(x):
                    continue
                data = text.as_buffer().to_pybytes()
                at = x >> 3
                for a, active in zip(at.tolist(), ((x & EDGE) > 0).tolist()):
                    left, right = data[max(0, a - SIDE) : a], data[a + CORE : a + LENGTH]
                    core = struct.unpack("<qq", hashlib.blake2b(data[a : a + CORE], digest_size=16, key=secret).digest())
                    for name, v in zip(out, (*core, number, a, active, len(left), len(right), left[::-1].ljust(SIDE, b"\0") + right.ljust(SIDE, b"\0"))):
                        out[name].append(v)
                if len(out["at"]) >= 8192:
                    yield out
                    out = {k: [] for k in out}
            if out["at"]:
                yield out

    return map_batches(repeats.select("number", "text", "known"), rows, CONTEXTS)


def refine(block, symbols, lengths):
    """Splits the blocks of an interleave by one symbol after another: yields the blocks after 0, 1, ... symbols. A
    suffix that is alone in its block is settled (-1), and so is one that has no further symbol."""
    import numpy as np

    block = block.copy()
    yield block.copy()
    for depth in range(symbols.shape[1]):
        block[lengths <= depth] = -1
        open_ = np.flatnonzero(block >= 0)
        keys = block[open_] * 256 + symbols[open_, depth]
        order = np.argsort(keys, kind="stable")
        keys, open_ = keys[order], open_[order]
        border = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[border, len(keys)])
        block[open_] = np.where(np.repeat(sizes, sizes) > 1, np.repeat(np.arange(len(sizes)), sizes), -1)
        yield block.copy()


def repeated_starts(core, n_left, n_right, sides):
    """For each suffix, a 64-bit mask of the d for which the string that starts d bytes before it is repeated. core: the
    keyed hash of its first CORE bytes, in two columns."""
    import numpy as np

    order = np.lexsort(core.T)
    block = np.empty(len(core), np.int64)
    block[order] = np.cumsum(np.r_[True, (core[order][1:] != core[order][:-1]).any(axis=1)]) - 1
    right = [*refine(block, sides[:, SIDE:], n_right)]
    mask = np.zeros(len(core), np.uint64)
    for d, left in enumerate(refine(block, sides[:, :SIDE], n_left)):
        both = np.flatnonzero((left >= 0) & (right[SIDE - d] >= 0))
        if not len(both):
            continue
        keys = left[both] * (len(core) + 1) + right[SIDE - d][both]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        mask[both[order[np.r_[same, False] | np.r_[False, same]]]] |= np.uint64(1 << d)
    return mask


MASKS = "number long, at int, mask long"


def merge(around: DataFrame) -> DataFrame:
    """number, at, mask of every active suffix with repeated intervals, blocks merged one after another in a task."""
    need = 1 << 15

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        def done(held):
            t = pa.Table.from_batches(held).combine_chunks()
            if not t.num_rows:
                return
            sides = np.frombuffer(b"".join(t["sides"].to_pylist()), np.uint8).reshape(-1, 2 * SIDE)
            core = np.stack([t["core"].to_numpy(), t["core2"].to_numpy()], axis=1)
            mask = repeated_starts(core, t["n_left"].to_numpy(), t["n_right"].to_numpy(), sides)
            keep = (mask > 0) & t["active"].to_numpy()
            yield {"number": pa.array(t["number"].to_numpy()[keep]), "at": pa.array(t["at"].to_numpy()[keep]), "mask": pa.array(mask[keep].view("i8"))}

        held, n = [], 0  # whole blocks: rows come sorted by core
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= need:
                t = pa.Table.from_batches(held).combine_chunks()
                core = t["core"].to_numpy()
                end = int(np.searchsorted(core, core[-1], "left"))
                if end:
                    yield from done(t.slice(0, end).to_batches())
                held = t.slice(end).to_batches()
                n = t.num_rows - end
        if held:
            yield from done(held)

    together = around.repartition("core").sortWithinPartitions("core", "core2")
    return map_batches(together, rows, MASKS)


def merge_large(around: DataFrame) -> DataFrame:
    """The same for blocks that are too large for one task: each interval is a row under a hash of its own (128 bits of
    SHA-256 over its bytes and the keyed hash of its core), counted with map-side combining; the counts go back to the rows in a join, which AQE splits where it is skewed."""
    low, high = F.greatest(F.lit(0), SIDE - F.col("n_right")), F.least(F.lit(SIDE), F.col("n_left"))
    each = around.where(low <= high).select("core", "core2", "number", "at", "active", "sides", F.explode(F.sequence(low, high)).alias("d"))
    bytes_ = F.concat(F.substring("sides", F.lit(1), F.col("d")), F.substring("sides", F.lit(SIDE + 1), SIDE - F.col("d")))
    string = F.concat(F.unhex(F.lpad(F.hex("core"), 16, "0")), F.unhex(F.lpad(F.hex("core2"), 16, "0")), F.unhex(F.lpad(F.hex("d"), 2, "0")), bytes_)
    each = each.select("number", "at", "active", "d", F.substring(F.unhex(F.sha2(string, 256)), 1, 16).alias("a"))
    counts = cut(each.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"))
    hit = each.where("active").join(counts, "a")
    return hit.groupBy("number", "at").agg(F.expr("bit_or(shiftleft(1L, d)) AS mask"))


def starts(around: DataFrame) -> DataFrame:
    """number and starts (position, mask) of every text with repeated intervals. around: materialised."""
    large = cut(around.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("core"))
    found = merge(around)
    if large.count():
        few = small(large, 16)
        found = merge(around.join(few, "core", "left_anti")).unionByName(merge_large(around.join(few, "core", "left_semi")))
    return found.groupBy("number").agg(F.collect_list(F.struct("at", "mask")).alias("starts"))


def removed(size: int, whole, some) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes. whole: anchors all of whose strings are repeated; some: (anchor, mask)."""
    import numpy as np

    at = np.asarray(whole, np.int64)
    begin, end = np.maximum(at - SIDE, 0), np.minimum(at, size - LENGTH)
    begin, end = [begin[begin <= end]], [end[begin <= end] + LENGTH]
    if some:
        bits = np.array([m for _, m in some], "<i8").view(np.uint8).reshape(-1, 8)
        k, d = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
        start = np.array([a for a, _ in some], np.int64)[k] - d
        begin.append(start)
        end.append(start + LENGTH)
    begin, end = np.concatenate(begin), np.concatenate(end)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
    if not len(begin):
        return []
    new = np.r_[True, begin[1:] > end[:-1]]
    return list(zip(begin[new].tolist(), end[np.r_[new[1:], True]].tolist()))


SPANS = "number long, n_removed long, n_spans long, kept binary"


def cut_out(repeats: DataFrame, found: DataFrame, whole_characters: bool = False) -> DataFrame:
    """number, n_removed, n_spans and kept (the bytes that remain) of every text that loses bytes. With
    whole_characters, what a cut leaves of a character goes as well from kept."""

    def rows(batches):
        import numpy as np

        for batch in batches:
            out = {k: [] for k in ("number", "n_removed", "n_spans", "kept")}
            for number, text, x, s in zip(*(batch.column(k) for k in range(4))):
                data = text.as_buffer().to_pybytes()
                x = np.asarray(x.values)
                spans = removed(len(data), x[(x & ALL) > 0] >> 3, [(p["at"], p["mask"]) for p in s.as_py() or ()])
                if not spans:
                    continue
                edges = [0, *(e for s in spans for e in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                gone = len(data) - len(kept)
                kept = kept.decode(errors="ignore").encode() if whole_characters else kept
                for name, v in zip(out, (number.as_py(), gone, len(spans), kept)):
                    out[name].append(v)
            yield out

    return map_batches(repeats.join(found, "number", "left").select("number", "text", "known", "starts"), rows, SPANS)


def find_repeats(df: DataFrame, id_col: str, text_col: str, whole_characters: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(number, id, n_bytes, text_sha256, passive) of the index's texts, (number, n_removed, n_spans, and kept_sha256, or kept
    with whole_characters) of those of them that lose bytes, and the groups of equal texts. All are durable; what they were
    made from is deleted."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/suffix-{uuid.uuid4().hex}"
    secret = secrets.token_bytes(32)
    groups = cut(duplicate_groups(df, id_col, text_col).select("text_sha256", "keep_id", "group_size"))
    texts = index_texts(df, id_col, text_col, groups, f"{path}/texts")
    # texts with a repeat, few beside all, are written with what is known of them; all else is narrow
    marked = cut(known(texts, secret))
    release(spark)
    texts.select("number", "text").join(marked, "number").write.option("compression", "zstd").parquet(f"{path}/repeats")
    release(spark)
    repeats = spark.read.parquet(f"{path}/repeats")
    contexts(repeats, secret).write.option("compression", "zstd").parquet(f"{path}/around")
    begun = cut(starts(spark.read.parquet(f"{path}/around")))
    delete(spark, f"{path}/around")
    release(spark)
    index = cut(texts.select("number", "id", "n_bytes", "text_sha256", "passive"))
    found = cut_out(repeats, begun, whole_characters)
    if whole_characters:
        found.write.option("compression", "zstd").parquet(f"{path}-kept")
        found = spark.read.parquet(f"{path}-kept")
    else:
        found = cut(found.select("number", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
    delete(spark, path)
    release(spark)
    return index, found, groups


def spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 for every row."""
    texts, found, groups = find_repeats(df, id_col, text_col)
    alone = texts.where("NOT passive").select("number", "id", "n_bytes", "text_sha256")
    alone = alone.join(found, "number", "left").select(
        "id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "text_sha256").alias("kept_sha256"),
    )
    text = text_or_empty(text_col).cast("binary")
    copies = df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))
    copies = copies.join(small(groups, 96).select("text_sha256"), "text_sha256")
    gone = F.col("n_bytes") >= LENGTH
    copies = copies.select(
        "id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("text_sha256")).alias("kept_sha256"),
    )
    return alone.unionByName(copies)


def remove_repeats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with repeated strings taken out of its texts, which are otherwise as they were; where a cut splits a
    character, its remaining bytes go as well. No row goes, even if its text is empty then. Row identity is
    (id, text): rows that agree in both get the same text."""
    texts, found, groups = find_repeats(df, id_col, text_col, whole_characters=True)
    sha, kept, copy = free_names(df, "sha", "kept", "copy")
    new = texts.select("number", "text_sha256").join(found, "number").select(F.col("text_sha256").alias(sha), F.col("kept").cast("string").alias(kept))
    copies = small(groups, 96).select(F.col("text_sha256").alias(sha), F.lit(True).alias(copy))
    rows = df.withColumn(sha, F.sha2(text_or_empty(text_col).cast("binary"), 256)).join(copies, sha, "left").join(new, sha, "left")
    empty = F.col(copy) & (F.octet_length(text_or_empty(text_col)) >= LENGTH)
    text = F.when(empty, F.lit("")).otherwise(F.coalesce(F.col(kept), F.col(f"`{text_col}`")))
    return rows.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
