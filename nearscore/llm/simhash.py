"""SimHash fingerprints and near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at radius 2 or less have a common variant at distance 1 or less from both. So every distinct
fingerprint emits itself and its 64 single-bit variants; rows are shuffled on the variant; fingerprints that share
one are verified and linked. All that share a variant lie within distance 1 of it, at most 65 of them, and within
2 of each other, so a star to the least of them links them all and no pair is lost; nothing is capped. Documents with
equal fingerprints are one node, however many there are, and are never paired with each other.

near_classes() connects documents whose shingle sets have a Jaccard similarity of `similarity` or more, for which 64 bits
at radius 2 are too narrow. It makes several short fingerprints (tables) of one text from independent bits, hashes the ball
of each as above, and verifies what collides: first by some 120 more bits that travel with the rows, inside the bucket, so
that chance collisions are never emitted; then by all bits; then exactly, on the shingle sets. The tables' width follows
from the number of documents (buckets hold a few rows at every size), their number from the chance that a pair at exactly
`similarity` differs in at most 2 bits in one of them: RECALL. (Their width stops at 40 bits, which is enough for 2**37
documents; beyond, buckets grow with the corpus.) Nothing is capped:

1. Equal texts are one node. In the first tables each node names up to three partners a table, those with most collisions
   in its buckets, so a group of copies meets what it was made from: a few rows for each node, never a row for each pair.
   Those that all bits find likely are verified; the others are left to round 3.
2. In all tables, nodes that still collide with a node of another component are open. A pair shares no more
   shingles than either has in common with all other open nodes, which gives each a largest set that it could be similar
   enough to (Corpus.reach). It is exact, and leaves few of a family that shares a template just below the similarity.
3. All collisions in all tables of open nodes with a reach, in different components and within reach of each other, are
   looked at, whatever the size of the bucket. Each pair comes from the first table in which it
   collides, and 2,048 further bits that only open nodes have sort out most that are not similar enough. Of each two
   components the nearest pair is verified first, and then all other pairs of those that this has not merged: a text and
   a large group that it belongs to cost a pair a bucket, not one for each of the group.

Rounds 2 and 3 take AT_ONCE tables at a time and drop their shuffles, so the disk needed at once does not grow with the
number of tables. Buckets over HOT rows are split with salts (Balls). What remains quadratic is exact verification of texts that are nearly
similar enough, in different components, and made of each other's shingles.

Cases: null and empty texts, and texts of white space, have fingerprint zero, linked like any other; very long texts
are counted in blocks of shingles; repeated rows are rows of the same component; ties (equal fingerprints, ids or degrees) go
to the least id; an empty table gives an empty result; extra columns are not read, and near_dedup() returns them as they
were, whatever their names. near_classes() leaves out rows without an id or a word.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearscore.llm.common import BROADCAST_BYTES, components, cut, free_names, map_batches, release, small, table

SEED = 42
RADIUS = 2
BLOCK = 1 << 14
#: near_labels: the least similarity, words of a shingle, and the chance to find a pair at that similarity.
SIMILARITY, WORDS, RECALL = 0.8, 5, 0.995
#: A pair at the similarity passes a look at n of its bits unless it differs in this many standard deviations more.
SIGMAS = 3.5
#: In round 1 a pair is verified if it differs in no more than this many standard deviations more; others are left to round 3.
LIKELY = 1.0
#: Tables whose rows are shuffled at once; the disk that a round needs does not grow with the number of tables.
AT_ONCE = 4
#: Tables of the first round; pairs in buckets up to WIDE rows are found together, in larger ones by ROWS rows at a time;
#: buckets over HOT rows are split. Keys have less than KEY_BITS bits, salts the rest. SEEN ids are held in a task at most.
FIRST, WIDE, ROWS, HOT, KEY_BITS, SEEN = 2, 64, 256, 2048, 46, 1 << 20
#: Pairs whose further bits a task looks at at once.
LOOK = 1 << 14
#: Open nodes have so many times 64 further bits, which pairs are looked at by before they are verified.
FURTHER = 32


def shingle_hashes(text: str | None, words: int):
    """XXH64 of each shingle, in numpy blocks. Lower-cases A-Z only; words are split at ASCII white space."""
    import numpy as np
    import xxhash

    h = xxhash.xxh64_intdigest
    w = (text or "").encode().lower().split()
    if not w:
        return
    last = max(1, len(w) - words + 1)
    for at in range(0, last, BLOCK):
        n = min(BLOCK, last - at)
        part = w[at : at + n + words - 1]
        if len(part) < words:
            yield np.array([h(b" ".join(part), SEED)], dtype=np.uint64)
        else:
            yield np.fromiter((h(s, SEED) for s in map(b" ".join, zip(*(part[k:] for k in range(words))))), np.uint64, n)


def fingerprint(text: str | None, words: int) -> int:
    """64 bits, each 1 if it is set in over half of the shingles' hashes."""
    import numpy as np

    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id and fp (the 64 bits as a signed long) of every row."""

    def rows(batches):
        for batch in batches:
            f = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield {"id": batch.column(0), "fp": [x - (x >> 63 << 64) for x in f]}

    return map_batches(df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text"), rows, "id long, fp long")


def ball_links(fps: DataFrame) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) at 2 or fewer differing bits, stars for cliques."""
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    variants = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = variants.withColumn("least", F.min("fp").over(W.partitionBy("variant")))
    differing = F.bit_count(F.col("fp").bitwiseXOR(F.col("least")))
    return least.where((F.col("fp") > F.col("least")) & (differing <= RADIUS)).select(F.col("fp").alias("u"), F.col("least").alias("v"))


def near_groups(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, fp and component_id (the least id reachable over links) of every row."""
    docs = cut(fingerprints(df, id_col, text_col, words))
    fps = docs.groupBy("fp").agg(F.min("id").alias("least_id"))
    labels = components(ball_links(fps.select("fp")))
    nodes = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = nodes.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of = cut(nodes.join(ids, "label").select("fp", "component_id"))
    return docs.join(of, "fp").select("id", "fp", "component_id")


def bit_chance(similarity: float) -> float:
    """Chance that a bit differs between sets of equal size and this Jaccard similarity: their angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Number of tables and their width in bits for n documents."""
    bits, p = min(40, max(16, math.ceil(math.log2(max(n, 2))) + 1)), bit_chance(similarity)
    found = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(RADIUS + 1))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found))), bits


def _spread(h, k: int):
    """The k-th of any number of independent 64-bit hashes made from one."""
    import numpy as np

    x = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int):
    """Distinct shingle hashes, ascending."""
    import numpy as np

    parts = [*shingle_hashes(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def majority_bits(shingles, k: int):
    """The k-th 64 bits of a set: 1 where over half of its shingles' k-th hashes have a 1."""
    import numpy as np

    total = np.zeros(64, np.int64)
    for at in range(0, len(shingles), BLOCK):
        h = _spread(shingles[at : at + BLOCK], k)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * total > len(shingles)


def majority(shingles, k: int, kind: str) -> int:
    import numpy as np

    return int(np.packbits(majority_bits(shingles, k), bitorder="little").view(kind)[0])


def signature(shingles, tables: int, bits: int) -> tuple[int, list[int]]:
    """64 check bits and a fingerprint of `bits` bits for each table, over a set of shingle hashes."""
    import numpy as np

    rest = np.concatenate([majority_bits(shingles, k) for k in range(1, 1 + -(-tables * bits // 64))])[: tables * bits].reshape(tables, bits)
    return majority(shingles, 0, "<i8"), [int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little") for row in rest]


def signatures(texts: DataFrame, words: int, tables: int, bits: int) -> DataFrame:
    """id, sha (of the text), size (of the shingle set), check and tables of every row of texts (id, text) with a word."""

    def rows(batches):
        for batch in batches:
            out = {"id": [], "sha": [], "size": [], "check": [], "tables": []}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(s := shingle_set(t, words)):
                    for name, v in zip(out, (i, hashlib.sha256(t.encode()).digest(), len(s), *signature(s, tables, bits))):
                        out[name].append(v)
            yield out

    return map_batches(texts, rows, "id long, sha binary, size long, check long, tables array<long>")


class Buckets:
    """Pairs of rows that share a key, over columns sorted by key: key, mask, id, check, other, label and, if given, size,
    reach and tables.

    A pair counts where its labels differ, its bits in check and other differ in at most `most` places, and neither set is
    larger than the other's reach. Each pair of a table comes once: from the key of two equal fingerprints, or else from
    the lesser of the keys that lie between its two; with `tables` given, only from the first table in which it collides,
    and only if it differs in at most `most_of_all` of all bits.
    """

    def __init__(self, columns, bits: int, most: int, most_of_all: int):
        import numpy as np

        self.key, self.mask, self.id, self.check, self.other, self.label, *self.more = columns
        self.bits, self.most, self.most_of_all = bits, most, most_of_all
        self.border = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1], True])

    def _wanted(self, a, b):
        import numpy as np

        differ = self.mask[a] ^ self.mask[b]
        here = np.where(differ == 0, self.mask[a] == 0, self.key[a] < (self.key[a] ^ differ)) & (self.label[a] != self.label[b])
        here &= np.bitwise_count(self.check[a] ^ self.check[b]).astype(np.int16) + np.bitwise_count(self.other[a] ^ self.other[b]) <= self.most
        if self.more:
            size, reach = self.more[:2]
            here &= (size[a] <= reach[b]) & (size[b] <= reach[a])
        return here

    def _differing(self, a, b):
        """Bits of all in which pairs differ, and whether they collide in no earlier table."""
        import numpy as np

        tables = self.more[2]  # and further bits behind them
        d = np.bitwise_count(tables[a] ^ tables[b])
        t = (self.key[a] & ((1 << KEY_BITS) - 1)) >> self.bits
        earlier = ((d <= RADIUS) & (np.arange(tables.shape[1])[None] < t[:, None])).any(axis=1)
        return d.sum(axis=1, dtype=np.int64) + np.bitwise_count(self.check[a] ^ self.check[b]), ~earlier

    def _first(self, a, b):
        """(a, b, bits that differ) of those of pairs that collide in no earlier table and are near in all bits, LOOK pairs at a
        time: a pair's bits are many times its ids."""
        import numpy as np

        if not self.more:
            return a, b, np.zeros(len(a), np.int64)
        found = [(np.empty(0, np.int64),) * 3]
        for k in range(0, len(a), LOOK):
            x, y = a[k : k + LOOK], b[k : k + LOOK]
            d, keep = self._differing(x, y)
            keep &= d <= self.most_of_all
            found.append((x[keep], y[keep], d[keep]))
        return tuple(map(np.concatenate, zip(*found)))

    def _small(self, few):
        import numpy as np

        found = [(np.empty(0, np.int64),) * 2]
        for step in range(1, min(WIDE, len(self.key))):
            a = np.flatnonzero((self.key[step:] == self.key[:-step]) & few[:-step])
            if not len(a):
                break
            a = a[self._wanted(a, a + step)]
            found.append((a, a + step))
        yield self._first(*map(np.concatenate, zip(*found)))

    def _large(self, at: int, n: int):
        import numpy as np

        for k in range(at, at + n, ROWS):
            part, others = np.arange(k, min(k + ROWS, at + n)), np.arange(k, at + n)
            row, col = np.nonzero((others[None] > part[:, None]) & self._wanted(part[:, None], others[None]))
            yield self._first(part[row], others[col])

    def buckets(self):
        """(begin, end, index arrays (a, b, bits that differ), some at a time): small buckets together, then each larger one."""
        import numpy as np

        size = np.diff(self.border)
        yield 0, len(self.key), self._small(np.repeat(size <= WIDE, size))
        for at, n in zip(self.border[:-1][size > WIDE].tolist(), size[size > WIDE].tolist()):
            yield at, at + n, self._large(at, n)

    def pairs(self):
        for _, _, parts in self.buckets():
            yield from parts

    def partners(self):
        """(ids, ids) of named()."""
        for a, b, _, _ in self.named():
            yield a, b

    def named(self):
        """(ids, ids, degrees, kinds): of every row with pairs, its pair with the row that has the most. Hubs attract: copies
        meet what they were made from. Kinds tell a table's buckets apart by what a row differs in from their key: nothing, an
        even or an odd bit."""
        import numpy as np

        for begin, end, parts in self.buckets():
            n, parts = end - begin, [((a - begin).astype(np.int32), (b - begin).astype(np.int32)) for a, b, _ in parts if len(a)]
            degree = np.zeros(n, np.int64)
            for one in (x for pair in parts for x in pair):
                degree += np.bincount(one, minlength=n)
            order = np.lexsort((self.id[begin:end], -degree))
            rank, best = np.empty(n, np.int32), np.full(n, n, np.int32)
            rank[order] = np.arange(n)
            for a, b in parts:
                np.minimum.at(best, a, rank[b])
                np.minimum.at(best, b, rank[a])
            if len(row := np.flatnonzero(best < n)):
                other, mask = order[best[row]], self.mask[begin + row]
                kind = np.where(mask == 0, 0, np.where(mask & 0x5555555555555555 != 0, 1, 2))
                yield self.id[begin + row], self.id[begin + other], degree[other], ((self.key[begin + row] & ((1 << KEY_BITS) - 1)) >> self.bits) * 3 + kind

    def all(self):
        for a, b, _ in self.pairs():
            yield self.id[a], self.id[b]

    def labelled(self, nearest: bool = False):
        """(ids, ids, labels, labels, bits that differ) of all pairs, or of the nearest of each two labels, once a bucket or so."""
        import numpy as np

        for a, b, d in self.pairs():
            if nearest and len(a):
                low, high = np.minimum(self.label[a], self.label[b]), np.maximum(self.label[a], self.label[b])
                order = np.lexsort((d, high, low))
                low, high = low[order], high[order]
                first = order[np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]]
                a, b, d = a[first], b[first], d[first]
            yield self.id[a], self.id[b], self.label[a], self.label[b], d

    def paired(self):
        """ids of rows with pairs, each once a bucket or so."""
        import numpy as np

        for a, b, _ in self.pairs():
            if len(a):
                yield np.unique(np.r_[self.id[a], self.id[b]])


def by_key(batches, n: int):
    """The n columns of batches that come sorted by key, as arrays of whole buckets; a list column becomes a matrix."""
    import numpy as np

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy() for k in range(min(n, 8))]
        now[3] = now[3].view("u8")
        if n > 8:
            now.append(batch.column(8).flatten().to_numpy().view("u8").reshape(batch.num_rows, -1))
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if end := int(np.searchsorted(held[0], held[0][-1], "left")):
            yield [x[:end] for x in held]
            held = [x[end:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _matrix(of_nodes: DataFrame):
    """A broadcast of the ids of nodes, ascending, and their tables as a matrix; None if they are not under BROADCAST_BYTES."""
    import numpy as np

    width = of_nodes.select(F.size("tables")).first()
    if not width or of_nodes.count() * 8 * (width[0] + 1) > BROADCAST_BYTES:
        return None
    got = of_nodes.toArrow().combine_chunks().sort_by("id")
    tables = got["tables"].combine_chunks().flatten().to_numpy().view("u8").reshape(len(got), -1)
    return of_nodes.sparkSession.sparkContext.broadcast((got["id"].to_numpy().copy(), np.ascontiguousarray(tables)))


def partners(rows: DataFrame, bits: int, most: int) -> DataFrame:
    """u > v: of every row's partners in a table the one that has most collisions, for each of the kinds of Buckets.named():
    at most three a node and table, whatever the number of buckets."""
    n = len(rows.columns)

    def run(batches):
        import pyarrow as pa

        for columns in by_key(batches, n):
            for found in Buckets(columns, bits, most, 0).named():
                yield dict(zip(("id", "partner", "degree", "kind"), map(pa.array, found)))

    found = map_batches(rows.repartition("key").sortWithinPartitions("key"), run, "id long, partner long, degree long, kind long")
    best = found.groupBy("id", "kind").agg(F.max_by("partner", F.struct("degree", -F.col("partner"))).alias("partner"))
    return best.select(F.greatest("id", "partner").alias("u"), F.least("id", "partner").alias("v")).where("u <> v").distinct()


def all_pairs(rows: DataFrame, bits: int, most: int, most_of_all: int, sent=None, nearest: bool = False) -> DataFrame:
    """u > v, their labels and the bits in which they differ: all pairs that Buckets finds in rows with its columns, or the
    nearest of each two labels in a bucket. sent: what _matrix() sends to the tasks once, in place of a
    copy in each of a node's rows."""
    rows = rows.drop("tables") if sent else rows
    n = len(rows.columns)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for columns in by_key(batches, n):
            if sent:
                ids, tables = sent.value
                columns.append(tables[np.searchsorted(ids, columns[2])])
            for a, b, of_a, of_b, differ in Buckets(columns, bits, most, most_of_all).labelled(nearest):
                of_u, of_v = np.where(a > b, of_a, of_b), np.where(a > b, of_b, of_a)
                yield dict(zip(("u", "v", "label_u", "label_v", "differ"), map(pa.array, (np.maximum(a, b), np.minimum(a, b), of_u, of_v, differ))))

    found = map_batches(rows.repartition("key").sortWithinPartitions("key"), run, "u long, v long, label_u long, label_v long, differ long")
    return found.where("u <> v").distinct()


def paired(rows: DataFrame, bits: int, most: int, known: DataFrame) -> DataFrame:
    """id of every row that shares a key with another in a way that counts, and those in known. rows: of Buckets."""
    n = len(rows.columns)
    rows = rows.join(small(known, 16).withColumn("known", F.lit(1).cast("long")), "id", "left")
    rows = rows.select("key", "mask", "id", "check", "other", "label", F.coalesce("known", F.lit(0).cast("long")).alias("known"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen, total = [], 0
        for columns in by_key(batches, n + 1):
            known = columns.pop()
            new = np.unique(columns[2][known == 0])
            for ids in Buckets(columns, bits, most, 0).paired():
                seen.append(np.intersect1d(ids, new, assume_unique=True))
                total += len(seen[-1])
            if total >= SEEN:
                yield {"id": pa.array(np.unique(np.concatenate(seen)))}
                seen, total = [], 0
        if seen:  # each once a task, or once in a while
            yield {"id": pa.array(np.unique(np.concatenate(seen)))}

    return map_batches(rows.repartition("key").sortWithinPartitions("key"), run, "id long").union(known).distinct()


class Balls:
    """The balls of all fingerprints of nodes (id, size, check, tables), as rows with a key.

    Buckets of more than HOT rows are split: the key gets a salt, and rows that all others of the bucket have to meet go
    to every part. A bucket can only be as large as that if one of its bits + 1 fingerprints has its share of HOT, so these are
    found by counting fingerprints, not variants.
    """

    def __init__(self, nodes: DataFrame, tables: int, bits: int, hot_rows: int = 0):
        self.bits, hot_rows = bits, hot_rows or HOT
        self.tables, self.others = tables, min(tables - 1, 63 // bits)
        self.masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(bits)))
        own = nodes.select("id", F.posexplode("tables").alias("t", "value"))
        heavy = own.groupBy("t", "value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where(F.col("n") > hot_rows // (bits + 1))
        keys = cut(heavy).select("t", "value", "n", "rep", F.explode(self.masks).alias("mask")).select(self._key("t", "value", F.col("mask")), "n", "rep")
        hot = keys.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "rep"))["rep"].alias("rep")).where(F.col("n") > hot_rows)
        self.hot = cut(hot.select("key", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts"), "rep"))
        self.any_hot = not self.hot.isEmpty()

    def _key(self, t: str, value: str, mask):
        return (F.shiftleft(F.col(t).cast("long"), self.bits) + F.col(value).bitwiseXOR(mask)).alias("key")

    def in_hot(self, nodes: DataFrame) -> DataFrame:
        """id of nodes with a row in a bucket that is split."""
        each = nodes.select("id", F.posexplode("tables").alias("t", "value")).select("id", "t", "value", F.explode(self.masks).alias("mask"))
        return each.select("id", self._key("t", "value", F.col("mask"))).join(small(self.hot.select("key"), 16), "key", "left_semi").select("id")

    def parts(self) -> list[range]:
        """The tables, AT_ONCE at a time."""
        return [range(t, min(t + AT_ONCE, self.tables)) for t in range(0, self.tables, AT_ONCE)]

    def rows(self, nodes: DataFrame, part: range) -> DataFrame:
        """The columns of Buckets for nodes, of some tables. Where a bucket is split, the rows whose
        label is not that of its representative go to every part, or the representative alone as long as labels are ids."""
        more = ["label", "size", "reach", "tables"] if "reach" in nodes.columns else ["label"] if "label" in nodes.columns else []
        each = nodes.select("id", "check", "tables", *more[:3], F.posexplode(F.slice("tables", part.start + 1, len(part))).alias("t", "value"))
        each = each.withColumn("t", F.col("t") + part.start)
        # 64 bits more of a row are those of the tables that follow its own
        other = F.lit(0).cast("long")
        for k in range(self.others):
            other = other.bitwiseOR(F.shiftleft(F.element_at("tables", F.pmod(F.col("t") + 1 + k, F.lit(self.tables)) + 1), self.bits * k))
        each = each.select("id", "check", other.alias("other"), *more, "t", "value").select("*", F.explode(self.masks).alias("mask"))
        each = each.select(self._key("t", "value", F.col("mask")), "mask", "id", "check", "other", *more)
        label = F.col("label") if "label" in more else F.col("id").alias("label")
        if not self.any_hot:
            return each.select("key", "mask", "id", "check", "other", label, *more[1:])
        hot = self.hot
        if "label" in more:  # the representatives' labels
            hot = cut(hot.join(nodes.select(F.col("id").alias("rep"), F.col("label").alias("of")), "rep", "left"))
            everywhere = ~F.col("label").eqNullSafe(F.col("of"))
        else:
            everywhere = F.col("id") == F.col("rep")
        salt = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(everywhere, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(salt))
        spread = each.join(small(hot, 40), "key", "left").withColumn("salt", F.explode(parts))
        key = (F.col("key") + F.shiftleft(F.col("salt").cast("long"), KEY_BITS)).alias("key")
        return spread.select(key, "mask", "id", "check", "other", label, *more[1:])


def ends(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(F.col("u").alias(name)).union(pairs.select(F.col("v").alias(name)))


class Corpus:
    """Distinct texts with words as nodes: their signatures, and their shingle sets when asked for."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, words: int, similarity: float, recall: float):
        self.words, self.similarity = words, similarity
        self.texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id IS NOT NULL")
        self.tables, self.bits = tables_for(df.count(), similarity, recall)
        self.docs = cut(signatures(self.texts, words, self.tables, self.bits))
        # equal texts have equal signatures and are one node, however many rows have them
        classes = self.docs.groupBy("sha", "size", "check", "tables").agg(F.min("id").alias("least_id"))
        self.nodes = cut(classes.withColumn("id", F.monotonically_increasing_id()))

    def most(self, width: int, sigmas: float = SIGMAS) -> int:
        """Bits out of `width` in which a pair at the similarity differs at most; one in 4,000 such pairs differs in more."""
        p = bit_chance(self.similarity)
        return math.floor(width * p + sigmas * math.sqrt(width * p * (1 - p)))

    def sets(self, ids: DataFrame, further: int = 0) -> DataFrame:
        """id and shingles of nodes, and in `further` so many times 64 further bits. ids: materialised."""
        words, first = self.words, 1 + -(-self.tables * self.bits // 64)

        def rows(batches):
            import numpy as np
            import pyarrow as pa

            def lists(arrays):
                ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))

            for batch in batches:
                sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
                more = [np.array([majority(x, first + k, "<i8") for k in range(further)], np.int64) for x in sets]
                yield {"id": batch.column(0), "shingles": lists([x.view("i8") for x in sets]), "further": lists(more)}

        wanted = small(cut(self.nodes.join(small(ids, 16), "id").select("sha", "id", "least_id")), 64)
        # one row of each text: the one with its least id (a repeated row gives its set twice, which distinct ids undo)
        texts = self.texts.withColumnRenamed("id", "least_id").withColumn("sha", F.unhex(F.sha2("text", 256))).join(wanted, ["sha", "least_id"])
        return map_batches(texts.select("id", "text"), rows, "id long, shingles array<long>, further array<long>")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (u, v, materialised) that are similar enough, exactly."""
        sets = cut(self.sets(cut(ends(pairs, "id").distinct())))
        # sets under the limit go to the pairs; beyond it pairs and sets are shuffled
        total = sets.agg(F.sum(F.size("shingles") * 8 + 64)).first()[0] or 0
        sets = F.broadcast(sets) if total <= BROADCAST_BYTES else sets
        a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "uv")
        both = pairs.join(a, "u").join(b, "v").withColumn("shared", F.size(F.array_intersect("set_u", "set_v")))
        exact = F.col("shared") / (F.size("set_u") + F.size("set_v") - F.col("shared"))
        links = cut(both.where(exact >= self.similarity).select("u", "v").distinct())
        del pairs, sets, a, b, both
        release(self.nodes.sparkSession)
        return links

    def near_in_bits(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (u, v) that differ in few enough of all bits, and in how many."""
        a, b = (self.nodes.select(F.col("id").alias(x), F.col("check").alias(f"check_{x}"), F.col("tables").alias(f"tables_{x}")) for x in "uv")
        differing = F.bit_count(F.col("check_u").bitwiseXOR(F.col("check_v"))) + F.aggregate(
            F.zip_with("tables_u", "tables_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
        )
        return cut(pairs.join(a, "u").join(b, "v").select("u", "v", differing.alias("differ")).where(F.col("differ") <= self.most(64 + self.tables * self.bits)))

    def labelled(self, links: DataFrame) -> DataFrame:
        """nodes with the label of their component, their own id if they have no link."""
        labels = components(links).withColumnRenamed("node", "id")
        return self.nodes.join(small(labels, 24), "id", "left").withColumn("label", F.coalesce("label", "id"))

    def reach(self, ids: DataFrame) -> DataFrame:
        """id, reach and FURTHER bits of nodes. reach: the largest set with which they could be similar enough, if all the shingles that they
        have in common with any other of these nodes were in it. Only nodes that can reach a set as small as they allow.

        Sets of a and b shingles at a similarity s or more share at least s / (1 + s) * (a + b), and a node cannot
        share more than it has in common with all others; so b is at most common * (1 + s) / s - a."""
        s = self.similarity
        sets = cut(self.sets(ids, FURTHER))
        each = sets.select("id", F.explode("shingles").alias("shingle"))
        several = cut(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle"))
        common = each.join(several, "shingle").groupBy("id").agg(F.count(F.lit(1)).alias("common"))
        reach = F.floor(F.col("common") * ((1 + s) / s) - F.col("size") + 1e-6).cast("long")
        out = common.join(self.nodes.select("id", "size"), "id").withColumn("reach", reach)
        out = out.where(F.col("reach") >= F.floor(F.col("size") * s)).select("id", "reach")
        return cut(out.join(sets.select("id", "further").dropDuplicates(["id"]), "id"))


def near_labels(corpus: Corpus, hot_rows: int = 0) -> DataFrame:
    """id and label of nodes: those with one label are connected by pairs whose shingle sets have at least the similarity.
    The module's text tells of the rounds. What round 3 links are the labels of round 1, so its graph is a small one."""
    nodes, balls = corpus.nodes, Balls(corpus.nodes, corpus.tables, corpus.bits, hot_rows)
    most, most_of_all = corpus.most(64 + balls.others * corpus.bits), corpus.most(64 * (1 + FURTHER) + corpus.tables * corpus.bits)
    # 1: likely partners in a few tables
    tried = corpus.near_in_bits(cut(partners(balls.rows(nodes, range(min(FIRST, corpus.tables))), corpus.bits, most)))
    tried = cut(tried.where(F.col("differ") <= corpus.most(64 + corpus.tables * corpus.bits, LIKELY)).select("u", "v"))
    links = corpus.verified(tried)
    # 2: nodes with collisions outside their component, and of these the ones that can be similar enough to any other
    labelled = cut(corpus.labelled(links))
    label = labelled.select("id", "label")
    open_ = cut(balls.in_hot(labelled).distinct() if balls.any_hot else nodes.select("id").limit(0))
    for part in balls.parts():
        open_ = cut(paired(balls.rows(labelled, part), corpus.bits, most, open_))
        release(nodes.sparkSession)
    reach = small(corpus.reach(open_), 24 + 8 * FURTHER)
    able = cut(labelled.join(reach, "id").withColumn("tables", F.concat("tables", "further")).drop("further"))
    release(nodes.sparkSession)
    # 3: all their collisions that are left, of any two components the nearest first
    sent, links = _matrix(able.select("id", "tables")), None
    for nearest in (True, False):
        rest = []
        for part in balls.parts():  # each pair comes from one table
            found = all_pairs(balls.rows(able, part), corpus.bits, most, most_of_all, sent, nearest)
            rest.append(cut(found.join(tried, ["u", "v"], "left_anti")))
            release(nodes.sparkSession)
        rest = reduce(DataFrame.unionByName, rest)
        if nearest:
            rest = rest.groupBy(F.least("label_u", "label_v").alias("label_u"), F.greatest("label_u", "label_v").alias("label_v"))
            rest = cut(rest.agg(F.min(F.struct("differ", "u", "v")).alias("pair")).select("pair.u", "pair.v", "label_u", "label_v"))
        similar = cut(corpus.verified(rest.select("u", "v")).join(rest, ["u", "v"]).select(F.col("label_u").alias("u"), F.col("label_v").alias("v")))
        links = similar if links is None else links.union(similar)
        if nearest:
            merged = small(components(links).toDF("label", "least"), 24)
            able = able.join(merged, "label", "left").withColumn("label", F.coalesce("least", "label")).drop("least")
            able, tried = cut(able), cut(tried.union(rest.select("u", "v")))
            release(nodes.sparkSession)
    merged = components(links).toDF("label", "least")
    return label.join(small(merged, 24), "label", "left").select("id", F.coalesce("least", "label").alias("label"))


def near_classes(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, hot_rows: int = 0) -> DataFrame:
    """id, sha (of the text, binary) and class_id (the least id of those that links connect, itself included) of every row
    with an id and a word."""
    corpus = Corpus(df, id_col, text_col, words, similarity, recall)
    nodes = cut(corpus.nodes.join(near_labels(corpus, hot_rows), "id").select("sha", "least_id", "label"))
    classes = nodes.groupBy("label").agg(F.min("least_id").alias("class_id"))
    of = cut(nodes.join(classes, "label").select("sha", "class_id"))
    return corpus.docs.select("id", "sha").join(of, "sha").select("id", "sha", "class_id")


def near_dedup(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """df without near copies, all columns as they were: of each class the rows with its least id stay. Of rows that share
    that id but not the text, the ones in the class stay too, as rows are told apart by id and text. Rows without an id or
    a word stay."""
    classes = near_classes(df, id_col, text_col, words, similarity)
    key, sha = free_names(df, "key", "sha")
    gone = small(cut(classes.where("id <> class_id").select(F.col("id").alias(key), F.col("sha").alias(sha)).distinct()), 64)
    text = F.unhex(F.sha2(F.col(f"`{text_col}`").cast("string").cast("binary"), 256))
    return df.join(gone, (F.col(f"`{id_col}`").cast("long") == F.col(key)) & (text == F.col(sha)), "left_anti")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), "doc_id", "text", 3).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
