import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearscore.llm import bpe, exact, packing, sharding, simhash, tokens


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def check_shards(rows, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, n)
        if r.key is not None:
            assert (r.shard, r.grown_shard) == (jump(r.key % 2**64, n), jump(r.key % 2**64, n + 1))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("n", [1, 24, 1000])
def test_shards_are_those_of_the_published_loop(spark, n):
    df = spark.range(300).selectExpr("id * 7919 - 1000 as doc_id", "cast(id as string) as text")
    check_shards(sharding.shard_rows(df, "doc_id", "text", n).collect(), n)


def test_sharding_awkward_rows(awkward, no_rows):
    rows = sharding.shard_rows(awkward, "doc_id", "text", 24).collect()
    assert len(rows) == awkward.count()
    check_shards(rows, 24)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in awkward.collect())
    assert Counter((r.key, r["size"], r.text_crc32) for r in rows) == want
    assert sharding.shard_rows(no_rows, "doc_id", "text", 24).count() == 0


def test_write_sharded(awkward, tmp_path, spark):
    """Also rows without a key: each lies in the shard that shard_rows() gives it."""
    df = awkward.withColumn("SHARD", sharding.F.lit("mine")).union(spark.range(200).selectExpr("cast(null as long)", "'text ' || id", "'x'", "1", "2", "'id'", "'mine'"))
    sharding.write_sharded(df, str(tmp_path / "out"), "doc_id", "text", 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    got = Counter((r.doc_id, zlib.crc32((r.text or "").encode()), r.shard_) for r in back.collect())
    assert got == Counter((r.key, r.text_crc32, r.shard) for r in sharding.shard_rows(df, "doc_id", "text", 5).collect())
    assert len({s for i, _, s in got if i is None}) == 5


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return Counter((i, keep[t or ""] if keep[t or ""] is not None else i, len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_exact_dedup(awkward, no_rows, documents, limit):
    for df in (awkward, no_rows, documents.select("doc_id", "text")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = Counter((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.dedup_decisions(df, "doc_id", "text", limit).collect())
        assert got == exact_brute(rows)
    kept = exact.exact_dedup(awkward, "doc_id", "text", limit)
    assert kept.columns == awkward.columns
    assert {r.text or "" for r in kept.collect()} == {r.text or "" for r in awkward.collect()}


def test_exact_dedup_keeps_columns_named_as_its_own(spark):
    rows = [(k, "one text" if k < 3 else f"text {k}", f"mine {k}", k, k) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sha string, Keep long, size long")
    for limit in (1 << 20, 0):
        got = exact.exact_dedup(df, "doc_id", "text", limit)
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == rows[2:]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.word_bpe())


def test_bpe_equals_library(library, documents, awkward):
    b, fast = bpe.load(tokens.word_bpe()), bpe.load(tokens.word_bpe(), library_merges=True)
    assert b.merges.proper and 0 < b.merges.lookahead < 5000
    rng, alphabet = random.Random(3), [*"aabbccddeeffthhéàßſİıŉΣσςΑ'’!! \t\n\x0b\x1c\x85\xa0  019²½́漢字한😀", "<|endoftext|>", "'ll", "ation"]
    texts = [r.text for r in documents.limit(200).collect()] + [r.text for r in awkward.collect()]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(1500)]
    texts += ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "th", "aeinrst", "a", "é", "!?-") for n in (300, 3000, 20000)]
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert b.encode(t) == ids and fast.encode(t) == ids
        assert b.decode(ids) == text
        n, d, s = bpe.digests(b, t)
        assert (n, d, s) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_blocks(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    b = bpe.Bpe(tokens.word_bpe())
    for t in ("one two  three\n\n four   " * 9, "x" * 100 + " y" * 60, "é漢 \t a" * 30):
        assert b.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_stream_equals_whole_for_random_merge_lists():
    """The computed lookahead against merging all at once, on made-up proper lists."""
    rng = random.Random(5)
    for _ in range(150):
        vocab = {c: k for k, c in enumerate("abc")}
        merges = []
        while len(merges) < 14:
            u, v = rng.choice([*vocab]), rng.choice([*vocab])
            if u + v not in vocab and len(u + v) < 9:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
        m = bpe.Merges(vocab, merges)
        assert m.proper
        size = {i: len(t) for t, i in vocab.items()}
        for _ in range(8):
            s = [vocab[rng.choice("abc")] for _ in range(rng.randrange(1, 300))]
            assert [*m.stream(s, size, block=4)] == m.merge(s.copy())


def test_decoder_holds_unfinished_characters():
    d, text = bpe.Decoder(), "é漢😀a"
    assert "".join(d.feed(bytes([x])) for x in text.encode()) + d.feed(b"", True) == text
    d = bpe.Decoder()
    assert d.feed("😀".encode()[:2]) + d.feed(b"", True) == "�"


def test_tokens_frames(awkward, no_rows, library):
    ids = tokens.encode(awkward, "doc_id", "text", tokens.word_bpe())
    back = {r.id: r.text for r in tokens.decode(ids, "id", "ids", tokens.word_bpe()).collect() if r.id is not None}
    for r in awkward.collect():
        if r.doc_id is not None:
            assert back[r.doc_id] == library.decode(library.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)
    assert tokens.digests(no_rows, "doc_id", "text", tokens.word_bpe()).count() == 0


def test_packing(awkward, no_rows, documents, library):
    for df in (documents, awkward):
        rows = df.select("doc_id", "text").collect()
        got = packing.pack_documents(df, "doc_id", "text", tokens.word_bpe()).collect()
        want = Counter()
        for r in rows:
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
            for k in range(0, len(ids), 2048):
                part = np.array(ids[k : k + 2048], "<u4").tobytes()
                want[r.doc_id, k // 2048, k, len(part) // 4, zlib.crc32(part)] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        total = sum(r.length for r in got)
        for s in sequences.values():
            s.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0 and sum(s[-1]) <= 2048
        assert len(sequences) <= -(-total // 2048) * 1.03 + 1
    assert packing.pack_documents(no_rows, "doc_id", "text", tokens.word_bpe()).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(40):
        counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(20)}
        rows, used = packing.plan(counts, 64), defaultdict(list)
        for length, a, b, first, at in rows:
            for k in range(b - a):
                used[first + k].append((at, length))
        assert sum(b - a for _, a, b, _, _ in rows) == sum(counts.values())
        assert all(sorted(s) == s and sum(s[-1]) <= 64 and sum(n for _, n in s) == sum(s[-1]) for s in used.values())
        bins = []
        for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            room = min((b for b in bins if b >= length), default=None)
            if room is None:
                bins.append(64 - length)
            else:
                bins[bins.index(room)] -= length
        assert len(used) <= len(bins) + 1


def simhash_brute(rows, words=3):
    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    fps = [(i, fp(t)) for i, t in rows]
    label = list(range(len(fps)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                label[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(fps):
        if i is not None:
            least[root(a)].append(i)
    return Counter((i, f, min(least[root(a)], default=None)) for a, (i, f) in enumerate(fps))


def test_simhash(awkward, no_rows, documents):
    for df in (awkward, documents.limit(400)):
        got = Counter((r.id, r.fp % 2**64, r.component_id) for r in simhash.near_groups(df, "doc_id", "text", 3).collect())
        assert got == simhash_brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert simhash.near_groups(no_rows, "doc_id", "text", 3).count() == 0


def test_ball_links_reach_what_all_pairs_reach(spark):
    rng = random.Random(4)
    fps = {rng.randrange(2**64) for _ in range(30)}
    for f in [*fps] * 3:
        for _ in range(6):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
            f = rng.choice([*fps])
    signed = [(i, f - (f >> 63 << 64)) for i, f in enumerate(fps)]
    from nearscore.llm.common import components

    links = simhash.ball_links(spark.createDataFrame(signed, "i long, fp long"))
    got = {r.node % 2**64: r.label for r in components(links).collect()}
    root = {f: f for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    classes, mine = defaultdict(set), defaultdict(set)
    for f in fps:
        classes[find(f)].add(f)
        mine[got.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def connected(links):
    root = {x: x for p in links for x in p}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for x in root:
        groups[find(x)].add(x)
    return [*groups.values()]


def shingle_sets(rows):
    return {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in rows}


def all_links(sets):
    return {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0}


def classes_of(df, **more):
    out = defaultdict(set)
    for r in simhash.near_classes(df, "doc_id", "text", **more).collect():
        out[r.class_id].add(r.id)
    assert all(c == min(ids) for c, ids in out.items())
    return [g for g in out.values() if len(g) > 1]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def merges(groups):
    return sum(map(len, groups)) - len(groups)


def changed(rng, base, share, mark):
    return " ".join(w if rng.random() > share else f"{mark}{k}" for k, w in enumerate(base))


def test_a_large_group_of_near_copies(spark, hot_rows=40):
    """With buckets that are split."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(k, changed(rng, base, 0.01, f"x{k}")) for k in range(400)]
    assert len(all_links(shingle_sets(rows))) > 30_000
    want, got = connected(all_links(shingle_sets(rows))), classes_of(frame(spark, rows), hot_rows=hot_rows)
    assert merges(got) >= merges(want) - 1 and len(got) == len(want) == 1


def test_groups_around_the_similarity(spark):
    """Six groups of texts at about 0.8 from each other: every merge of all pairs' links is found."""
    rng, rows = random.Random(12), []
    for g in range(6):
        base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
        rows += [(1000 * g + k, changed(rng, base, 0.01 + 0.002 * (k % 8), f"y{g}x{k}")) for k in range(130)]
    want, got = connected(all_links(shingle_sets(rows))), classes_of(frame(spark, rows))
    assert all(any(g <= w for w in want) for g in got)
    assert merges(want) > 50 and merges(got) == merges(want)


def test_bucket_pairs_are_all_pairs_at_two_bits():
    rng = np.random.default_rng(3)
    for n, bits in ((60, 8), (300, 6), (700, 4), (1500, 3)):
        value, label = rng.integers(0, 1 << bits, n), rng.integers(0, n // 3, n)
        check, other = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
        mask = np.r_[0, 1 << np.arange(bits)]
        key, ids = (value[:, None] ^ mask[None]).ravel(), np.repeat(np.arange(n), bits + 1)
        order = np.argsort(key, kind="stable")
        columns = [key[order], np.tile(mask, n)[order], ids[order], check[ids][order], other[ids][order], label[ids][order]]
        found = Counter(p for a, b in simhash.Buckets(columns, bits, 62, 0).all() for p in zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist()))
        differ = lambda x: np.bitwise_count(x[:, None] ^ x[None]).astype(int)
        near = (differ(value) <= 2) & (differ(check) + differ(other) <= 62) & (label[:, None] != label[None])
        assert found == Counter(zip(*(x.tolist() for x in np.nonzero(np.tril(near, -1)))))
        paired = {i for a in simhash.Buckets(columns, bits, 62, 0).paired() for i in a.tolist()}
        assert paired == {i for p in found for i in p}
        partners = [*simhash.Buckets(columns, bits, 62, 0).partners()]
        assert {i for a, _ in partners for i in a.tolist()} == paired and sum(len(a) for a, _ in partners) <= len(key)


def template_family(members, planted, seed):
    """Documents that share 88 of 100 words (Jaccard similarity 0.78 on five-word shingles), and copies of some of them at
    0.82 to 0.88."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    shared = [word() for _ in range(88)]
    rows = [(k, shared + [word() for _ in range(12)]) for k in range(members)]
    for k in range(planted):
        same = 91 + k % 4
        rows.append((members + k, rows[k][1][:same] + [word() for _ in range(100 - same)]))
    return [(k, " ".join(w)) for k, w in rows]


def test_copies_inside_a_family_below_the_similarity_are_found(spark):
    got = classes_of(frame(spark, template_family(600, 60, 1)))
    assert sorted(map(sorted, got)) == [[k, 600 + k] for k in range(60)]


def test_most_of_a_family_below_the_similarity_is_never_tried(spark):
    corpus = simhash.Corpus(frame(spark, template_family(400, 20, 2)), "doc_id", "text", 5, 0.8, 0.995)
    reach = {r.id: r.reach for r in corpus.reach(corpus.nodes.select("id")).collect()}
    size = {r.id: r["size"] for r in corpus.nodes.collect()}
    able = sum(size[a] <= reach[b] and size[b] <= reach[a] for a in reach for b in reach if a > b)
    assert 20 <= able < 0.02 * 420 * 419 / 2


def test_partners_grow_with_nodes_and_not_with_buckets(spark):
    """A group of near copies whose members meet in most of their buckets: a few partners each, and still one class."""
    rng = random.Random(14)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(k, changed(rng, base, 0.01, f"z{k}")) for k in range(400)]
    corpus = simhash.Corpus(frame(spark, rows), "doc_id", "text", 5, 0.8, 0.995)
    balls = simhash.Balls(corpus.nodes, corpus.tables, corpus.bits)
    tried = simhash.partners(balls.rows(corpus.nodes, range(simhash.FIRST)), corpus.bits, corpus.most(64 + balls.others * corpus.bits))
    assert 399 <= tried.count() <= 400 * 3 * simhash.FIRST
    assert len(classes_of(frame(spark, rows))) == 1


def test_tables_at_once_cover_all_rows(spark):
    """Parts of the tables have the rows of all, also where nodes have further bits behind their tables."""
    corpus = simhash.Corpus(frame(spark, template_family(50, 5, 3)), "doc_id", "text", 5, 0.8, 0.995)
    balls = simhash.Balls(corpus.nodes, corpus.tables, corpus.bits)
    further = corpus.nodes.select("id", "check", F.col("id").alias("label"), F.col("size"), F.col("size").alias("reach"), F.concat("tables", F.array_repeat(F.lit(-1).cast("long"), 3)).alias("tables"))
    parts = balls.parts()
    assert [t for p in parts for t in p] == list(range(corpus.tables)) and max(map(len, parts)) <= simhash.AT_ONCE
    for nodes in (corpus.nodes, further):
        rows = [r for p in parts for r in balls.rows(nodes, p).collect()]
        assert len({(r.key, r.id) for r in rows}) == len(rows) == 55 * corpus.tables * (corpus.bits + 1)
        assert max(r.key for r in rows) >> corpus.bits == corpus.tables - 1


def test_near_classes_equal_brute_force(spark, documents, awkward, no_rows):
    rng = random.Random(6)
    rows = [(r.doc_id, r.text) for r in documents.dropDuplicates(["text"]).limit(250).collect()]
    for k, (_, t) in enumerate(rows[:120]):
        w = t.split()
        for _ in range(max(1, len(w) // rng.randrange(40, 120))):
            w[rng.randrange(len(w))] = "changed"
        rows.append((10_000 + k, " ".join(w)))
    df, sets = frame(spark, rows), shingle_sets(rows)
    want, got = connected(all_links(sets)), classes_of(df)
    assert merges(want) > 50
    assert all(any(g <= w for w in want) for g in got) and merges(got) >= 0.99 * merges(want)
    kept = {r.doc_id for r in simhash.near_dedup(df, "doc_id", "text").collect()}
    assert kept == set(sets) - {x for g in got for x in g} | {min(g) for g in got}
    assert simhash.near_dedup(no_rows, "doc_id", "text").count() == 0
    out = simhash.near_dedup(awkward, "doc_id", "text")
    assert out.columns == awkward.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in awkward.collect()} - {1, 13}


def test_near_dedup_with_repeated_ids_and_clashing_names(spark):
    """A row is told by its id and its text: a unique text stays though another row of its id is a near copy."""
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, 7, "a", None), (2, text + " more", 8, "b", None), (2, "a unique text that shares its id with a near copy", 9, "c", 1), (None, text, 10, "d", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, SHA string, __gone int")
    out = simhash.near_dedup(df, "doc_id", "text")
    assert out.columns == df.columns
    assert sorted(r.key for r in out.collect()) == [7, 9, 10]


def test_tables_grow_with_documents():
    few, many = simhash.tables_for(10**4, 0.8, 0.995), simhash.tables_for(10**9, 0.8, 0.995)
    assert few[1] < many[1] and few[0] < many[0]


def test_a_text_and_a_large_group_cost_few_pairs(spark, monkeypatch):
    """Groups at about the similarity, whose members meet in many buckets: of two components the nearest pair is verified first."""
    rng, rows, tried = random.Random(12), [], []
    for g in range(6):
        base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
        rows += [(1000 * g + k, changed(rng, base, 0.01 + 0.0012 * (k % 8), f"y{g}x{k}")) for k in range(130)]
    exact = simhash.Corpus.verified
    monkeypatch.setattr(simhash.Corpus, "verified", lambda self, pairs, *more, **named: tried.append(pairs.count()) or exact(self, pairs, *more, **named))
    want, got = connected(all_links(shingle_sets(rows))), classes_of(frame(spark, rows))
    assert merges(got) == merges(want)
    assert sum(tried) < 8 * len(rows), tried


def test_pairs_of_a_large_bucket_are_looked_at_in_parts():
    """1,500 rows under one key, a million pairs: their further bits are never all held at once, and none of them is lost."""
    rng = np.random.default_rng(5)
    n, bits = 1500, 17
    tables = np.repeat(rng.integers(0, 1 << bits, (1, 40), dtype=np.uint64), n, axis=0)
    same = np.zeros(n, np.int64)
    columns = [same, same, np.arange(n), same.view("u8"), same, np.arange(n), same + 100, same + 100, tables]
    tracemalloc.start()
    found = sum(len(pair[0]) for pair in simhash.Buckets(columns, bits, 62, 300).all())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * (n - 1) // 2 and peak < 100e6
    assert sum(len(found[0]) for found in simhash.Buckets([*columns[:5], np.arange(n) % 3, *columns[6:]], bits, 62, 300).labelled(nearest=True)) <= 3 * -(-n // simhash.ROWS)
