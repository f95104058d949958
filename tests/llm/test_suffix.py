import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from nearscore.llm import suffix


def brute(rows, m=suffix.LENGTH):
    data = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[k : k + m] for _, b in data for k in range(len(b) - m + 1))
    out, texts = Counter(), {}
    for i, b in data:
        spans = []
        for k in range(len(b) - m + 1):
            if n[b[k : k + m]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + m
                else:
                    spans.append([k, k + m])
        edges = [0, *(x for s in spans for x in s), len(b)]
        kept = b"".join(b[p:q] for p, q in zip(edges[::2], edges[1::2]))
        out[i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()] += 1
        texts[i, b.decode()] = kept.decode(errors="ignore")
    return out, texts


def planted(seed, n=120):
    """Texts that share passages of 150 to 320 bytes, at borders, overlapping, in themselves, with changed bytes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(120)[: rng.randrange(150, 321)] for _ in range(6)] + ["ab" * 140, "x" * 230, "abc" * 66 + "ab", "abc" * 66 + "a"]
    out = []
    for k in range(n):
        parts = [prose(rng.randrange(0, 60)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.3:
                cut = rng.randrange(len(p))
                p = p[:cut] + "#" + p[cut + 1 :]
            if rng.random() < 0.3:
                p = p[rng.randrange(60) :]
            parts.insert(rng.randrange(len(parts) + 1), p)
        out.append((k, "".join(parts)))
    return out + [(n, out[0][1] * 3), (n + 1, out[5][1]), (n + 1, out[5][1]), (n + 2, None), (n + 3, "")]


@pytest.mark.parametrize("seed,large", [(1, 1024), (2, 1024), (2, 1)])
def test_planted_repeats(spark, seed, large, monkeypatch):
    monkeypatch.setattr(suffix, "LARGE", large)
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, texts = brute(rows)
    assert sum(1 for w in want if w[2]) > 30
    assert Counter(map(tuple, suffix.spans(df, "doc_id", "text").collect())) == want
    got = suffix.remove_repeats(df.withColumn("number", suffix.F.lit(1)), "doc_id", "text")
    assert got.columns == ["doc_id", "text", "number"]
    assert Counter(r.text or "" for r in got.collect()) == Counter(texts[i, t or ""] for i, t in rows)


def test_documents_and_awkward_rows(documents, awkward, no_rows):
    for df in (documents, awkward):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert Counter(map(tuple, suffix.spans(df, "doc_id", "text").collect())) == brute(rows)[0]
    assert suffix.spans(no_rows, "doc_id", "text").count() == 0
    assert suffix.remove_repeats(no_rows, "doc_id", "text").count() == 0


def words_of_like_sums(share):
    """Two words whose running sums (as suffix.Sums makes them) differ by a multiple of 2**share."""
    rng, seen = np.random.default_rng(7), {}
    base = pow(suffix.BASE, -1, 1 << 64)
    powers = np.array([pow(base, k, 1 << 64) for k in range(8)], np.uint64)
    while True:
        words = rng.integers(97, 123, (1 << 18, 8), dtype=np.uint8)
        for k, h in enumerate((((words.astype(np.uint64) + np.uint64(1)) * powers).sum(axis=1) & np.uint64((1 << share) - 1)).tolist()):
            word = words[k].tobytes().decode()
            if seen.setdefault(h, word) != word:
                return seen[h], word


def test_texts_made_to_collide_are_told_apart(spark):
    """A Thue-Morse order of two words and its inverse have equal polynomial hashes modulo 2**64, whatever the base."""
    pair = words_of_like_sums(40)
    order = [k.bit_count() & 1 for k in range(16)]
    one, two = ("".join(pair[x ^ flip] for x in order).encode() for flip in (0, 1))
    sums = suffix.Sums(np.frombuffer(one + two, np.uint8)).hashes(np.array([0, 128]), np.array([128, 256]))
    assert sums[0] == sums[1] and one != two
    tests = []
    for around in ("", "b" * 60, "the same before, the same after, under two hundred bytes "):
        tests += [f"{around}{x.decode() * n}{around}" for n in (1, 2) for x in (one, two)]
    tests += ["".join(pair[(k.bit_count() & 1) ^ flip] for k in range(31)) for flip in (0, 1)]
    rows = [*enumerate(tests)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert Counter(map(tuple, suffix.spans(df, "doc_id", "text").collect())) == brute(rows)[0]


def test_clashing_names_and_a_hash_of_the_users(spark):
    rows = [(k, "a passage that repeats " * 12 + str(k), f"mine {k}", "x", 1) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sha string, KEPT string, copy int")
    out = suffix.remove_repeats(df, "doc_id", "text")
    assert out.columns == df.columns and {r.sha for r in out.collect()} == {"mine 0", "mine 1", "mine 2"}


def found(texts):
    out = Counter()
    for row, at, core, context in suffix.anchor_rows(pa.array(texts, pa.binary())):
        out.update(zip(row.tolist(), at.tolist(), core.tolist(), map(tuple, context.tolist())))
    return out


def test_blocks_do_not_change_anchors(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(n)) for n in (5, 300, 9000, 0, 1200, 70, 40000, 250)] + [b"a" * 5000]
    whole = found(texts)
    monkeypatch.setattr(suffix, "BLOCK", 3000)
    assert found(texts) == whole and len(whole) > 1500
    assert set(whole) == {(k, *r[1:]) for k, t in enumerate(texts) for r in found([t])}


def test_every_window_has_a_shared_anchor():
    """The guarantee that the sparse index rests on, for texts of low and high entropy."""
    rng = random.Random(4)
    for alphabet in (b"a", b"ab", b"abcdefghij"):
        s = bytes(rng.choice(alphabet) for _ in range(suffix.LENGTH))
        places = []
        for _ in range(20):
            left, right = (bytes(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(2))
            at = {r[1] - len(left) for r in found([left + s + right])}
            places.append({d for d in at if 0 <= d < suffix.WINDOW})
        assert set.intersection(*places)


def test_refine_gives_common_prefixes():
    rng = np.random.default_rng(0)
    symbols = rng.integers(97, 99, (60, 12)).astype(np.uint8)
    lengths = rng.integers(0, 13, 60)
    for depth, block in enumerate(suffix.refine(np.zeros(60, np.int64), symbols, lengths)):
        for i in range(60):
            same = [j for j in range(60) if min(lengths[i], lengths[j]) >= depth and (symbols[i, :depth] == symbols[j, :depth]).all()]
            if len(same) > 1 and i in same:
                assert block[i] >= 0 and {j for j in range(60) if block[j] == block[i]} == set(same)
            elif depth:
                assert block[i] == -1


def test_no_suffix_open_on_both_sides():
    side = suffix.SIDE
    sides = np.zeros((2, 2 * side), np.uint8)
    cores = lambda *x: np.array([[k, 0] for k in x])
    assert suffix.repeated_starts(cores(1, 2), np.array([side, side]), np.array([side, side]), sides).tolist() == [0, 0]
    assert suffix.repeated_starts(cores(1, 1), np.array([0, 0]), np.array([0, 0]), sides).tolist() == [0, 0]
    assert suffix.repeated_starts(cores(1, 1), np.array([0, 0]), np.array([side, side]), sides).tolist() == [1, 1]


def test_shard_merge_sends_few_rows_for_a_shared_block():
    core = np.array([7] * 50 + [8] * 40 + [9, 10], np.uint64)
    context = np.array([[7, 1]] * 50 + [[7, k] for k in range(40)] + [[7, 3], [7, 4]], np.uint64)
    passive = np.zeros(92, np.int64)
    passive[91] = 1
    rows, kind = suffix.shard_merge(core, context, passive)
    assert Counter(kind.tolist()) == {suffix.SAME: 2, suffix.SOME: 1, suffix.ALONE: 1, suffix.IS_ALL: 50, suffix.IS_EDGE: 40}
    assert {int(core[r]) for r, k in zip(rows, kind) if k == suffix.IS_EDGE} == {8}
    assert [int(core[r]) for r, k in zip(rows, kind) if k == suffix.ALONE] == [9]


def test_hot_passages_in_few_and_many_shards(spark, monkeypatch):
    """One passage in every text, between texts of all lengths: blocks as large as the table."""
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = prose(420)
    rows = [(k, prose(rng.randrange(0, 80)) + (passage if k % 3 else passage[:210] + "!" + passage[210:]) + prose(rng.randrange(0, 80))) for k in range(150)]
    want = brute(rows)[0]
    for parts, large in ((1, 1024), (7, 1024), (7, 20)):
        monkeypatch.setattr(suffix, "LARGE", large)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert Counter(map(tuple, suffix.spans(df, "doc_id", "text").collect())) == want
