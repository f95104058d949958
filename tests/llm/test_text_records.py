import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from nearscore.llm import bpe, chat, quality, rules, tokens, warc


def repeat_brute(w):
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})


def stats_brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeat_brute(words)


def test_statistics(awkward, no_rows, documents):
    for df in (awkward, documents):
        want = Counter((r.doc_id, *stats_brute(r.text)) for r in df.select("doc_id", "text").collect())
        got = rules.with_statistics(df, "doc_id", "text").select("id", *rules.STATS[:5]).collect()
        assert Counter(map(tuple, got)) == want
    assert rules.with_statistics(no_rows, "doc_id", "text").count() == 0
    rng = random.Random(1)
    for _ in range(300):
        w = [bytes([rng.choice(b"ab")]) for _ in range(rng.randrange(40))]
        assert rules.repeat_words(w) == repeat_brute(w)


def test_decision_list_finds_planted_rules(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(1500), "b": rng.random(1500), "c": rng.random(1500)}
    bad = (x["a"] > 0.9) | ((x["b"] < 0.2) & (x["c"] > 0.5))
    found = rules.learn(x, bad ^ (rng.random(1500) < 0.01))
    covered = np.any([rules._covers(r, x) for r in found], axis=0)
    assert (covered == bad).mean() > 0.97
    assert rules.learn(x, np.zeros(1500, bool)) == []


def test_rules_and_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    judged = rules.judge(docs, "doc_id", "text", rules.fit(docs, train)).withColumnRenamed("id", "doc_id").join(held, "doc_id").toPandas()
    assert ((judged.quality == 1) == judged.kept).mean() > 0.95
    assert judged[judged.quality == 0].kept.mean() < 0.2
    scored = quality.classify(docs, "doc_id", "text", quality.fit(docs, train)).withColumnRenamed("id", "doc_id").join(held, "doc_id").toPandas()
    assert scored[(scored.quality == 1) & (scored.toxic == 0)].kept.mean() > 0.98
    assert scored[scored.quality == 0].kept.mean() < 0.15
    means = scored.groupby(scored.toxic.rsub(1) * (1 + scored.quality)).expected_grade.mean()
    assert list(means) == sorted(means)


def test_verdicts_of_awkward_rows(spark, awkward, no_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (2, 0, 0), (8, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        got = rules.judge(awkward, "doc_id", "text", rules.fit(awkward, labels)).collect()
        assert len(got) == awkward.count() and not any(r.kept for r in got if r.n_words < 10)
        model = quality.fit(awkward, labels)
        scored = quality.classify(awkward, "doc_id", "text", model).collect()
        assert len(scored) == awkward.count()
        assert all((r.expected_grade, r.tail_prob, r.kept) == (0, 0, False) for r in scored if r.id in (2, 3, 4))
        kept = quality.chosen(awkward, "text", model)
        assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in scored)
    assert quality.classify(no_rows, "doc_id", "text", model).count() == 0
    assert rules.judge(no_rows, "doc_id", "text", rules.fit(no_rows, none)).count() == 0


def test_without_labels_texts_with_words_are_kept(spark, awkward):
    no_labels, of_others = (spark.createDataFrame(rows, "doc_id long, quality int, toxic int") for rows in ([], [(99, 1, 1)]))
    for labels in (no_labels, of_others):
        model = quality.fit(awkward, labels)
        want = Counter((r.doc_id, bool((r.text or "").encode().split())) for r in awkward.collect())
        assert Counter((r.id, r.kept) for r in quality.classify(awkward, "doc_id", "text", model).collect()) == want
        assert quality.chosen(awkward, "text", model).count() == sum(n for (_, kept), n in want.items() if kept)


def test_ordinal_gradient_orders_grades():
    texts = [[k % 7, 100 + k % 3] for k in range(210)]
    grades = [0 if k % 7 < 2 else 1 if k % 7 < 4 else 2 for k in range(210)]
    m = quality.train(texts, grades, 3)
    assert (np.diff(m.thresholds) > 0).all()
    assert [sum(m.score([k])[0] > x for x in (0.7, 1.4)) for k in range(7)] == [0, 0, 1, 1, 2, 2, 2]


def test_escape_round_trip():
    rng = random.Random(2)
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ASST]", "[ROLE=", "[/ROLE]", "\\", "]", "[", "<", "s>", " ", "\n", "é", "/"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not chat.CONTROL.search(e)
        role, other = rng.choice(["user", "assistant", "system", "", "tool]", t]), "".join(rng.choice(pieces) for _ in range(4))
        got = chat.parse(chat.turn_text(role, t)[0] + chat.turn_text("user", other)[0])
        assert [g[:2] for g in got] == [(role, t), ("user", other)]


def chat_brute(rows):
    by = defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((n is not None, n, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment,budget", [(4096, 2048), (4, 300)])
def test_chat(spark, monkeypatch, segment, budget):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    own = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 1, "user", None), (None, None, None, "x"), (900, 5, "assistant", "late"), (900, 5, "assistant", "late"),
           (901, 0, "assistant", ""), (902, 1, "tool]", "[/ROLE] ]"), (903, 0, "user", "a" * 50000)]
    own += [(905, 10**13 * k, ("user", "assistant")[k % 2], f"far apart {k}") for k in range(7)] + [(905, -(2**62), "system", "first")]
    own += [(906, 7 * k, "user", "word " * n) for k, n in enumerate((200, 240, 1500, 200, 1800))]
    own += [(904, 0, "system", "be kind")] + [(904, k, ("assistant", "user")[k % 2], f"turn {k} " + "word " * (k % 60)) for k in range(1, 40)]
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    df = df.union(spark.createDataFrame(own, df.schema)).withColumn("window", chat.F.lit("x"))
    formatted = chat.format_windows(df, tokens.word_bpe(), budget, 64).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert got == chat_brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    b = bpe.load(tokens.word_bpe())
    for r in formatted.collect():
        turns = chat.parse(r.text)
        assert r.n_tokens == sum(len(b.encode(chat.turn_text(*t[:2])[0])) for t in turns)
        alone = sum(len(b.encode(chat.turn_text(*t[:2])[0])) for k, t in enumerate(turns) if k >= r.repeated or t[0] == "system")
        assert r.n_tokens <= budget or (len(turns) - r.repeated == 1 and alone > budget and r.n_tokens == alone)
        assert r.repeated <= 1 + chat.HISTORY_TURNS
        if r.conv_id == 905 and segment == 4 and r.segment == 1 and r.window == 0:
            assert r.repeated > 1 and turns[0][:2] == ("system", "first") and turns[1][1].startswith("far apart")  # history crosses the seam
        if r.conv_id == 904:
            assert turns[0][:2] == ("system", "be kind") and len(turns) > r.repeated
    assert chat.read_back(chat.format_windows(df.limit(0), tokens.word_bpe())).count() == 0


def pages_brute(rows):
    groups = defaultdict(list)
    for p, _, h in rows:
        if len((h or "").encode()) >= 1000:
            groups[h].append(p)
    kept = {h: max((p for p in g if p is not None), default=None) for h, g in groups.items()}
    out = Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        first = kept.get(h, p) if len(data) >= 1000 else p
        revisit = first is not None and p != first
        out[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


def test_warc(spark, tmp_path):
    same = "é" * 700
    rows = [(1, "http://a", same), (9, "http://b\r\nX: y", same), (9, "http://b", same), (None, None, same), (4, "", None), (5, None, ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "y" * 3_000_000), (None, "u", "z" * 2000), (None, "u", "z" * 2000)]
    own = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, kept int").repartition(2)
    sf = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for k, df in enumerate((own, sf, own.limit(0))):
        path = str(tmp_path / str(k))
        warc.write_bundles(df, path)
        got = Counter(map(tuple, warc.read_bundles(spark, path).collect()))
        assert got == pages_brute([(r.page_id, r.url, r.html) for r in df.collect()])
    html = {r.page_id: r.html for r in sf.collect()}
    for p, headers, block in warc.lookup(spark, str(tmp_path / "1"), [3, 200]):
        assert headers["WARC-Type"] == "response" and block.split(b"\r\n\r\n", 1)[1].decode() == html[p]


def test_a_lookup_reads_one_frame(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 5000)
    rows = [(k, "u", f"{k} " + "".join(chr(97 + (k * j) % 26) for j in range(3000))) for k in range(60)]
    warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    (index,) = spark.read.parquet(str(tmp_path / "w/index")).where("page_id = 17").collect()
    read, own = [], warc.read_at
    monkeypatch.setattr(warc, "read_at", lambda f, at, n: read.append((at, n)) or own(f, at, n))
    ((page, _, block),) = warc.lookup(spark, str(tmp_path / "w"), [17])
    assert (page, block.split(b"\r\n\r\n", 1)[1].decode()) == (17, rows[17][2])
    assert read == [(index.frame_at, index.frame_bytes)]


def test_bundle_frames_stand_alone():
    import io

    import zstandard

    whole, index = io.BytesIO(), []
    b = warc.Bundle(whole)
    data = [bytes([k % 250]) * (k * 37 % 9000) + b"!" for k in range(200)]
    for k, d in enumerate(data):
        index.extend(b.add(k, d))
    index.extend(b.finish())
    size = len(whole.getvalue())
    assert len(warc.seek_table(whole, size)) > 2 and len(index) == 200
    for k, at, packed, plain, offset, n in index:
        assert (at, packed, plain) in warc.seek_table(whole, size)
        assert warc.frame(whole, at, packed, plain)[offset : offset + n] == data[k]
    # the file is an ordinary Zstandard stream: any reader skips the seek table
    out = zstandard.ZstdDecompressor().stream_reader(whole.getvalue(), read_across_frames=True).read()
    assert out == b"".join(data)
