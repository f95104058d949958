"""The registered queries by their names: columns and types of their contracts, and rows against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_shards_tokens import exact_brute, jump, simhash_brute
from test_text_records import chat_brute, pages_brute, stats_brute
from tests_llm_brute import brute_spans

from nearscore.llm import quality, rules, tokens
from nearscore.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"

CONTRACTS = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_quality_classifier": "doc_id bigint, expected_grade double, tail_prob double, kept boolean",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_chat_windows": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op7_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op8_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.word_bpe())
    return library, [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in texts]


def rows_of(spark, name):
    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    want = [c.split() for c in CONTRACTS[name].split(", ")]
    assert {c: types.get(c) for c, _ in want} == dict(want)
    return [tuple(r) for r in df.select(*(c for c, _ in want)).collect()]


def test_every_query_has_a_contract():
    assert CONTRACTS.keys() == QUERIES.keys()


def test_op1(spark, texts):
    got, slots = rows_of(spark, "op1_sharding"), defaultdict(list)
    for r in got:
        slots[r[4]].append(r[5])
    data = [(i, (t or "").encode()) for i, t in texts]
    want = Counter((i, len(b) + 8, zlib.crc32(b), "key", jump(i, 24), jump(i, 25)) for i, b in data)
    assert Counter((*r[:5], r[6]) for r in got) == want
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())


def test_op2(spark, ids):
    library, encoded = ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for i, x in encoded)
    assert Counter(rows_of(spark, "op2_bpe")) == want


def test_op3(spark, texts):
    """Scores by the formula, in plain sums over the model's weights."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model, want = quality.fit(docs, labels), {}
    for i, t in texts:
        found = quality.features(t)
        score = sum(float(model.weights[k]) for k in found)
        at_least = [1 / (1 + np.exp(at - score)) for at in model.thresholds] if found else [0.0, 0.0]
        want[i] = sum(at_least), at_least[-1]
    got = rows_of(spark, "op3_quality_classifier")
    assert len(got) == len(texts)
    for i, grade, tail, kept in got:
        assert (grade, tail) == pytest.approx(want[i], abs=1e-6) and kept == (tail >= quality.CHOOSE)


def test_op4(spark, texts):
    assert Counter((i, int(f, 16), c) for i, f, c in rows_of(spark, "op4_simhash")) == simhash_brute(texts)


def test_op5(spark, texts):
    left = {i: t.encode() for i, t in brute_spans(texts, 200).items()}
    got = rows_of(spark, "op5_suffix_dedup")
    assert len(got) == len(texts)
    for (i, n, gone, spans, sha), t in zip(sorted(got), (t for _, t in sorted(texts, key=lambda r: r[0]))):
        assert (n, spans > 0) == (len((t or "").encode()), gone > 0)
        if t is None or t.isascii():  # brute_spans() drops halves of characters
            assert (n - gone, sha) == (len(left[i]), hashlib.sha256(left[i]).hexdigest())


def test_op6(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    got = rows_of(spark, "op6_chat_windows")
    assert {r[0]: r[1:5] for r in got} == chat_brute(rows) and all(r[5] >= r[3] for r in got)


def test_op7(spark, texts):
    assert Counter(rows_of(spark, "op7_exact_dedup")) == exact_brute(texts)


def test_op8(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert Counter(rows_of(spark, "op8_warc")) == pages_brute(pages)


def test_op9(spark, ids):
    want = Counter()
    for i, x in ids[1]:
        x = [*x, 0]
        for k in range(0, len(x), 2048):
            part = x[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got, sequences = rows_of(spark, "op9_best_fit_packing"), defaultdict(list)
    assert Counter(r[:5] for r in got) == want
    for r in got:
        sequences[r[5]].append((r[6], r[3]))
    for s in map(sorted, sequences.values()):
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= 2048


def test_op10(spark, texts):
    """Verdicts by walking the learned list row by row."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learned, want = rules.fit(docs, labels), Counter()
    for i, t in texts:
        base, all_ = stats_brute(t), dict(zip(rules.STATS, rules.statistics(t)))
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        share = {k: all_[over] / max(1, all_[under]) for k, (over, under) in rules.RATIOS.items()}
        hit = any(all(share[k] >= at if side == ">=" else share[k] < at for k, side, at in rule) for rule in learned)
        want[i, *base, failed, not failed and not hit] += 1
    assert Counter(rows_of(spark, "op10_quality_rules")) == want
