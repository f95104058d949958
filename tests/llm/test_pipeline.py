import zlib
from collections import Counter

import corpus_pipeline
from nearscore.llm import simhash
from nearscore.llm import suffix
from tests_llm_brute import brute_spans


def test_pipeline_stage_by_stage(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(path := str(tmp_path / str(k)))
        seen.append(spark.read.parquet(path))
        if k < 4:
            assert seen[-1].columns == columns
    rows = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in seen[:5]]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, x in labels.items() if x == (1, 0)]
    assert sum(i in rows[1] for i in good) > 0.97 * len(good)
    poor = [i for i, x in labels.items() if x[0] == 0]
    assert sum(i in rows[1] for i in poor) < 0.2 * len(poor)
    last = {}
    for i, t in sorted(rows[1].items()):
        last[t] = i
    assert rows[2] == {i: t for t, i in last.items()}
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in rows[2].items()}
    links = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0}
    linked = {x for p in links for x in p}
    assert all(a not in rows[3] or b not in rows[3] for a, b in links)
    assert set(rows[3]) >= set(rows[2]) - linked and linked & set(rows[3])
    texts = brute_spans([*rows[3].items()], suffix.LENGTH)
    assert rows[4] == texts
    assert {r.doc_id: r.n_chars for r in seen[4].collect()} == {i: len(t) for i, t in texts.items()}
    pieces = seen[5].collect()
    assert {p.doc_id for p in pieces} == set(texts)
    assert all(sum(p.length for p in pieces if p.sequence_id == s) <= 2048 for s in {p.sequence_id for p in pieces})
    end = zlib.crc32(bytes(4))
    assert all((p.length, p.ids_crc32) == (1, end) for p in pieces if not texts[p.doc_id].strip())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert Counter(out.columns) == Counter(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    assert out.count() > 50
