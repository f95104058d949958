import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearscore.functions import vectors as V
from nearscore.functions.config import DIM_ORDER
from nearscore.operators import analytics, ivf, knn, mlp, ranking
from nearscore.operators import kmeans as K
from nearscore.plans import build as plan
from nearscore.plans.scoring import ScoringContext, score, score_vectors
from nearscore.queries import F1, network
from nearscore.sources import index_io, model_file, payloads, references
from nearscore.sources import tables as T
from nearscore.functions import scalars as S
from nearscore.streaming.score_stream import parquet_sink, ready, score_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def refs(spark):
    return ranking.durable(T.event_references(spark, SF))


@pytest.fixture(scope="module")
def index(refs):
    return ivf.build_index(refs, 16, 2, 14, 4)


def brute(refs, queries, k, integers=False):
    r = sorted((x.ref_id, x.vector, x.is_fraud) for x in refs.collect())
    m = np.array([x[1] for x in r], np.float32).astype(np.float64)
    out = {}
    for q in queries.collect():
        v = np.array(q.vector, np.float32).astype(np.float64)
        a, b = (np.sign(v * 4096) * np.floor(np.abs(v * 4096) + 0.5), np.trunc(m * 4096)) if integers else (v, m)
        d = ((b - a) ** 2).sum(1)
        out[q.query_id] = [r[i][0] for i in np.lexsort((np.arange(len(r)), d))[:k]]
    return out


def neighbours(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.ref_id)
    return out


def test_exact_knn(refs):
    queries = T.searches(refs)
    assert neighbours(knn.exact_knn(queries, refs)) == brute(refs, queries, 5)


def test_exact_knn_with_ties(spark):
    rng = random.Random(0)
    rows = [(i, [float(rng.randrange(3)) for _ in range(4)], i % 2) for i in range(300)]
    refs = spark.createDataFrame(rows, "ref_id long, vector array<float>, is_fraud int").repartition(5)
    queries = refs.where("ref_id < 20").select(F.col("ref_id").alias("query_id"), "vector")
    want = {i: [j for _, j in sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w, _ in rows)[:7]] for i, v, _ in rows[:20]}
    assert neighbours(knn.exact_knn(queries, refs, 7)) == want
    assert neighbours(knn.exact_knn(queries, refs.limit(3), 7))[0].__len__() == 3
    assert knn.exact_knn(queries.limit(0), refs).count() == 0


def test_scan_of_many_cells(spark):
    """Copies are kept k times, equal queries asked once, far blocks not read, and the result is that of brute force."""
    rng = np.random.default_rng(4)
    x = np.r_[rng.random((9000, 3)), np.repeat(rng.random((30, 3)), 100, axis=0), np.full((9000, 3), 0.25)].astype(np.float32)
    rows = [(i, [float(a) for a in v], i % 2) for i, v in enumerate(x)]
    refs = spark.createDataFrame(rows, "ref_id long, vector array<float>, is_fraud int").repartition(5)
    queries = refs.where("ref_id % 300 = 0").select(F.col("ref_id").alias("query_id"), "vector")
    scan = knn.Scan(refs, 5)
    assert scan.cells.count > 1 and scan.blocks.agg(F.sum(F.length("r_ids") / 8)).first()[0] == 9000 + 30 * 5 + 5
    reps, of = knn.distinct_queries(queries)
    assert (reps.count(), of.count()) == (30 + 10 + 1, 70)
    assert neighbours(knn.exact_knn(queries, scan)) == brute(refs, queries, 5)
    far = spark.createDataFrame([(0, [9.0, -9.0, 9.0]), (1, [0.25, 0.25, 0.25]), (1, [0.25, 0.25, 0.25])], "query_id long, vector array<float>")
    assert neighbours(knn.exact_knn(far, scan)) == brute(refs, far.distinct(), 5)


def test_queries_in_parts(spark, refs, monkeypatch):
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 4000)
    queries = T.searches(refs)
    assert neighbours(knn.exact_knn(queries, refs, dims=14)) == brute(refs, queries, 5)


def test_a_stream_prepares_its_references_once(refs):
    context = ScoringContext(refs=refs)
    queries = T.searches(refs).limit(3)
    assert context.neighbours(queries).count() == 15
    first = context.scan
    assert context.neighbours(queries).count() == 15 and context.scan is first is not None


def test_ready_index_finds_the_same(refs, index):
    """Of postings that are equal once quantised no more are kept than a search returns."""
    copies = refs.unionByName(refs.select((F.col("ref_id") + 100000).alias("ref_id"), "vector", "is_fraud"))
    twice = ivf.build(copies.unionByName(refs.select((F.col("ref_id") + 200000).alias("ref_id"), "vector", "is_fraud")), K.kmeans(refs, 16, 1, 14), 14, 4)
    q = ivf.quantized(T.searches(refs))
    once = ivf.ready(twice, 2)
    assert once.postings.count() <= twice.postings.count() * 2 / 3
    assert neighbours(ivf.pruned_candidates(q, once, 4, 2)) == neighbours(ivf.candidates(q, twice, 4, 2))


def test_searches_of_several_widths(spark, refs, index, monkeypatch):
    """Each finds what a search of its own finds, from blocks of one pack; a block of a cluster that is not probed is not read."""
    copies = refs.unionByName(refs.select((F.col("ref_id") + 100000).alias("ref_id"), "vector", "is_fraud"))
    twice = ivf.build(copies, K.kmeans(copies, 8, 1, 14), 14, 4)
    queries = T.searches(copies)
    monkeypatch.setattr(ivf, "ROWS", 100)
    monkeypatch.setattr(ivf, "CELL_SAMPLE", 100)
    posted = ivf.Posted(twice)
    assert len(posted.cluster_of) > 8 and posted.blocks.count() >= len(posted.cluster_of)
    for p, found in ivf.searches(queries, posted, copies, [8, 1, 3, 50]).items():
        assert neighbours(found) == neighbours(ivf.search(queries, twice, copies, p, prune=False)), p
    wide = posted.candidates(ivf.quantized(queries), [1, 3])
    assert {p: neighbours(x) for p, x in wide.items()} == {p: neighbours(ivf.candidates(ivf.quantized(queries), twice, p)) for p in (1, 3)}
    assert ivf.searches(queries.limit(0), posted, copies, [1])[1].count() == 0


def test_rounds_move_sums_only(spark, refs, monkeypatch):
    """A round of K-means gives the means of assign()'s members without sending rows back."""
    first = K.stride_init(refs, 9)
    want = {r.cluster_id: r.centroid for r in K.means(K.assign(refs, first), 14).collect()}
    monkeypatch.setattr(K, "assign", None)
    assert all(np.allclose(c, want[i], atol=1e-12) for i, c in K.step(refs, first, 14))


def test_all_probes_equal_exact_integer_search(refs, index):
    queries = T.searches(refs)
    want = brute(refs, queries, 10, integers=True)
    q = ivf.quantized(queries)
    assert neighbours(ivf.candidates(q, index, 16)) == want
    assert neighbours(ivf.pruned_candidates(q, index, 16)) == want


def test_pruning_changes_nothing_and_reads_less(refs, index):
    q = ivf.quantized(T.searches(refs))
    for nprobe in (1, 3, 8):
        assert neighbours(ivf.candidates(q, index, nprobe)) == neighbours(ivf.pruned_candidates(q, index, nprobe))


def test_box_is_a_lower_bound(refs, index):
    q = ivf.quantized(T.searches(refs))
    rows = ivf.probes(q, index, 16).join(index.postings.withColumnRenamed("qvec", "rvec"), "cluster_id")
    assert rows.where(F.col("lower") > V.l2_squared_int(F.col("qvec"), F.col("rvec"))).count() == 0


def test_recall_grows_with_probes(refs, index):
    queries = T.searches(refs)
    truth = ranking.durable(knn.exact_knn(queries, refs))
    got = [ivf.recall(ivf.search(queries, index, refs, p), truth).first().recall for p in (1, 4, 16)]
    assert got == sorted(got) and got[-1] > 0.97


def test_kmeans_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((200, 3)).astype(np.float32)
    refs = spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(x)], "ref_id long, vector array<float>, is_fraud int")
    got, m = K.kmeans(refs, 7, 4, 3), x[[c * 200 // 7 for c in range(7)]].astype(np.float64)
    for _ in range(4):
        at = ((x[:, None].astype(np.float64) - m[None]) ** 2).sum(-1).argmin(1)
        m = np.array([x[at == c].mean(0, dtype=np.float64) if (at == c).any() else m[c] for c in range(7)])
    assert np.allclose([c for _, c in got], m, atol=1e-9)
    same = spark.createDataFrame([(i, [0.5], 0) for i in range(5)], "ref_id long, vector array<float>, is_fraud int")
    assert K.kmeans(same, 9, 2, 1) == [(c, [0.5]) for c in range(5)]
    assert ivf.build(same, K.kmeans(same, 3, 1, 1), 1, 2).clusters.count() == 1


def test_index_files(spark, refs, index, tmp_path):
    path = str(tmp_path / "index")
    index_io.write_index(index, path)
    again = index_io.read_index(spark, path)
    assert (again.dims, again.nprobe, again.postings.count()) == (14, 4, refs.count())
    assert index_io.read_index(spark, path, 9).nprobe == 9
    queries = T.searches(refs)
    assert neighbours(ivf.search(queries, again, refs)) == neighbours(ivf.search(queries, index, refs))
    stats = index_io.offsets(again.clusters).orderBy("cluster_id").collect()
    assert [r["first"] for r in stats] == [sum(s.n for s in stats[:k]) for k in range(len(stats))]
    assert all(r.slots % 8 == 0 and 0 <= r.slots - r.n < 8 for r in stats)
    spark.createDataFrame([(7, 14, 4096, 4)], "version int, dims int, scale int, nprobe int").write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(index_io.IndexError_):
        index_io.read_index(spark, path)


def test_reference_files(spark, tmp_path):
    rows = [{"vector": [k + i / 100 for i in range(14)], "label": "fraud" if k % 3 == 0 else "legitimate"} for k in range(9)] + [{"vector": [1.0] * 20}, {"vector": [2.0]}]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(rows, f)
    for name in ("r.json", "r.json.gz"):
        got = sorted(map(tuple, references.read_references(spark, str(tmp_path / name)).collect()))
        assert [g[0] for g in got] == [*range(11)] and [g[2] for g in got] == [1, 0, 0] * 3 + [0, 0]
        assert got[4][1] == pytest.approx([4 + p / 100 for p in DIM_ORDER], abs=1e-5)
        assert got[9][1] == [1.0] * 14 and got[10][1] == [2.0 if p == 0 else 0.0 for p in DIM_ORDER]
    references.write_references(references.read_references(spark, str(tmp_path / "r.json")), str(tmp_path / "t"))
    assert references.read_reference_table(spark, str(tmp_path / "t")).count() == 11
    (tmp_path / "bad.json").write_text('[{"label": "fraud"}]')
    with pytest.raises(Exception, match="no vector"):
        references.read_references(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "e.json").write_text(json.dumps({"entries": [{"request": json.loads(F1), "expected_approved": True}]}))
    entry = references.read_test_entries(spark, str(tmp_path / "e.json")).first()
    assert entry.expected_approved and json.loads(entry.payload)["merchant"]["mcc"] == "5411"
    assert references.synthetic(spark, 10).count() == 10


def test_build_command(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"vector": [rng.random() for _ in range(14)], "label": rng.choice(["fraud", "legitimate"])} for _ in range(120)]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    plan.build(spark, str(tmp_path / "r.json"), str(tmp_path / "ivf"), 8, 2, "ivf", 3)
    index = index_io.read_index(spark, str(tmp_path / "ivf"))
    assert index.nprobe == 6 and index.clusters.count() <= 8
    plan.build(spark, str(tmp_path / "r.json"), str(tmp_path / "exact"), kind="exact")
    assert references.read_reference_table(spark, str(tmp_path / "exact")).count() == 120
    with pytest.raises(plan.BuildError):
        plan.build(spark, str(tmp_path / "r.json"), str(tmp_path / "x"), kind="other")


def test_warmup_lines(spark, tmp_path):
    rows = payloads.warmup_payloads(spark, [1.0, 2.0], ["a", "b", "c"], [0.5, 1.5], 10)
    want = [(a, m, k) for a in (1.0, 2.0) for m in "abc" for k in (0.5, 1.5)][:10]
    assert [(r.amount, r.mcc, r.km_from_home) for r in rows.orderBy("idx").collect()] == want
    payloads.write_payload_lines(rows, str(tmp_path / "w"))
    lines = payloads.read_payload_lines(spark, str(tmp_path / "w")).collect()
    assert payloads.read_payload_lines(spark, str(tmp_path / "w"), first=3).count() == 3
    assert [r.payload for r in payloads.load(spark, ["a", "b", "c"], 7).orderBy("query_id").collect()] == [*"abcabca"]
    assert len(lines) == 10 and all([*json.loads(r.payload)] == sorted(json.loads(r.payload)) for r in lines)


def test_network_file(tmp_path):
    net = network()
    model_file.write_network(net, str(tmp_path / "m.bin"))
    again = model_file.read_network(str(tmp_path / "m.bin"))
    assert again.threshold == pytest.approx(net.threshold) and all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(again.layers, net.layers))
    assert model_file.read_network(str(tmp_path / "none")) is None
    x = np.arange(14.0)
    order = [*range(13, -1, -1)]
    assert np.allclose(net.with_inputs(order).layers[0][0] @ x[order], net.layers[0][0] @ x)
    with pytest.raises(ValueError):
        model_file.Network([(np.zeros((2, 3)), np.zeros(2)), (np.zeros((1, 4)), np.zeros(1))], 0.5)


def test_network_paths_agree_and_training_learns(refs):
    both = mlp.predict(refs, network()).withColumn("c", mlp.forward_columns(F.col("vector"), network()))
    assert both.where(F.abs(F.col("c") - F.col("probability")) > 1e-12).count() == 0
    net = mlp.train_relu_network(refs, (16,), epochs=150, batch=64, rate=5e-3, held_out=0.1)
    got = analytics.accuracy(mlp.predict(refs, net).withColumn("p", (F.col("probability") >= 0.5).cast("int")), "p", "is_fraud").first()
    assert got.accuracy > 0.97
    # a label that the vectors do not tell: the stored threshold leaves rows to the neighbours
    unclear = refs.withColumn("is_fraud", F.when(F.col("ref_id") % 7 == 0, 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")))
    net = mlp.train_relu_network(unclear, (8,), epochs=5, batch=64, rate=5e-3, held_out=0.3)
    assert net.threshold > 0 and mlp.predict(unclear, net).where(S.confidence(F.col("probability")) < net.threshold).count() > 0
    model = mlp.train_forest(refs, trees=10, depth=6)
    from pyspark.ml.functions import array_to_vector

    rows = refs.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"), F.col("is_fraud"))
    assert model.transform(rows).where(F.col("prediction") == F.col("is_fraud")).count() > 0.97 * rows.count()
    assert mlp.train_network(refs, (8,), rounds=10).numClasses == 2


def test_scoring_plan(spark, refs, index):
    rows = [(k, p) for k, p in enumerate([F1, "{}", "", None, "x" * 5000])]
    df = spark.createDataFrame(rows, "query_id long, payload string")
    for context in (ScoringContext(refs=refs), ScoringContext(refs=refs, index=index, network=network())):
        got = {r.query_id: r for r in score(df, context).collect()}
        assert sorted(got) == [*range(5)]
        assert [got[k].source for k in (3, 4)] == ["bad_request"] * 2 and got[4].fraud_count is None
        for k in range(3):
            answer = json.loads(got[k].response)
            assert answer == {"approved": got[k].fraud_count < 3, "fraud_score": got[k].fraud_count / 5}
    everything = score_vectors(T.searches(refs), ScoringContext(refs=refs, network=network()).with_threshold(0.0)).collect()
    assert {r.source for r in everything} == {"mlp"}
    with pytest.raises(ValueError):
        ScoringContext()


def test_stream_equals_batch_and_survives_a_restart(spark, refs, tmp_path):
    asked = T.payloads(spark, SF).where("query_id % 20 = 0").select("query_id", "payload")
    context = ScoringContext(refs=refs)
    source = lambda: spark.readStream.schema("query_id long, payload string").parquet(str(tmp_path / "in"))
    for part in (0, 1):
        asked.where(F.col("query_id") % 40 == 20 * part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = score_stream(source(), context, parquet_sink(str(tmp_path / "out")), str(tmp_path / "state"), once=True)
        q.awaitTermination()
        assert not ready(q)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(got.collect()) == sorted(score(asked, context).select(got.columns).collect())


def test_places_and_percentiles(spark):
    rng = random.Random(1)
    values = [float(rng.randrange(100)) for _ in range(777)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").repartition(6)
    got = [r.v for r in sorted(ranking.placed(df, "v", "i").collect(), key=lambda r: r.place)]
    assert got == sorted(values)
    row = ranking.index_percentiles(df, "v", {"a": 0.5, "b": 0.99, "c": 1.0}).first()
    s = sorted(values)
    assert (row.a, row.b, row.c) == (s[388], s[769], s[-1])
    four = spark.createDataFrame([(float(k),) for k in (4, 2, 3, 1)], "v double")
    assert ranking.index_percentiles(four, "v", {"p": 0.5}).first().p == 3.0


def test_sweep_of_nothing_wrong(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0)], "probability double, is_fraud int")
    assert analytics.safe_threshold(df).first().safe_threshold == 0
    assert analytics.safe_threshold(df.union(spark.createDataFrame([(0.8, 0)], df.schema))).first().safe_threshold == pytest.approx(0.601)
    assert analytics.threshold_sweep(df.limit(0)).count() == 6


def test_nearest_is_exact_where_products_cancel():
    from nearscore.operators.blocks import nearest

    rng = np.random.default_rng(5)
    for scale in (1.0, 1e6, 1e-6):
        refs = 1000 * scale + scale * rng.random((500, 6)) * 1e-3
        queries = refs[:40] + scale * 1e-9
        ids = rng.permutation(500)
        row, at, dist = nearest(queries, refs, ids, 4)
        d = np.zeros((40, 500))
        for i in range(6):
            d += (queries[:, None, i] - refs[None, :, i]) ** 2
        want = [np.lexsort((ids, d[q]))[:4].tolist() for q in range(40)]
        assert at.reshape(40, 4).tolist() == want and np.array_equal(dist, d[row, at])
