"""Queries of the engine over the test tables, each with the same in SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearscore.functions import scalars as S
from nearscore.functions import vectors as V
from nearscore.functions.config import DIM_ORDER, FEATURES, MCC_RISK, REJECT_AT, SCALE
from nearscore.operators import analytics, ivf, knn, mlp
from nearscore.operators import kmeans as K
from nearscore.operators.featurize import featurize, mcc_lookup
from nearscore.operators.ranking import durable
from nearscore.plans.scoring import ScoringContext, score
from nearscore.sources import index_io
from nearscore.sources import tables as T
from nearscore.sources.model_file import Network
from nearscore.sources.payloads import PAYLOAD, parsed, warmup_payloads
from nearscore.streaming.score_stream import parquet_sink, score_stream

Q: dict = {}
SQL: dict[str, str] = {}

EMBEDDING_DIMS, EVENT_DIMS = 64, len(FEATURES)
# the embeddings have hardly any clusters: 12 probes of 16 find 0.944 and 0.924 of the true neighbours at sf0.01 and sf0.1
E_CLUSTERS, E_PROBES, V_CLUSTERS, V_PROBES = 16, 12, 64, 8


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# SQL shared by several queries


def r4(x: str) -> str:
    return f"(round(({x}) * 10000::DOUBLE) / 10000::DOUBLE)"


def unit(x: str, most: float) -> str:
    return r4(f"least(greatest(({x}) / {most}::DOUBLE, 0::DOUBLE), 1::DOUBLE)")


HISTORY_SQL = """
e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
h AS (
  SELECT *, lag(ts) OVER u AS last_ts, lag(k) OVER u AS last_k,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) - 1 AS tx24,
    count(*) OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
    (sum(CAST(round(value * 100::DOUBLE) AS BIGINT)) OVER (PARTITION BY user_id))::DOUBLE / count(*) OVER (PARTITION BY user_id) / 100::DOUBLE * 20::DOUBLE AS user_avg,
    (sum(CAST(round(value * 100::DOUBLE) AS BIGINT)) OVER (PARTITION BY k))::DOUBLE / count(*) OVER (PARTITION BY k) / 100::DOUBLE * 20::DOUBLE AS k_avg
  FROM e WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""
FEATURE_SQL = {
    "km_from_last_tx": f"CASE WHEN last_ts IS NULL THEN -1::DOUBLE ELSE {unit('abs(k - last_k)::DOUBLE * 10::DOUBLE', 1000)} END",
    "card_present": "(event_type = 'purchase')::INT::DOUBLE",
    "is_online": "(event_type IN ('view', 'click'))::INT::DOUBLE",
    "minutes_since_last_tx": f"CASE WHEN last_ts IS NULL THEN -1::DOUBLE ELSE {unit('(floor(epoch(ts)) - floor(epoch(last_ts))) / 60::DOUBLE', 1440)} END",
    "unknown_merchant": "(seen = 0)::INT::DOUBLE",
    "amount_vs_avg": f"CASE WHEN user_avg = 0 THEN 1::DOUBLE ELSE {unit('(value * 20::DOUBLE) / user_avg', 10)} END",
    "day_of_week": r4("(isodow(ts) - 1)::DOUBLE / 6::DOUBLE"),
    "km_from_home": unit("abs(k - 50)::DOUBLE * 20::DOUBLE", 1000),
    "amount": unit("value * 20::DOUBLE", 10000),
    "installments": unit("(1 + k % 12)::DOUBLE", 12),
    "tx_count_24h": unit("tx24::DOUBLE", 20),
    "mcc_risk": "CASE event_type WHEN 'view' THEN 0.15::DOUBLE WHEN 'click' THEN 0.30::DOUBLE WHEN 'error' THEN 0.80::DOUBLE WHEN 'purchase' THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END",
    "hour_of_day": r4("hour(ts)::DOUBLE / 23::DOUBLE"),
    "merchant_avg_amount": unit("k_avg", 10000),
}
FEATURES_SQL = f"{HISTORY_SQL}, f AS (SELECT event_id, {', '.join(f'{FEATURE_SQL[k]} AS {k}' for k in FEATURES)}, (event_type = 'error')::INT AS is_fraud FROM h)"


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def q_query(v: str) -> str:
    return f"list_transform({v}, lambda x: least(greatest(round(x::DOUBLE * {SCALE}::DOUBLE), -32768), 32767)::BIGINT)"


def q_ref(v: str) -> str:
    return f"list_transform({v}, lambda x: trunc(least(greatest(x::DOUBLE * {SCALE}::DOUBLE, -32768), 32767))::BIGINT)"


EMBEDDINGS_SQL = "refs AS (SELECT vec_id AS ref_id, embedding AS vector, (label >= 7)::INT AS is_fraud FROM embeddings)"
EVENTS_SQL = f"{FEATURES_SQL}, refs AS (SELECT event_id AS ref_id, [{', '.join(f'{k}::FLOAT' for k in FEATURES)}] AS vector, is_fraud FROM f)"
SEARCHES_SQL = f"queries AS (SELECT ref_id AS query_id, vector FROM refs WHERE ref_id % {T.EVERY} = 0)"


def exact_sql(refs: str, k: int = 5) -> str:
    return f"""{refs}, {SEARCHES_SQL},
pairs AS (SELECT query_id, ref_id, is_fraud, {l2('q.vector', 'r.vector')} AS distance FROM queries q, refs r),
exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs) WHERE rank <= {k})"""


def init_sql(refs: str, k: int) -> str:
    return f"""{refs},
placed AS (SELECT *, row_number() OVER (ORDER BY ref_id) - 1 AS place, count(*) OVER () AS n_all FROM refs),
c0 AS (SELECT c AS cluster_id, p.ref_id, p.vector AS centroid FROM placed p, range({k}) t(c) WHERE p.place = c * n_all // {k})"""


def assign_sql(centroids: str, name: str) -> str:
    return f"""{name} AS (SELECT ref_id, vector, is_fraud, cluster_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY distance, cluster_id) AS rn FROM (
    SELECT r.ref_id, r.vector, r.is_fraud, c.cluster_id, {l2('r.vector', 'c.centroid')} AS distance FROM refs r, {centroids} c)) WHERE rn = 1)"""


def means_sql(assigned: str, name: str, dims: int) -> str:
    return f"{name} AS (SELECT cluster_id, count(*) AS n, [{', '.join(f'avg(vector[{i + 1}]::DOUBLE)' for i in range(dims))}] AS centroid FROM {assigned} GROUP BY cluster_id)"


def index_sql(refs: str, k: int, dims: int, rounds: int, nprobe: int) -> str:
    """CTEs up to cand: the ten nearest by quantised distance among the members of the probed clusters."""
    ctes, last = [init_sql(refs, k)], "c0"
    for r in range(rounds):
        ctes += [assign_sql(last, f"a{r}"), means_sql(f"a{r}", f"m{r}", dims), f"c{r + 1} AS (SELECT o.cluster_id, coalesce(m.centroid, o.centroid) AS centroid FROM {last} o LEFT JOIN m{r} m ON m.cluster_id = o.cluster_id)"]
        last = f"c{r + 1}"
    ctes += [
        assign_sql(last, "a"), means_sql("a", "m", dims), SEARCHES_SQL,
        f"posted AS (SELECT cluster_id, ref_id, is_fraud, vector, distance, {q_ref('vector')} AS rvec FROM a)",
        f"clusters AS (SELECT cluster_id, n, {q_ref('centroid')} AS centroid FROM m)",
        f"qq AS (SELECT query_id, vector, {q_query('vector')} AS qvec FROM queries)",
        f"""probes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, cluster_id) AS probe FROM (
  SELECT query_id, qvec, cluster_id, {l2('qvec', 'centroid')} AS d FROM qq, clusters)) WHERE probe <= {nprobe})""",
        f"""cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM (
  SELECT p.query_id, o.ref_id, o.is_fraud, {l2('p.qvec', 'o.rvec')}::BIGINT AS distance FROM probes p JOIN posted o ON o.cluster_id = p.cluster_id)) WHERE rank <= 10)""",
    ]
    return ",\n".join(ctes)


def vote_sql(source: str) -> str:
    return f"SELECT query_id, sum(is_fraud)::INT AS fraud_count, sum(is_fraud) < {REJECT_AT} AS approved, sum(is_fraud) / 5::DOUBLE AS fraud_score FROM {source} GROUP BY query_id"


E_INDEX = index_sql(EMBEDDINGS_SQL, E_CLUSTERS, EMBEDDING_DIMS, 1, E_PROBES)
V_INDEX = index_sql(EVENTS_SQL, V_CLUSTERS, EVENT_DIMS, 0, V_PROBES)
RERANKED_SQL = f"""reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS place FROM (
  SELECT c.query_id, c.ref_id, r.is_fraud, {l2('q.vector', 'r.vector')} AS distance FROM cand c JOIN refs r ON r.ref_id = c.ref_id JOIN queries q ON q.query_id = c.query_id)) WHERE place <= 5)"""


# features

F1 = '{"transaction":{"amount":250.00,"installments":1,"requested_at":"2026-04-15T13:42:11Z"},"customer":{"avg_amount":180.00,"tx_count_24h":3,"known_merchants":["m-001","m-002"]},"merchant":{"id":"m-001","mcc":"5411","avg_amount":200.00},"terminal":{"is_online":true,"card_present":true,"km_from_home":2.5},"last_transaction":{"timestamp":"2026-04-15T11:10:00Z","km_from_current":1.8}}'
F2 = '{"transaction":{"amount":100,"installments":0,"requested_at":"2026-01-01T12:00:00Z"},"customer":{"avg_amount":100,"tx_count_24h":1,"known_merchants":[]},"merchant":{"id":"m-999","mcc":"1234","avg_amount":50},"terminal":{"is_online":false,"card_present":false,"km_from_home":0},"last_transaction":null}'
GOLDEN = {
    F1: (0.0018, 1, 1, 0.1057, 0, 0.1389, 0.3333, 0.0025, 0.025, 0.0833, 0.15, 0.15, 0.5652, 0.02),
    F2: (-1, 0, 0, -1, 1, 0.1, 0.5, 0, 0.01, 0, 0.05, 0.5, 0.5217, 0.005),
    "{}": (-1, 0, 0, -1, 1, 1, 0.3333, 0, 0, 0, 0, 0.5, 0, 0),
    "": (0,) * 14,
}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"{v}::DOUBLE" if k else str(v) for k, v in enumerate(r)) + ")" for r in rows)


@query(f"SELECT * FROM (VALUES {_values((i, *v) for i, v in enumerate(GOLDEN.values()))}) t(payload_id, {', '.join(FEATURES)})")
def feat_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(GOLDEN)], "payload_id int, payload string")
    return featurize(rows).select("payload_id", *FEATURES)


def _features(name: str, *columns: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return T.event_features(spark, sf_dir).select("event_id", *columns)

    f.__name__ = name
    query(f"WITH {FEATURES_SQL} SELECT event_id, {', '.join(columns)} FROM f")(f)


_features("feat_vector", *FEATURES, "is_fraud")
_features("feat_amount_ratio", "amount", "amount_vs_avg", "installments", "merchant_avg_amount")
_features("feat_dow_hour", "day_of_week", "hour_of_day")
_features("feat_minutes_last", "minutes_since_last_tx", "km_from_last_tx", "km_from_home")
_features("feat_unknown_merchant", "unknown_merchant", "is_online", "card_present")
_features("feat_tx_count_24h", "tx_count_24h")
_features("label_encode", "is_fraud")


@query(f"WITH {FEATURES_SQL} SELECT event_id, mcc_risk FROM f")
def feat_mcc_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks = spark.createDataFrame([*MCC_RISK.items()], "mcc string, risk double")
    return mcc_lookup(T.transactions(spark, sf_dir).select("event_id", "merchant.mcc"), "mcc", risks, 0.5).select("event_id", "mcc_risk")


@query(f"""WITH {HISTORY_SQL}
SELECT event_id, value * 20::DOUBLE AS amount, (1 + k % 12)::DOUBLE AS installments, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS requested_at, user_avg AS avg_amount, tx24::DOUBLE AS tx_count_24h,
  CASE WHEN seen > 0 THEN 1 ELSE 0 END AS n_known, 'm-' || k AS merchant_id, k_avg AS merchant_avg, event_type IN ('view', 'click') AS is_online, strftime(last_ts, '%Y-%m-%dT%H:%M:%SZ') AS last_at, abs(k - last_k)::DOUBLE * 10::DOUBLE AS last_km
FROM h""")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.payloads(spark, sf_dir).select(F.col("query_id").alias("event_id"), parsed(F.col("payload")).alias("p"))
    return rows.select(
        "event_id", "p.transaction.amount", "p.transaction.installments", "p.transaction.requested_at", "p.customer.avg_amount", "p.customer.tx_count_24h", F.size("p.customer.known_merchants").alias("n_known"),
        F.col("p.merchant.id").alias("merchant_id"), F.col("p.merchant.avg_amount").alias("merchant_avg"), "p.terminal.is_online", F.col("p.last_transaction.timestamp").alias("last_at"), F.col("p.last_transaction.km_from_current").alias("last_km"),
    )


# vectors


@query("SELECT vec_id, " + ", ".join(f"embedding[{p + 1}]::DOUBLE AS d{i}" for i, p in enumerate(DIM_ORDER)) + " FROM embeddings")
def permute_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "embeddings").select("vec_id", V.permute(F.col("embedding")).alias("v"))
    return rows.select("vec_id", *(F.col("v")[i].cast("double").alias(f"d{i}") for i in range(len(DIM_ORDER))))


def _quantized(name: str, how, sql) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = T.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(how(F.col("embedding"))).alias("dim", "q"))
        return rows.select("vec_id", "dim", F.col("q").cast("long").alias("q"))

    f.__name__ = name
    query(f"SELECT vec_id, (unnest(range(64)))::INT AS dim, unnest({sql('embedding')}) AS q FROM embeddings")(f)


_quantized("quantize_query", V.quantize_query, q_query)
_quantized("quantize_ref", V.quantize_reference, q_ref)


def _distance(name: str, column, sql: str) -> None:
    """Of every vector to the one with the least id."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = T.embedding_references(spark, sf_dir).select("ref_id", "vector")
        first = rows.agg(F.min_by("vector", "ref_id").alias("one"))
        return rows.crossJoin(F.broadcast(first)).select("ref_id", column(F.col("one"), F.col("vector")).alias("d"))  # one row

    f.__name__ = name
    query(f"WITH {EMBEDDINGS_SQL}, one AS (SELECT vector AS one FROM refs ORDER BY ref_id LIMIT 1) SELECT ref_id, {sql} AS d FROM refs, one")(f)


_distance("l2_int16", lambda a, b: V.l2_squared_int(V.quantize_query(a), V.quantize_reference(b), 64), f"{l2(q_query('one'), q_ref('vector'))}::BIGINT")
_distance("l2_prefix8", lambda a, b: V.l2_squared_int(V.quantize_query(a), V.quantize_reference(b), 64, 8), f"{l2(q_query('one[1:8]'), q_ref('vector[1:8]'))}::BIGINT")
_distance("l2_float", lambda a, b: F.round(V.l2_squared(a, b, 64), 6), f"round({l2('one', 'vector')}, 6)")
_distance("dot", lambda a, b: F.round(V.dot(a, b, 64), 6), "round(list_sum(list_transform(list_zip(one, vector), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6)")

BOXES_SQL = f"""{EMBEDDINGS_SQL}, {SEARCHES_SQL}, dims AS (SELECT label AS cluster_id, unnest(range(64)) AS dim, unnest({q_ref('embedding')}) AS q FROM embeddings),
boxes AS (SELECT cluster_id, dim, min(q) AS lo, max(q) AS hi FROM dims GROUP BY cluster_id, dim)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"), V.quantize_reference(F.col("embedding")).alias("qvec"))
    return ivf.bounding_boxes(rows, 64)


@query(f"WITH {BOXES_SQL} SELECT cluster_id, dim::INT AS dim, lo, hi FROM boxes")
def bbox_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select("cluster_id", F.posexplode(F.arrays_zip("bbox_min", "bbox_max")).alias("dim", "b"))
    return rows.select("cluster_id", "dim", F.col("b.bbox_min").cast("long").alias("lo"), F.col("b.bbox_max").cast("long").alias("hi"))


@query(f"""WITH {BOXES_SQL}, qd AS (SELECT query_id, unnest(range(64)) AS dim, unnest({q_query('vector')}) AS q FROM queries)
SELECT query_id, cluster_id, sum(greatest(lo - q, 0, q - hi) * greatest(lo - q, 0, q - hi))::BIGINT AS lower FROM qd JOIN boxes USING (dim) GROUP BY query_id, cluster_id""")
def bbox_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = ivf.quantized(T.searches(T.embedding_references(spark, sf_dir)))
    met = queries.crossJoin(F.broadcast(_boxes(spark, sf_dir)))  # a box for each of ten labels
    return met.select("query_id", "cluster_id", V.bbox_lower_bound(F.col("qvec"), F.col("bbox_min"), F.col("bbox_max"), 64).alias("lower"))


# clusters


@query(f"WITH {init_sql(EMBEDDINGS_SQL, E_CLUSTERS)} SELECT cluster_id::INT AS cluster_id, unnest(range(64))::INT AS dim, unnest(centroid)::DOUBLE AS x FROM c0")
def centroid_stride_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(K.stride_init(T.embedding_references(spark, sf_dir), E_CLUSTERS), "cluster_id int, centroid array<double>")
    return rows.select("cluster_id", F.posexplode("centroid").alias("dim", "x"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = T.embedding_references(spark, sf_dir)
    return K.assign(refs, K.stride_init(refs, E_CLUSTERS))


FIRST_SQL = f"{init_sql(EMBEDDINGS_SQL, E_CLUSTERS)}, {assign_sql('c0', 'a')}"


@query(f"WITH {FIRST_SQL} SELECT ref_id, cluster_id::INT AS cluster_id FROM a")
def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("ref_id", "cluster_id")


@query(f"""WITH {FIRST_SQL}, {means_sql('a', 'm', 64)}, c1 AS (SELECT c0.cluster_id, coalesce(m.centroid, c0.centroid) AS centroid FROM c0 LEFT JOIN m ON m.cluster_id = c0.cluster_id)
SELECT cluster_id::INT AS cluster_id, unnest(range(64))::INT AS dim, round(unnest(centroid), 6) AS x FROM c1""")
def kmeans_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = T.embedding_references(spark, sf_dir)
    rows = spark.createDataFrame(K.step(refs, K.stride_init(refs, E_CLUSTERS), 64), "cluster_id int, centroid array<double>")
    return rows.select("cluster_id", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {FIRST_SQL}, s AS (SELECT cluster_id, count(*) AS n FROM a GROUP BY cluster_id)
SELECT cluster_id::INT AS cluster_id, n, coalesce(sum(n) OVER w, 0)::BIGINT AS first, ((n + 7) // 8 * 8)::BIGINT AS slots, coalesce(sum((n + 7) // 8 * 8) OVER w, 0)::BIGINT AS first_slot
FROM s WINDOW w AS (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_io.offsets(_assigned(spark, sf_dir).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {FIRST_SQL} SELECT ref_id, cluster_id::INT AS cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, ref_id) AS pos FROM a")
def rank_in_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.rank_in_cluster(_assigned(spark, sf_dir)).select("ref_id", "cluster_id", F.col("pos").cast("long").alias("pos"))


# search


def _e_index(spark: SparkSession, sf_dir: str):
    refs = T.embedding_references(spark, sf_dir)
    return refs, ivf.build_index(refs, E_CLUSTERS, 1, EMBEDDING_DIMS, E_PROBES)


def _v_index(spark: SparkSession, sf_dir: str):
    refs = durable(T.event_references(spark, sf_dir))
    return refs, ivf.build_index(refs, V_CLUSTERS, 0, EVENT_DIMS, V_PROBES)


@query(f"WITH {E_INDEX} SELECT query_id, probe, cluster_id::INT AS cluster_id FROM probes")
def probe_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, index = _e_index(spark, sf_dir)
    return ivf.probes(ivf.quantized(T.searches(refs)), index).select("query_id", F.col("probe").cast("long").alias("probe"), "cluster_id")


CANDIDATES_SQL = "SELECT query_id, rank, ref_id, distance FROM cand"


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "ref_id", F.col("distance").cast("long").alias("distance"))


@query(f"WITH {E_INDEX} {CANDIDATES_SQL}")
def ivf_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, index = _e_index(spark, sf_dir)
    return _ranked(ivf.candidates(ivf.quantized(T.searches(refs)), index))


@query(f"WITH {V_INDEX} {CANDIDATES_SQL}")
def bbox_pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, index = _v_index(spark, sf_dir)
    return _ranked(ivf.pruned_candidates(ivf.quantized(T.searches(refs)), index))


@query(f"WITH {E_INDEX}, {RERANKED_SQL} {vote_sql('reranked')}")
def ivf_rerank_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, index = _e_index(spark, sf_dir)
    return knn.vote(ivf.search(T.searches(refs), index, refs, prune=False))


@query(f"WITH {E_INDEX} {vote_sql('(SELECT * FROM cand WHERE rank <= 5)')}")
def ivf_no_rerank_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, index = _e_index(spark, sf_dir)
    return knn.vote(ivf.search(T.searches(refs), index, prune=False))


@query(f"WITH {exact_sql(EMBEDDINGS_SQL)} {vote_sql('exact')}")
def knn_exact_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = T.embedding_references(spark, sf_dir)
    return knn.vote(knn.exact_knn(T.searches(refs), refs))


@query(f"WITH {exact_sql(EVENTS_SQL)} {vote_sql('exact')}")
def knn_events_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = durable(T.event_references(spark, sf_dir))
    return knn.vote(knn.exact_knn(T.searches(refs), refs, dims=EVENT_DIMS))


@query(f"WITH {E_INDEX}, {RERANKED_SQL}, {exact_sql('x AS (SELECT 1)').split(SEARCHES_SQL + ',')[1]} SELECT count(DISTINCT e.query_id) AS queries, round(avg((r.ref_id IS NOT NULL)::INT), 6) AS recall FROM exact e LEFT JOIN reranked r ON r.query_id = e.query_id AND r.ref_id = e.ref_id")
def recall_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, index = _e_index(spark, sf_dir)
    queries = T.searches(refs)
    found = ivf.recall(ivf.search(queries, index, refs, prune=False), knn.exact_knn(queries, refs))
    return found.select("queries", F.round("recall", 6).alias("recall"))


# network

_W1 = [[0.0] * 14, [0.0] * 14, [0.0] * 14]
for _o, _weights in enumerate(({"mcc_risk": 6.0, "card_present": -4.0, "is_online": -2.0}, {"mcc_risk": 3.0, "unknown_merchant": 1.0, "amount": 0.5}, {"card_present": 2.0, "is_online": 3.0, "km_from_home": -0.25})):
    for _k, _v in _weights.items():
        _W1[_o][FEATURES.index(_k)] = _v
_B1, _W2, _B2, GATE = [-3.0, -0.5, 0.25], [[2.5, 0.5, -1.5]], [-1.0], 0.8


def network() -> Network:
    """A small network with stated weights, so that SQL can follow it."""
    import numpy as np

    as_f4 = lambda x: np.array(x, np.float32)
    return Network([(as_f4(_W1), as_f4(_B1)), (as_f4(_W2), as_f4(_B2))], GATE)


_HIDDEN_SQL = ", ".join("greatest(" + " + ".join(f"{w}::DOUBLE * {k}::FLOAT::DOUBLE" for k, w in zip(FEATURES, row) if w) + f" + {b}::DOUBLE, 0::DOUBLE) AS h{o}" for o, (row, b) in enumerate(zip(_W1, _B1)))
PROBABILITY_SQL = f"""{FEATURES_SQL}, hid AS (SELECT *, {_HIDDEN_SQL} FROM f),
p AS (SELECT event_id, is_fraud, 1::DOUBLE / (1::DOUBLE + exp(-({' + '.join(f'{w}::DOUBLE * h{i}' for i, w in enumerate(_W2[0]))} + {_B2[0]}::DOUBLE))) AS probability FROM hid)"""
P_SQL = f"{PROBABILITY_SQL}, s AS (SELECT *, abs(probability - 0.5::DOUBLE) * 2::DOUBLE AS confidence, ((probability >= 0.5)::INT <> is_fraud) AS wrong, (probability >= 0.5)::INT AS predicted FROM p)"


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.event_references(spark, sf_dir)
    return rows.select(F.col("ref_id").alias("event_id"), "is_fraud", mlp.forward_columns(F.col("vector"), network()).alias("probability"))


@query(f"WITH {PROBABILITY_SQL} SELECT event_id, round(probability, 9) AS probability FROM p")
def mlp_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(spark, sf_dir).select("event_id", F.round("probability", 9).alias("probability"))


@query(f"WITH {PROBABILITY_SQL} SELECT event_id, round(probability, 9) AS probability FROM p")
def mlp_forward_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mlp.predict(T.event_references(spark, sf_dir).select(F.col("ref_id").alias("event_id"), "vector"), network())
    return rows.select("event_id", F.round("probability", 9).alias("probability"))


SWEEP = [0.80, 0.85, 0.90, 0.95, 0.97, 0.99]


@query(f"""WITH {P_SQL} SELECT t AS threshold, count(*) FILTER (WHERE confidence >= t) AS handled, count(*) FILTER (WHERE confidence >= t) * 100::DOUBLE / count(*) AS handled_pct, count(*) FILTER (WHERE confidence >= t AND wrong) AS mlp_errors,
count(*) FILTER (WHERE confidence < t) AS knn, count(*) FILTER (WHERE confidence < t) * 100::DOUBLE / count(*) AS knn_pct, count(*) FILTER (WHERE confidence < t AND wrong) AS knn_catches
FROM s, (VALUES {', '.join(f'({t}::DOUBLE)' for t in SWEEP)}) v(t) GROUP BY t""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.threshold_sweep(_probabilities(spark, sf_dir))


@query(f"WITH {P_SQL} SELECT round(coalesce(max(CASE WHEN wrong THEN confidence END) + 0.001::DOUBLE, 0), 9) AS safe_threshold FROM s")
def safe_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.safe_threshold(_probabilities(spark, sf_dir)).select(F.round("safe_threshold", 9).alias("safe_threshold"))


@query("SELECT count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS frauds, sum((event_type = 'error')::INT)::DOUBLE / count(*) AS rate FROM events")
def fraud_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.fraud_rate(T.table(spark, sf_dir, "events").select((F.col("event_type") == "error").cast("int").alias("is_fraud")))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(spark, sf_dir).withColumn("predicted", (F.col("probability") >= S.num(0.5)).cast("int"))


@query(f"WITH {P_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE wrong) AS errors, count(*) FILTER (WHERE NOT wrong)::DOUBLE / count(*) AS accuracy FROM s")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.accuracy(_predicted(spark, sf_dir), "predicted", "is_fraud")


@query(f"WITH {P_SQL} SELECT count(*) FILTER (WHERE predicted = 1 AND is_fraud = 0) AS false_positives, count(*) FILTER (WHERE predicted = 0 AND is_fraud = 1) AS misses, count(*) FILTER (WHERE predicted = 1 AND is_fraud = 0) + 3 * count(*) FILTER (WHERE predicted = 0 AND is_fraud = 1) AS cost FROM s")
def weighted_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.weighted_cost(_predicted(spark, sf_dir), "predicted", "is_fraud")


@query(f"WITH {P_SQL} SELECT event_id, is_fraud, predicted FROM s WHERE wrong ORDER BY event_id LIMIT 10")
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.first_errors(_predicted(spark, sf_dir), "predicted", "is_fraud", 10, "event_id").select("event_id", "is_fraud", "predicted")


@query("""WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events)
SELECT count(*) AS n, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, round(1000 / avg(value), 6) AS rps,
max(CASE WHEN place = floor(n * 0.5::DOUBLE)::BIGINT THEN value END) AS p50_ms, max(CASE WHEN place = floor(n * 0.9::DOUBLE)::BIGINT THEN value END) AS p90_ms, max(CASE WHEN place = floor(n * 0.99::DOUBLE)::BIGINT THEN value END) AS p99_ms FROM o""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.latency_summary(T.table(spark, sf_dir, "events"), "value")
    return rows.withColumn("avg_ms", F.round("avg_ms", 6)).withColumn("rps", F.round("rps", 6))


# answers

GATED_SQL = f"""{P_SQL}, refs AS (SELECT event_id AS ref_id, [{', '.join(f'{k}::FLOAT' for k in FEATURES)}] AS vector, is_fraud FROM f), {SEARCHES_SQL},
open AS (SELECT q.* FROM queries q JOIN s ON s.event_id = q.query_id WHERE confidence < {GATE}::DOUBLE),
pairs AS (SELECT query_id, ref_id, is_fraud, {l2('q.vector', 'r.vector')} AS distance FROM open q, refs r),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs) WHERE rank <= 5),
votes AS (SELECT query_id, sum(is_fraud)::INT AS fraud_count, 'knn' AS source FROM near GROUP BY query_id
  UNION ALL SELECT event_id, CASE WHEN probability >= 0.5 THEN 5 ELSE 0 END, 'mlp' FROM s WHERE confidence >= {GATE}::DOUBLE AND event_id % {T.EVERY} = 0)"""
ANSWER_SQL = f"SELECT query_id, fraud_count, fraud_count < {REJECT_AT} AS approved, fraud_count / 5::DOUBLE AS fraud_score, source"
RESPONSE_SQL = f"""'{{"approved":' || (fraud_count < {REJECT_AT}) || ',"fraud_score":' || printf('%.1f', fraud_count / 5::DOUBLE) || '}}' AS response"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.payloads(spark, sf_dir).where(F.col("query_id") % T.EVERY == 0).select("query_id", "payload")


@query(f"WITH {GATED_SQL} {ANSWER_SQL}, {RESPONSE_SQL} FROM votes")
def gate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = durable(T.event_references(spark, sf_dir))
    return score(_asked(spark, sf_dir), ScoringContext(refs=refs, network=network()))


@query(f"WITH {exact_sql(EVENTS_SQL)}, votes AS (SELECT query_id, sum(is_fraud)::INT AS fraud_count, 'knn' AS source FROM exact GROUP BY query_id) {ANSWER_SQL}, {RESPONSE_SQL} FROM votes")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring plan over a stream that reads a folder of payloads once; results come back from its sink."""
    refs = durable(T.event_references(spark, sf_dir))
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    _asked(spark, sf_dir).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("query_id long, payload string").parquet(f"{folder}/in")
    score_stream(stream, ScoringContext(refs=refs), parquet_sink(f"{folder}/out"), f"{folder}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query(f"""SELECT n AS fraud_count, {RESPONSE_SQL.replace('fraud_count', 'c')} FROM (SELECT n::INT AS n, CASE WHEN n BETWEEN 0 AND 5 THEN n ELSE 0 END AS c FROM range(-2, 9) t(n))""")
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(-2, 9).select(F.col("id").cast("int").alias("fraud_count")).withColumn("response", knn.response(F.col("fraud_count")))


WARM = ([10.5, 99.0, 1500.0], ["5411", "7995", "1234"], [0.5, 40.0, 300.0, 900.0])


@query(f"""SELECT (i * 12 + j * 4 + l)::BIGINT AS idx, a AS amount, m AS mcc, d AS km_from_home, (1 + idx % 12)::INT AS installments, (idx % 20)::INT AS tx_count_24h, (idx % 24)::INT AS hour_of_day, (idx % 7)::INT AS day_of_week, (idx % 2)::INT AS terminal_flag
FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE)' for i, a in enumerate(WARM[0]))}) x(i, a), (VALUES {', '.join(f"({i}, '{m}')" for i, m in enumerate(WARM[1]))}) y(j, m), (VALUES {', '.join(f'({i}, {d}::DOUBLE)' for i, d in enumerate(WARM[2]))}) z(l, d) WHERE i * 12 + j * 4 + l < 30""")
def warmup_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warmup_payloads(spark, *WARM, 30)


@query()
def fnv1a_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no 64-bit wrap-around; a test holds it against a loop."""
    return T.table(spark, sf_dir, "part").select("p_partkey", S.fnv1a(F.col("p_name")).alias("hash"))


@query()
def kmeans_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the pruned search on events after several rounds of K-means, by probes; iterative, so without SQL."""
    refs = durable(T.event_references(spark, sf_dir))
    queries = T.searches(refs)
    posted = ivf.Posted(ivf.build_index(refs, V_CLUSTERS, 5, EVENT_DIMS, V_PROBES))
    truth = durable(knn.exact_knn(queries, refs, dims=EVENT_DIMS))
    rows = [ivf.recall(found, truth).withColumn("nprobe", F.lit(p)) for p, found in ivf.searches(queries, posted, refs, [4, 16, V_CLUSTERS]).items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("nprobe", "queries", F.round("recall", 6).alias("recall"))


