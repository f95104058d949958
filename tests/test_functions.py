import json

import pytest
from pyspark.sql import functions as F

from nearscore.functions import scalars as S
from nearscore.functions import vectors as V
from nearscore.functions.config import DIM_ORDER, FEATURES, FILE_ORDER, MCC_RISK, Normalization, ScoringConfig, mcc_from_json
from nearscore.operators.featurize import featurize, featurize_vector, mcc_lookup
from nearscore.queries import F1, GOLDEN


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_kernels(spark):
    arr = lambda v, t="smallint": F.array(*(F.lit(x).cast(t) for x in v))
    assert one(spark, V.l2_squared_int(arr([*range(1, 15), 0, 0]), arr([*range(2, 16), 0, 0]), 16)) == 14
    assert one(spark, V.l2_squared_int(arr([*range(1, 15), 0, 0]), arr([*range(2, 16), 0, 0]), 16, 8)) == 8
    assert one(spark, V.l2_squared(arr([1.0] + [0.0] * 15, "float"), arr([0.0] * 16, "float"), 16)) == 1.0
    box = arr([0] * 16), arr([10] * 14 + [0, 0])
    assert one(spark, V.bbox_lower_bound(arr([5] * 14 + [0, 0]), *box, 16)) == 0
    assert one(spark, V.bbox_lower_bound(arr([15] + [5] * 13 + [0, 0]), *box, 16)) == 25
    assert one(spark, V.padded(arr([1.0] * 14, "float"))) == [1.0] * 14 + [0.0] * 2
    assert one(spark, V.dot(arr([1.0, 2.0], "float"), arr([3.0, 4.0], "float"), 2)) == 11.0


def test_quantisation_rounds_queries_and_cuts_references(spark):
    v = F.array(*(F.lit(x).cast("float") for x in (0.1057, -0.1057, 1.0, -1.0, 9.0, -9.0)))
    assert one(spark, V.quantize_query(v)) == [433, -433, 4096, -4096, 32767, -32768]
    assert one(spark, V.quantize_reference(v)) == [432, -432, 4096, -4096, 32767, -32768]


@pytest.mark.parametrize("payload", list(GOLDEN))
def test_golden_payloads(spark, payload):
    row = featurize(spark.createDataFrame([(payload,)], "payload string")).first()
    assert [row[f] for f in FEATURES] == pytest.approx(GOLDEN[payload], abs=1e-9)


def changed(**sections):
    p = json.loads(F1)
    for name, fields in sections.items():
        p[name] = {**p[name], **fields} if isinstance(fields, dict) and p.get(name) else fields
    return json.dumps(p)


@pytest.mark.parametrize(
    "payload,want",
    [
        (changed(last_transaction=None), {"km_from_last_tx": -1, "minutes_since_last_tx": -1}),
        (json.dumps({"last_transaction": {}}), {"km_from_last_tx": 0, "minutes_since_last_tx": 0}),
        (changed(last_transaction={"timestamp": "short"}), {"minutes_since_last_tx": 1}),
        (changed(transaction={"requested_at": "nonsense"}), {"minutes_since_last_tx": 0, "hour_of_day": 0, "day_of_week": 0.3333}),
        (changed(transaction={"requested_at": "2026-04-15T10:00:00Z"}), {"minutes_since_last_tx": 0}),
        (changed(transaction={"amount": -5, "installments": 99}), {"amount": 0, "installments": 1, "amount_vs_avg": 0}),
        (changed(customer={"avg_amount": 0}), {"amount_vs_avg": 1}),
        (changed(customer={"known_merchants": None}), {"unknown_merchant": 1}),
        (changed(customer={"known_merchants": [f"x{k}" for k in range(32)] + ["m-001"]}), {"unknown_merchant": 1}),
        (changed(customer={"known_merchants": [f"x{k}" for k in range(31)] + ["m-001"]}), {"unknown_merchant": 0}),
        (changed(merchant={"id": None}), {"unknown_merchant": 1}),
        (changed(merchant={"mcc": "05411"}), {"mcc_risk": 0.15}),
        (changed(merchant={"mcc": "54x1"}), {"mcc_risk": 0.5}),
        (changed(merchant={"mcc": ""}), {"mcc_risk": 0.5}),
        (changed(merchant={"mcc": "123456789012"}), {"mcc_risk": 0.5}),
        (changed(transaction={"amount": "12"}), {"amount": 0}),
        (changed(terminal={"km_from_home": 5000, "other": {"a": 1}}), {"km_from_home": 1}),
        (changed(transaction={"requested_at": "2024-02-29T23:59:59.999+03:00"}), {"hour_of_day": 1, "day_of_week": 0.5}),
        ("not json", {"km_from_last_tx": -1, "amount": 0, "amount_vs_avg": 1}),
        ("[1, 2]", {"km_from_last_tx": -1, "amount": 0}),
    ],
)
def test_payload_quirks(spark, payload, want):
    row = featurize(spark.createDataFrame([(payload,)], "payload string")).first()
    assert {k: row[k] for k in want} == pytest.approx(want, abs=1e-9)


def test_features_are_floats_in_vectors(spark):
    row = featurize_vector(spark.createDataFrame([(F1, 1)], "payload string, vector_id int")).first()
    assert row.vector == pytest.approx(GOLDEN[F1], abs=1e-7) and row.vector_id == 1


def test_mcc_join_equals_map(spark):
    codes = spark.createDataFrame([(c,) for c in [*MCC_RISK, "05411", "", "x", None, "99999"]], "mcc string")
    risks = spark.createDataFrame([*MCC_RISK.items()], "mcc string, risk double")
    rows = mcc_lookup(codes, "mcc", risks, 0.5).withColumn("map", S.mcc_risk(F.col("mcc"), MCC_RISK)).collect()
    assert len(rows) == 15 and all(r.mcc_risk == r.map for r in rows)


def test_round4_multiplies(spark):
    assert one(spark, S.round4(S.num(0.00015))) == 0.0001
    assert one(spark, S.round4(S.num(0.33335))) == pytest.approx(0.3334)


def test_fnv1a(spark):
    def loop(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h

    texts = ["", "a", "m-001", "漢字 é", "x" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.fnv1a(F.col("t")).alias("h")).collect()
    assert all(r.h % 2**64 == loop(r.t.encode()) for r in rows)


def test_answers(spark):
    rows = spark.range(-1, 8).select("id", S.fraud_count(F.col("id")).alias("n"), S.fraud_score(S.fraud_count(F.col("id"))).alias("s")).collect()
    assert {r.id: (r.n, r.s) for r in rows} == {-1: (0, 0), 0: (0, 0), 1: (1, 0.2), 2: (2, 0.4), 3: (3, 0.6), 4: (4, 0.8), 5: (5, 1.0), 6: (0, 0), 7: (0, 0)}


def test_config_json():
    assert Normalization.from_json('{"max_km": 5, "max_minutes": "x", "other": 1}') == Normalization(max_km=5.0)
    with pytest.raises(ValueError):
        Normalization(max_km=0)
    assert mcc_from_json('{"5411": 0.1, "x": 1, "10000": 1, "07": 0.2, "1": "a"}') == {"5411": 0.1, "7": 0.2}
    assert DIM_ORDER == (6, 10, 9, 5, 11, 2, 4, 7, 0, 1, 8, 12, 3, 13) and sorted(FILE_ORDER) == sorted(FEATURES)
    assert ScoringConfig().mcc_risk == MCC_RISK
