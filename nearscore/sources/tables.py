"""The test tables as payloads, references and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearscore.functions.scalars import num
from nearscore.operators.featurize import featurize
from nearscore.functions.config import FEATURES

#: Event types as merchant category codes; the last one is in no risk table.
MCC_OF = {"view": "5411", "click": "5812", "error": "7801", "purchase": "7995", "signup": "1234"}
#: Searches ask for every row whose id this divides, among all rows.
EVERY = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label and the payload's sections, with a customer's history derived from the events before."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    user, before = W.partitionBy("user_id"), W.partitionBy("user_id").orderBy("ts", "event_id")
    cents = F.round(F.col("value") * num(100)).cast("long")
    average = lambda of: of(F.sum(cents)).cast("double") / of(F.count(F.lit(1))) / num(100) * num(20)
    h = events.select(
        "*", F.lag("ts").over(before).alias("last_ts"), F.lag("k").over(before).alias("last_k"),
        F.expr("count(1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) - 1").alias("tx24"),
        F.count(F.lit(1)).over(W.partitionBy("user_id", "k").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)).alias("seen"),
        average(lambda c: c.over(user)).alias("user_avg"),
    )
    each = events.groupBy(F.col("k").alias("of_k")).agg(average(lambda c: c).alias("k_avg"))  # in place of a window, which few values of k would deal to few tasks
    h = h.join(each, F.col("k").eqNullSafe(F.col("of_k")), "left").drop("of_k")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    merchant = F.concat(F.lit("m-"), F.col("k").cast("string"))
    mcc = F.coalesce(F.create_map(*(F.lit(x) for kv in MCC_OF.items() for x in kv))[F.col("event_type")], F.lit("1234"))
    return h.select(
        "event_id", F.when(F.col("event_type") == "error", "fraud").otherwise("legitimate").alias("label"),
        F.struct((F.col("value") * num(20)).alias("amount"), (1 + F.col("k") % 12).cast("double").alias("installments"), iso("ts").alias("requested_at")).alias("transaction"),
        F.struct(F.col("user_avg").alias("avg_amount"), F.col("tx24").cast("double").alias("tx_count_24h"), F.when(F.col("seen") > 0, F.array(merchant)).otherwise(F.array().cast("array<string>")).alias("known_merchants")).alias("customer"),
        F.struct(merchant.alias("id"), mcc.alias("mcc"), F.col("k_avg").alias("avg_amount")).alias("merchant"),
        F.struct(F.col("event_type").isin("view", "click").alias("is_online"), (F.col("event_type") == "purchase").alias("card_present"), (F.abs(F.col("k") - 50).cast("double") * num(20)).alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_ts").isNotNull(), F.struct(iso("last_ts").alias("timestamp"), (F.abs(F.col("k") - F.col("last_k")).cast("double") * num(10)).alias("km_from_current"))).alias("last_transaction"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, label, payload (JSON) of every event."""
    rows = transactions(spark, sf_dir)
    sections = [c for c in rows.columns if c not in ("event_id", "label")]
    return rows.select(F.col("event_id").alias("query_id"), "label", F.to_json(F.struct(*sections)).alias("payload"))


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, FEATURES, is_fraud of every event, by way of its JSON payload."""
    rows = featurize(payloads(spark, sf_dir))
    return rows.select(F.col("query_id").alias("event_id"), *FEATURES, (F.col("label") == "fraud").cast("int").alias("is_fraud"))


def event_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_features(spark, sf_dir)
    return rows.select(F.col("event_id").alias("ref_id"), F.array(*(F.col(c).cast("float") for c in FEATURES)).alias("vector"), "is_fraud")


def embedding_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"), (F.col("label") >= 7).cast("int").alias("is_fraud"))


def searches(refs: DataFrame) -> DataFrame:
    """query_id, vector of the stated query set."""
    return refs.where(F.col("ref_id") % EVERY == 0).select(F.col("ref_id").alias("query_id"), "vector")
