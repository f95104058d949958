"""Transaction payloads: schema, reading and writing as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearscore.functions.config import MOST_PAYLOAD

PAYLOAD = (
    "transaction STRUCT<amount: DOUBLE, installments: DOUBLE, requested_at: STRING>, "
    "customer STRUCT<avg_amount: DOUBLE, tx_count_24h: DOUBLE, known_merchants: ARRAY<STRING>>, "
    "merchant STRUCT<id: STRING, mcc: STRING, avg_amount: DOUBLE>, "
    "terminal STRUCT<is_online: BOOLEAN, card_present: BOOLEAN, km_from_home: DOUBLE>, "
    "last_transaction STRUCT<timestamp: STRING, km_from_current: DOUBLE>"
)


def parsed(payload: Column) -> Column:
    """A payload's struct. Unknown keys are ignored, what is missing or of another type is null, and a text that is no
    JSON object has all fields null. Nothing raises."""
    return F.from_json(payload, PAYLOAD, {"mode": "PERMISSIVE"})


def bad_request(payload: Column) -> Column:
    """Missing payloads and those over MOST_PAYLOAD bytes get an error instead of a score."""
    return payload.isNull() | (F.octet_length(payload) > MOST_PAYLOAD)


def read_payload_lines(spark: SparkSession, path: str, shortest: int = 5, first: int | None = None) -> DataFrame:
    """One payload a line; shorter lines are no payloads. first: so many only, as for a warm-up."""
    lines = spark.read.text(path).where(F.length("value") >= shortest).withColumnRenamed("value", "payload")
    return lines if first is None else lines.limit(first)


def load(spark: SparkSession, payloads: list[str], n: int) -> DataFrame:
    """query_id, payload: n requests that go round the given payloads, for load tests."""
    return spark.range(n).select(F.col("id").alias("query_id"), F.element_at(F.array(*map(F.lit, payloads)), (F.col("id") % len(payloads) + 1).cast("int")).alias("payload"))


def read_payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """query_id, payload: a stream of files of requests, one on a line. The id is a hash of file and line, the same if a batch
    is read again; equal lines of a file share it, and their answers are equal."""
    return spark.readStream.text(path).select(F.xxhash64("_metadata.file_path", "value").alias("query_id"), F.col("value").alias("payload"))


def write_payload_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, keys in order of their names."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)


def warmup_payloads(spark: SparkSession, amounts: list[float], mccs: list[str], kms: list[float], n: int) -> DataFrame:
    """The first n combinations of three value lists, attributes that cycle with their number beside them. Which rows
    come is computed from their number, so nothing is multiplied out that is not returned."""
    width = len(mccs) * len(kms)
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    i = F.col("id")
    return spark.range(min(n, len(amounts) * width)).select(
        i.alias("idx"), pick(amounts, F.floor(i / width)).alias("amount"), pick(mccs, F.floor(i / len(kms)) % len(mccs)).alias("mcc"), pick(kms, i % len(kms)).alias("km_from_home"),
        (1 + i % 12).cast("int").alias("installments"), (i % 20).cast("int").alias("tx_count_24h"), (i % 24).cast("int").alias("hour_of_day"), (i % 7).cast("int").alias("day_of_week"), (i % 2).cast("int").alias("terminal_flag"),
    )
