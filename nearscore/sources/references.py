"""Labelled reference vectors, as JSON files and as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearscore.functions.config import DIMS
from nearscore.functions.vectors import fitted, permute


def is_fraud(label: Column) -> Column:
    return (F.coalesce(label, F.lit("legitimate")) == "fraud").cast("int")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, vector (engine order), is_fraud of a JSON array of {vector, label}, plain or gzip. Vectors are cut or
    filled to 14 values; an entry without one raises. ref_id is the place in the file
    (of several files, unique).

    A JSON array cannot be split, so one task streams through a file; rows are dealt out after it. Files for a cluster are
    better kept as JSON lines or, once read, by write_references().
    """
    entries = spark.read.schema("vector array<float>, label string").json(path, multiLine=True).withColumn("ref_id", F.monotonically_increasing_id())
    vector = F.when(F.col("vector").isNull(), F.raise_error(F.lit("a reference has no vector"))).otherwise(fitted(F.col("vector")))
    return entries.select("ref_id", permute(vector).alias("vector"), is_fraud(F.col("label")).alias("is_fraud")).repartition(spark.sparkContext.defaultParallelism, "ref_id")


def write_references(refs: DataFrame, path: str) -> None:
    refs.write.parquet(path)


def read_reference_table(spark: SparkSession, path: str) -> DataFrame:
    """Of write_references(); raises if columns are missing."""
    df = spark.read.parquet(path)
    if missing := {"ref_id", "vector", "is_fraud"} - set(df.columns):
        raise ValueError(f"{path}: no reference table, {sorted(missing)} missing")
    return df


def read_test_entries(spark: SparkSession, path: str) -> DataFrame:
    """payload and expected_approved of {entries: [{request, expected_approved}]}."""
    rows = spark.read.schema("entries array<struct<request: string, expected_approved: boolean>>").json(path, multiLine=True)
    return rows.select(F.posexplode("entries").alias("entry_id", "e")).select("entry_id", F.col("e.request").alias("payload"), "e.expected_approved")


def synthetic(spark: SparkSession, n: int, dims: int = DIMS, seed: int = 42) -> DataFrame:
    """Random vectors in [0, 1) for load tests."""
    return spark.range(n).select(F.col("id").alias("ref_id"), F.array(*(F.rand(seed + i).cast("float") for i in range(dims))).alias("vector"), (F.rand(seed + dims) < 0.3).cast("int").alias("is_fraud"))
