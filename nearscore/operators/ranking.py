"""Places in a total order, and order statistics, without sorting in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """Written to the cluster's shared checkpoint folder and read from there; the lineage ends here."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="nearscore-checkpoint-"))  # one process, as in tests
    return df.checkpoint(eager=True)


def placed(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """df with its row's place, from 0, in the total order of the given columns.

    A range partitioning sorts in many tasks; the rows are made durable once, so that counting the partitions and
    numbering their rows see the same ones; the counts, one a partition, are added up on the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect())  # one row a partition
    first, starts = 0, {}
    for p, n in counts:
        starts[p], first = first, first + n
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([*starts.items()], "__part long, __first long"))  # one row a partition
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__part", part).join(table, "__part").withColumn(name, F.col("__first") + within).drop("__at", "__part", "__first")


def index_percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """The values at place int(n * share) of the ascending order, in columns by name; no interpolation."""
    ranked = durable(placed(df.select(value).where(F.col(value).isNotNull()), value))
    n = ranked.count()
    at = {k: min(int(n * s), n - 1) for k, s in shares.items()}
    return ranked.agg(*(F.max(F.when(F.col("place") == p, F.col(value))).alias(k) for k, p in at.items()))
