"""What the operators of this subpackage share: reading, durable cuts of lineage, size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir; one of our own is made only where that is
    unset and everything runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="nearscore-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, so that a lost executor costs no more than the work since this point."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and checkpoints that no DataFrame needs any more; otherwise they stay until the
    driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours in shared storage, through Spark's own file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (materialised: it is counted) with a broadcast hint if its counted size is under limit; else left to a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def text_or_empty(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names that df has no column of, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, rows, schema: str) -> DataFrame:
    """mapInArrow by a function from an iterator of record batches to dicts of lists or Arrow arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa

        for out in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if isinstance(out[f.name], list) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with a gapless rank from 0 within each value of group, numbered without putting a group into one task.

    A group is cut into blocks by a hash of the order columns; blocks are counted with map-side combining, and a
    running sum of the counts gives each its first rank. df must be cheap to read twice and rows of equal order
    columns interchangeable.
    """
    from pyspark.sql import Window as W

    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = rows.groupBy(group, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(group, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = rows.withColumn("__rank", F.row_number().over(W.partitionBy(group, "__block").orderBy(*order)))
    return within.join(first, [group, "__block"]).withColumn(name, F.col("__first") + F.col("__rank") - 1).drop("__block", "__rank", "__first")


def _hash_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and label (the component's least node) of every node of edges (u, v), both long.

    Alternating large and small stars (Kiveris et al., 2014), a checkpoint a round; nothing is collected but a count
    and a checksum of the edges. Least neighbours are found with map-side combining; the joins that carry them back
    are plain ones, which AQE splits where a node is hot.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    nodes, last = edges, _hash_of(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(edges.select("e.u", "e.v").where("u <> v").distinct())
        now = _hash_of(edges)
        if now == last:
            break
        last = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct()) if last[0] else nodes.select(F.col("u").alias("node"), F.col("v").alias("label"))
