"""Command line: reference file to index, and warm-up payloads.

python -m nearscore.plans.build SOURCE TARGET [clusters] [rounds] [ivf|exact] [nprobe]
python -m nearscore.plans.build gen-warmup TARGET [count]
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from nearscore.functions.config import DIMS, MCC_RISK
from nearscore.operators.ivf import build_index
from nearscore.sources import index_io, payloads, references

CLUSTERS, ROUNDS, NPROBE, WARMUP = 4096, 20, 40, 200
AMOUNTS, KMS = [12.5, 80.0, 250.0, 999.0, 4500.0, 9800.0], [0.5, 12.0, 90.0, 700.0]


class BuildError(ValueError):
    """Arguments or data that no index can be built from."""


def build(spark: SparkSession, source: str, target: str, clusters: int = CLUSTERS, rounds: int = ROUNDS, kind: str = "ivf", nprobe: int = NPROBE) -> None:
    refs = references.read_references(spark, source)
    if kind == "exact":
        references.write_references(refs, target)
    elif kind == "ivf":
        if clusters < 1 or rounds < 0 or nprobe < 1:
            raise BuildError("clusters and nprobe must be at least 1, rounds at least 0")
        index_io.write_index(build_index(refs, clusters, rounds, DIMS, min(2 * nprobe, clusters)), target)
    else:
        raise BuildError(f"unknown format {kind!r}")


def main(args: list[str]) -> None:
    if len(args) < 2:
        raise BuildError(__doc__)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args[0] == "gen-warmup":
        rows = payloads.warmup_payloads(spark, AMOUNTS, [*MCC_RISK], KMS, int(args[2]) if len(args) > 2 else WARMUP)
        payloads.write_payload_lines(rows.drop("idx"), args[1])
        return
    at = lambda i, default: args[i] if len(args) > i else default
    build(spark, args[0], args[1], int(at(2, CLUSTERS)), int(at(3, ROUNDS)), at(4, "ivf"), int(at(5, NPROBE)))


if __name__ == "__main__":
    main(sys.argv[1:])
