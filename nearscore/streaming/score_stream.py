"""Scoring of a stream of payloads, batch by batch, with the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearscore.plans.scoring import ScoringContext, score


def score_stream(payloads: DataFrame, context: ScoringContext, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "1 second") -> StreamingQuery:
    """Starts a query that scores a stream (query_id, payload) and gives each batch's answers to sink(df, batch).

    Requests keep no state, so there is nothing to watermark. Neighbours need ranks, which streams do not have, so each
    micro-batch runs the batch plan. A batch that is run again after a failure has the same number; a sink that
    overwrites by it stays exactly-once.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(score(batch, context), number)

    writer = payloads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A folder for each batch, written over when the batch is run again."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def ready(query: StreamingQuery) -> bool:
    """Whether the query runs and waits for data or has some: what a readiness probe asks."""
    return query.isActive and query.exception() is None
