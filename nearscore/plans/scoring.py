"""The scoring plan: payloads to answers."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearscore.functions.config import ScoringConfig
from nearscore.operators import ivf, knn, mlp
from nearscore.operators.featurize import featurize_vector
from nearscore.sources.index_io import Index
from nearscore.sources.model_file import Network
from nearscore.sources.payloads import bad_request


@dataclass
class ScoringContext:
    """What a scorer needs. With an index, neighbours come from it, reranked if refs are given; without, from all refs."""

    refs: DataFrame | None = None
    index: Index | None = None
    network: Network | None = None
    config: ScoringConfig = field(default_factory=ScoringConfig)
    nprobe: int = 0
    prune: bool = True
    scan: knn.Scan | None = field(default=None, init=False)

    def __post_init__(self):
        if self.refs is None and self.index is None:
            raise ValueError("a scorer needs references or an index")

    def with_threshold(self, threshold: float) -> ScoringContext:
        return replace(self, network=self.network.with_threshold(threshold)) if self.network else self

    def neighbours(self, queries: DataFrame) -> DataFrame:
        if self.index is None:
            self.scan = self.scan or knn.Scan(self.refs)  # once for all batches of a stream
            return knn.exact_knn(queries, self.scan)
        return ivf.search(queries, self.index, self.refs, self.nprobe or None, self.prune)


def score_vectors(queries: DataFrame, context: ScoringContext) -> DataFrame:
    """query_id, fraud_count, approved, fraud_score, source of queries (query_id, vector). What the network answers
    does not reach the neighbour search."""
    rest, sure = queries, None
    if context.network:
        judged = mlp.gated(mlp.predict(queries, context.network), context.network.threshold)
        sure, rest = mlp.gate_answers(judged), judged.where("NOT confident").select(*queries.columns)
    found = knn.answer_all(rest, knn.vote(context.neighbours(rest))).withColumn("source", F.lit("knn"))
    return found if sure is None else sure.unionByName(found)


def score(df: DataFrame, context: ScoringContext, payload: str = "payload") -> DataFrame:
    """query_id, fraud_count, approved, fraud_score, source, response of payloads (query_id, payload). Payloads that
    are missing or too long have no score, and bad_request as their source."""
    bad = bad_request(F.col(payload))
    refused = df.where(bad).select("query_id", F.lit(None).cast("int").alias("fraud_count"), F.lit(None).cast("boolean").alias("approved"), F.lit(None).cast("double").alias("fraud_score"), F.lit("bad_request").alias("source"), F.lit(None).cast("string").alias("response"))
    good = featurize_vector(df.where(~bad).select("query_id", F.col(payload).alias("payload")), config=context.config).select("query_id", "vector")
    scored = score_vectors(good, context)
    return scored.withColumn("response", knn.response(F.col("fraud_count"))).unionByName(refused)
