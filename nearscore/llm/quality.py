"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades run from 0 up, in order: by default 0 toxic, 1 poor, 2 good. All grades share one weight vector over hashed
text; ordered thresholds cut the score, P(grade <= k) = sigmoid(threshold k - score). A row gets its expected grade
and the probability of its grade being the highest, by which rows are chosen.

Features are present or absent: each distinct word (ASCII lower-cased, marks at its ends stripped) and the beginnings of
words (4 and 5 bytes, for stems that occur with many endings), runs of marks at the ends of words, and which of a few
STEPS the ratios of marks, capitals and repeated words reach, all hashed into 2**18 buckets. Buckets that few labelled texts
have are left out. The fit sees about SAMPLE labelled rows, drawn by a hash of their id; it is made on the driver from
their bucket numbers; the weights (1 MB) go to the executors, which score whole texts.

Cases: null and empty texts, and texts without a word, get grade 0 with probability 0 and are not kept; null labels are
not learned from; without labels every text with words is kept; repeated rows get equal scores; labels outside 0 and 1
are read as 1 if positive.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearscore.llm.common import map_batches, table
from nearscore.llm.rules import SAMPLE, labelled, statistics

BITS = 18
STRIP = b".,;:!?#*$%&|<>()[]{}\"'"
STEMS = (4, 5)
STEPS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)
CHOOSE = 0.5

SCORES = "id long, expected_grade double, tail_prob double, kept boolean"


def features(text: str | None) -> list[int]:
    """Numbers of the buckets of a text, each once, ascending; none if it has no words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    mask = (1 << BITS) - 1
    crc, distinct_words = zlib.crc32, {w.strip(STRIP) for w in set(words)}
    found = {crc(w) & mask for w in distinct_words}
    for k in STEMS:
        found |= {crc(w, k) & mask for w in {w[:k] for w in distinct_words if len(w) > k}}
    n, chars, symbols, dup, repeat, lines, distinct, caps, marks = statistics(text)
    shares = {"symbols": symbols / n, "caps": caps / n, "marks": marks / n, "dup": dup / lines, "repeat": repeat / n, "distinct": distinct / n}
    found |= {crc(f"{k} {step}".encode(), 1) & mask for k, v in shares.items() for step in STEPS if v >= step}
    found |= {crc(m, 2) & mask for m in {w[len(w.rstrip(STRIP)) :] for w in set(words)} if len(m) > 1}
    found |= {crc(f"length {n.bit_length()}".encode(), 1) & mask, crc(f"mean {chars // n}".encode(), 1) & mask}
    return sorted(found)


class Model:
    """weights over buckets and ascending thresholds, one less than there are grades."""

    def __init__(self, weights, thresholds):
        self.weights, self.thresholds = weights, thresholds

    def score(self, buckets: list[int]) -> tuple[float, float]:
        """Expected grade and probability of the highest."""
        import numpy as np

        if not buckets:
            return 0.0, 0.0
        over = 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[buckets].sum(dtype=np.float64), -50, 50)))
        return float(over.sum()), float(over[-1])


def train(texts: list, grades: list[int], n_grades: int, steps: int = 250, ridge: float = 2e-3, rate: float = 0.05) -> Model:
    """Minimises the mean negative log likelihood with a ridge on the weights, by Adam on all rows at once, in steps that shrink to
    nothing."""
    import numpy as np

    if not grades:  # nothing to go by: all texts with words are of the highest grade
        return Model(np.zeros(1 << BITS, np.float32), np.full(n_grades - 1, -np.inf))
    least = max(3, len(texts) // 1000)
    column = np.concatenate([np.asarray(t, np.int32) for t in texts])
    used = np.flatnonzero(np.bincount(column, minlength=1 << BITS) >= least)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    y = np.asarray(grades)
    # thresholds start from the grades' shares: t0, then logarithms of the steps between
    share = np.clip([(y <= k).mean() for k in range(n_grades - 1)], 0.01, 0.99)
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(params), np.zeros_like(params)

    def thresholds(p):
        return np.cumsum(np.concatenate([p[len(used) : len(used) + 1], np.exp(p[len(used) + 1 :])]))

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        t = np.concatenate([[-np.inf], thresholds(params), [np.inf]])
        score = np.bincount(row, params[column], len(y))
        hi, lo = sigmoid(t[y + 1] - score), sigmoid(t[y] - score)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        grad = np.zeros_like(params)
        grad[: len(used)] = np.bincount(column, ((d_hi - d_lo) / len(y))[row], len(used)) + ridge * params[: len(used)]
        d_t = np.array([(d_lo[y == k + 1].sum() - d_hi[y == k].sum()) / len(y) for k in range(n_grades - 1)])
        tail = d_t[::-1].cumsum()[::-1]
        grad[len(used)] = tail[0]
        grad[len(used) + 1 :] = tail[1:] * np.exp(params[len(used) + 1 :])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = params[: len(used)]
    return Model(weights, thresholds(params))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From quality and toxic labels: grade 0 toxic, 1 poor, 2 good."""
    rows = labelled(docs, labels, sample, quality=F.min("quality"), toxic=F.max("toxic"))

    def found(batches):
        from array import array

        for batch in batches:
            yield {"id": batch.column(0), "grade": batch.column(2), "buckets": [array("i", features(t.as_py())).tobytes() for t in batch.column(1)]}

    graded = rows.select("doc_id", "text", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade"))
    got = sorted(tuple(r) for r in map_batches(graded, found, "id long, grade int, buckets binary").collect())
    import numpy as np

    return train([np.frombuffer(b, np.int32) for _, _, b in got], [g for _, g, _ in got], 3)


def classify(df: DataFrame, id_col: str, text_col: str, model: Model, choose: float = CHOOSE) -> DataFrame:
    """id, expected_grade, tail_prob and kept of every row."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def rows(batches):
        m = Model(*shared.value)
        for batch in batches:
            s = [m.score(features(t.as_py())) for t in batch.column(1)]
            yield {"id": batch.column(0), "expected_grade": [round(g, 9) for g, _ in s], "tail_prob": [round(p, 9) for _, p in s], "kept": [p >= choose for _, p in s]}

    return map_batches(df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text"), rows, SCORES)


def chosen(df: DataFrame, text_col: str, model: Model, choose: float = CHOOSE) -> DataFrame:
    """The rows of df that the model keeps, all columns as they were, in one pass."""
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    at = df.columns.index(text_col)

    def keep(batches):
        m = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([m.score(features(t.as_py()))[1] >= choose for t in batch.column(at)], pa.bool_()))

    return df.mapInArrow(keep, df.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, "doc_id", "text", fit(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
