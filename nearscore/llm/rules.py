"""Quality rules as a learned decision list.

Statistics of whole texts are counted in one pass. The list is learned from labelled rows by sequential covering: a
rule for "reject" is grown on two thirds of the rows, a threshold at a time (the one with the most information gained
over the rows still covered), then pruned from its end while that does not lower its worth on the other third; rows
that it covers are taken out, and the next rule begins, until a rule is right for less than `least` of its rows (0.6), or there are `most_rules` (12);
a rule has at most `most_conditions` (4). The list comes
out as one ordered Spark expression, CASE WHEN rule THEN false ... ELSE true, which the engine compiles.

Labelled rows are drawn by a hash of their id, about SAMPLE at most; that is the only bound, and it holds only for the
fit. Cases: null and empty texts have no words and fail the base rules; rows without a label or with a null one are not
learned from; without labels the list is empty and only the base rules decide; repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearscore.llm.common import map_batches, table

#: About so many labelled rows are used to learn.
SAMPLE = 8192
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_caps", "n_marks")
#: Features that rules set thresholds on: each a ratio of two statistics.
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "caps_words": ("n_caps", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
}


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that are found twice or more, the first time included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    first: dict[tuple, int] = {}
    repeats: set[int] = set()
    for i, w in enumerate(zip(*(words[k:] for k in range(WINDOW)))):
        j = first.setdefault(w, i)
        if j != i:
            repeats.update((i, j))
    total, end = 0, 0
    for i in sorted(repeats):
        total += i + WINDOW - max(i, end)
        end = i + WINDOW
    return total


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS of a text."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), len(set(words)), sum(map(bytes.isupper, words)), text.count("!") + text.count("?"),
    )


def with_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and STATS of every row."""

    def rows(batches):
        for batch in batches:
            columns = zip(*(statistics(t.as_py()) for t in batch.column(1))) if batch.num_rows else [()] * len(STATS)
            yield {"id": batch.column(0)} | {k: [*v] for k, v in zip(STATS, columns)}

    columns = df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text")
    return map_batches(columns, rows, "id long, " + ", ".join(f"{k} long" for k in STATS))


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: dict):
    """Mask of the rows that a rule covers."""
    import numpy as np

    mask = np.ones(len(next(iter(x.values()))), bool)
    for name, side, at in rule:
        mask &= x[name] >= at if side == ">=" else x[name] < at
    return mask


def _grow(x: dict, bad, most_conditions: int) -> Rule:
    import numpy as np

    rule: Rule = []
    while len(rule) < most_conditions:
        mask = _covers(rule, x)
        p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
        if not p or not n:
            break
        now, best = math.log2(p / (p + n)), (0.0, None)
        for name, v in x.items():
            for at in np.unique(np.quantile(v[mask], np.linspace(0.02, 0.98, 49))):
                for side in (">=", "<"):
                    hit = mask & (v >= at if side == ">=" else v < at)
                    q, m = int((hit & bad).sum()), int((hit & ~bad).sum())
                    if q and (gain := q * (math.log2(q / (q + m)) - now)) > best[0] + 1e-9:
                        best = gain, (name, side, float(at))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _worth(rule: Rule, x: dict, bad) -> float:
    mask = _covers(rule, x)
    p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict, bad, most_rules: int = 12, most_conditions: int = 4, least: float = 0.6) -> list[Rule]:
    """Rules for bad rows, in order. x: name to an array of values; bad: an array of booleans. least: the share of
    rows a rule covers that have to be bad, on the rows it was pruned on."""
    import numpy as np

    bad, rules = np.asarray(bad, bool), []
    rest = np.ones(len(bad), bool)
    while len(rules) < most_rules and (rest & bad).sum() >= 3:
        at = np.flatnonzero(rest)
        grow, prune = at[np.arange(len(at)) % 3 > 0], at[np.arange(len(at)) % 3 == 0]
        part = lambda i: {k: v[i] for k, v in x.items()}
        rule = _grow(part(grow), bad[grow], most_conditions)
        pruned = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, part(prune), bad[prune]), default=[])
        hit = rest & _covers(pruned, x) if pruned else None
        if not pruned or _worth(pruned, part(prune), bad[prune]) < 2 * least - 1 or (hit & bad).sum() < least * hit.sum():
            break
        rules.append(pruned)
        rest &= ~hit
    return rules


def ratio(name: str) -> Column:
    over, under = RATIOS[name]
    return F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1)).cast("double")


def verdict(rules: list[Rule]) -> Column:
    """True for rows to keep: an ordered conditional over STATS."""
    tests = [reduce(lambda a, b: a & b, (ratio(k) >= F.lit(v) if side == ">=" else ratio(k) < F.lit(v) for k, side, v in rule)) for rule in rules]
    chain = F
    for test in tests:
        chain = chain.when(test, F.lit(False))
    return chain.otherwise(F.lit(True)) if tests else F.lit(True)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled(docs: DataFrame, labels: DataFrame, sample: int, **columns: Column) -> DataFrame:
    """Rows of docs with a label, about `sample` at most, drawn by a hash of the id; columns: of labels, by doc_id."""
    chosen = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(v.alias(k) for k, v in columns.items())).na.drop()
    share = min(1.0, sample / max(1, chosen.count()))
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about `sample` rows


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    rows = labelled(docs, labels, sample, good=F.min("quality"))
    stats = with_statistics(rows, "doc_id", "text").join(F.broadcast(rows.select("doc_id", "good").distinct()), F.col("id") == F.col("doc_id"))
    got = stats.select("id", "good", *(ratio(k).alias(k) for k in RATIOS), base_failed().alias("failed")).where("NOT failed").toPandas()
    got = got.sort_values([*RATIOS, "id"], ignore_index=True).sample(frac=1, random_state=0)
    return learn({k: got[k].to_numpy() for k in RATIOS}, (got["good"] == 0).to_numpy()) if len(got) else []


def judge(df: DataFrame, id_col: str, text_col: str, rules: list[Rule]) -> DataFrame:
    """id, STATS, base_failed and kept of every row."""
    return with_statistics(df, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(docs, "doc_id", "text", rules).select(F.col("id").alias("doc_id"), *columns)
