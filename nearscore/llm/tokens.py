"""The BPE operator over a DataFrame: whole texts to token ids and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearscore.llm import bpe
from nearscore.llm.common import map_batches, table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """id and ids (array of int) of every row; null text has none."""

    def rows(batches):
        b = bpe.load(path)
        for batch in batches:
            yield {"id": batch.column(0), "ids": [b.encode(t) for t in batch.column(1).to_pylist()]}

    return map_batches(df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text"), rows, "id long, ids array<int>")


def decode(df: DataFrame, id_col: str, ids_col: str, path: str) -> DataFrame:
    """id and text of every row of ids; null ids give empty text."""

    def rows(batches):
        b = bpe.load(path)
        for batch in batches:
            yield {"id": batch.column(0), "text": [b.decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_batches(df.selectExpr(f"cast(`{id_col}` as long) id", f"`{ids_col}` ids"), rows, "id long, text string")


def digests(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """Number of tokens and digests of a text's ids and of what they decode to; ids pass through the encoder into the
    decoder piece by piece, so a text's ids are never held whole."""

    def rows(batches):
        b = bpe.load(path)
        for batch in batches:
            n, ids, text = zip(*(bpe.digests(b, t.as_py()) for t in batch.column(1))) if batch.num_rows else ((), (), ())
            yield {"doc_id": batch.column(0), "n_tokens": [*n], "ids_sha256": [*ids], "decoded_sha256": [*text]}

    columns = df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text")
    return map_batches(columns, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), "doc_id", "text", word_bpe())
