import pytest

#: Awkward rows for every operator: null id and texts, empty and very long texts, ties, repeated rows.
TEXTS = [
    (0, "the same text, twice"), (1, "the same text, twice"), (1, "the same text, twice"), (2, None), (3, ""), (None, "no id here"), (None, "no id here"),
    (4, " \t\n\x0b\x0c\r "), (5, "a"), (6, "zwei Wörter"), (7, "漢字 😀 ẞ İ Σς <|endoftext|> don't!!"), (8, "x" * 30000), (9, "ab " * 20000), (10, "é \x85\xa0 \x1c 'S"),
    (11, "One line here.\nOne line here.\n\n\nOne line here.\nanother"), (12, "A B C D E F G H I J K L M N"), (13, "a b c d e f g h i j k l m n"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """TEXTS with columns named as the operators' own."""
    rows = [(i, t, "x", 1, 2, "id") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n int, rank int, id string").repartition(3)


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
