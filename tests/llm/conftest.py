import pytest

#: Odd rows: nulls in any column, empty, blank and long texts, ties and repeated rows, columns with clashing names.
ODD = [
    (1, "one two three four five six.\nseven eight nine ten eleven", "a"),
    (1, "one two three four five six.\nseven eight nine ten eleven", "a"),
    (2, None, "b"),
    (None, "one two three four five six.\nseven eight nine ten eleven", None),
    (3, "", "c"),
    (4, " \n\n ", "d"),
    (5, "word " * 30_000 + "end", "e"),
    (6, "x" * 70_000, "f"),
    (7, "<|endoftext|> \x00\x1c été 漢字 \r\n 'tis", "g"),
    (None, None, None),
]
COLUMNS = "doc_id long, text string, row_key string"


@pytest.fixture
def odd(spark):
    extra = [(*r, 1, "x") for r in ODD]
    return spark.createDataFrame(extra, f"{COLUMNS}, removed int, is_toxic string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], f"{COLUMNS}, removed int, is_toxic string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
