import pytest

ODD = [
    (1, "the quick brown fox jumps over the lazy dog near the old mill\nsame line of text here", "a"),
    (2, "the quick brown fox jumps over the lazy dog near the old mill\nsame line of text here", "a"),
    (3, None, None),
    (4, "", "b"),
    (5, "one two", "b"),
    (6, "ONE two", None),
    (7, "  \t\n \x0b\x0c\r ", "c"),
    (8, "word " * 30_000, "c"),
    (None, "the quick brown fox jumps over the lazy dog near the old mill\nsame line of text here", "a"),
    (9, "naïve Δ 漢字 😀 \x00 end\n\nSame Line of text here  ", "a"),
    (1, "the quick brown fox jumps over the lazy dog near the old mill\nsame line of text here", "a"),
    (10, "x" * 50_000, "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that clash."""
    rows = [(i, t, s, 0, "k", 1.0, None) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id long, h string, n double, _text string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, id long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
