import pytest

LONG = " ".join(f"word{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns whose names clash."""
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", "a"), (4, LONG, "b"), (5, LONG, "b"), (5, LONG, "b"), (None, "one two three four five six", None),
        (6, "one two three four five six", "c"), (7, "short text", "c"), (8, "é😀 ÀÉ ſtraße K İ", "c"), (9, None, None),
    ]
    return spark.createDataFrame([(i, t, s, "x", 0, "y") for i, t, s in rows],
                                 "doc_id long, text string, source string, kept string, shard int, component_id string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
