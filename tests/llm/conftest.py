import pytest

from marketlake.llm.common import read_table

SF_DIR = "/root/testdata/sf0.001"
LONG = "Stretched" * 30_000


@pytest.fixture(scope="session")
def docs(spark):
    return read_table(spark, SF_DIR, "documents")


@pytest.fixture(scope="session")
def labels(spark):
    return read_table(spark, SF_DIR, "labels")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named like the operators' own."""
    rows = [
        (None, "alone without an id", "en", "a", 19), (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n", "en", None, 3),
        (4, "one two three four five six", "en", "a", 27), (5, "one two three four five  six", "en", "b", 28), (5, "one two three four five  six", "en", "b", 28),
        (6, "ONE two three four five six", "en", "b", 27), (7, "word", "en", "b", 4), (8, LONG, "en", "a", len(LONG)), (9, "one two three four fivesix ", "en", "c", 27),
        (10, "Released under the MIT License.", "en", "c", 31), (11, "é😀 ça", "fr", "c", 5),
    ]
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 0.5, "z", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, copy int, shuffle_key string, id int, score double, component_id string, key int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
