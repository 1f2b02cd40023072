import pytest

LONG = "word " * 40_000


@pytest.fixture(scope="session")
def hostile(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""
    rows = [
        (1, "Plain words stand here for everyone to read today", "a"), (1, "Plain words stand here for everyone to read today", "a"),
        (2, None, "a"), (3, "", None), (4, "   \n\t ", None), (None, "no id at all but some words follow", "b"), (None, None, None),
        (5, LONG, "a"), (6, LONG, "a"), (7, "!!! ??? ...", "b"), (8, "one", "b"), (8, "two different texts share this id", "c"),
        (-3, "ünïcödé ßtraße 日本語 тест", "c"), (9, "\x00\x1f control", "c"),
    ]
    names = "doc_id long, text string, source string, size long, mix string, toxicity string, quality string, secrets string, _row long, id string, root string, n int, label int, row string, name string"
    return spark.createDataFrame([(*r, 1, "m", "t", "q", "s", 2, "i", "r", 3, 4, "w", "z") for r in rows], names)


@pytest.fixture(scope="session")
def empty(hostile):
    return hostile.where("false")
