import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, name string, h long, ids string, part int, "
SCHEMA += "__rate double, __copy int, __rows int, __id long, __sha string, __own string, rate double, wanted string, own string"
LONG = " ".join(f"word{k}" for k in range(30_000))
ODD = [
    (1, None, "en", "a", None, 1, "x", 1, "i", 1),
    (2, "", None, None, 0, 1, "x", 1, "i", 1),
    (None, "no id here", "en", "a", 10, None, None, None, None, None),
    (None, "no id here", "en", "a", 10, None, None, None, None, None),
    (3, "same row same row", "de", "b", 17, 1, "x", 1, "i", 1),
    (3, "same row same row", "de", "b", 17, 1, "x", 1, "i", 1),
    (3, "another text under the same id", "de", "b", 30, 1, "x", 1, "i", 1),
    (4, " \t\n ", "en", "c", 4, 1, "x", 1, "i", 1),
    (5, LONG, "en", "c", len(LONG), 1, "x", 1, "i", 1),
    (6, LONG, "en", "c", len(LONG), 1, "x", 1, "i", 1),
    (7, "日本語 \U0001F600 +49 30 1234567 a@b.co", "en", "c", 26, 1, "x", 1, "i", 1),
]


ODD = [(*row, 0.5, 2, 3, 4, "s", "o", 0.5, "w", "o") for row in ODD]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with names that operators use."""
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
