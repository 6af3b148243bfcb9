import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, number long, spans string"
WORDS = "the of and house river stone paper window garden letter music winter yellow bridge market silver".split()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    long_text = " ".join(WORDS[k * 7 % 16] + str(k % 97) for k in range(40_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r", "en", "a", 6), (4, "12 345 !", None, "b", 8),
        (5, long_text, "en", "a", len(long_text)), (6, long_text, "en", None, len(long_text)), (7, "x" * 30_000, "de", "b", 30_000),
        (8, "The river. The river. The river.", "en", "c", 32), (8, "The river. The river. The river.", "en", "c", 32),
        (None, "Nobody's garden of yellow stone", "en", "c", 31), (None, None, None, None, None),
        (9, "été ñandú über 日本語 \U0001f600 text", "fr", "d", 25), (10, "one", "en", "d", 3), (11, "one", "en", "d", 3),
    ]
    return spark.createDataFrame([(*r, "row", 7, "spans") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
