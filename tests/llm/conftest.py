import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string"


@pytest.fixture
def documents(spark):
    """Rows with nulls, empty and long texts, repeated rows, and columns with clashing names."""

    def make(texts):
        return spark.createDataFrame([(k, t, "en", "s", len(t or ""), 0.5, "x") for k, t in texts], DOCS)

    return make


LONG = "alpha beta gamma delta epsilon " * 5000
EDGE = [(1, None), (2, ""), (3, "one"), (4, LONG), (5, LONG), (5, LONG), (None, "one two three"), (7, " \n\t "), (8, "ONE")]


@pytest.fixture
def edge(documents):
    return documents(EDGE)
