import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source)."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    long = " ".join(f"w{i % 9973}x{i}" for i in range(30_000))
    return docs((1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (5, "one two three"), (6, long, None), (7, "na\u00efve \U0001f600 caf\u00e9\u2003x", ""), (8, "a\x00b\x1cc d"))
