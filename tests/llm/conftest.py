"""Tables of odd rows that every operator has to take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `row` int, `size` int, `rank` int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, one id twice, and columns named like the operators' own."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
    rows = [
        (1, "The cat sat on the mat, and the dog slept by the door all day long.", "en", "a"), (1, "The cat sat on the mat, and the dog slept by the door all day long.", "en", "a"), (1, "Another text under the same number, of some more words than that.", "en", "b"),
        (None, "A row without a number. It has a text all the same, and a source.", "en", "b"), (None, "A row without a number. It has a text all the same, and a source.", "en", "b"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n ", "en", "c"), (5, long, "en", "a"), (6, "One.", None, None), (7, "🙂 ünïcödé Straße", "de", "ü"),
    ]
    return spark.createDataFrame([(*r, 0, "k", 1, 2, 3) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
