import pytest

DOCS = "doc_id long, text string, lang string, source string, score double, rep long, kept string, n long, rate double, cell long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use themselves."""

    def make(*rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, 0.5, 1, "k", 2, 0.1, 3) for i, t in rows], DOCS)

    return make


LONG = " ".join(f"word{k % 97} x{k}" for k in range(20_000))


@pytest.fixture
def odd(docs):
    """Nulls, empty, blank and very long texts, ties and a repeated row."""
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, LONG), (5, "Same words again here"), (6, "same WORDS again here"), (6, "same WORDS again here"), (7, "é ß Σ 字 ١٢٣"), (None, "no id here"), (8, "\n\n"), (9, "!!! ### 12")]
    return docs(*rows)
