import pytest

SCHEMA = "h bigint, doc_id bigint, DOC_ID string, text string, words string, lang string, source string, rep string, n_chars bigint"
LONG = " ".join(f"word{i} and some of the talk" for i in range(30_000))
SHORT = "the quick fox jumps over the lazy dog and the cat"


def row(doc_id, text, lang="en", source="s"):
    return (1, doc_id, "clash", text, "w", lang, source, "r", None if text is None else len(text))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names clash."""
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, SHORT), row(4, SHORT), row(5, SHORT), row(None, SHORT), row(None, None),
        row(6, LONG), row(7, "ü  \U0001f600 $$$ !!!"), row(8, SHORT, lang=None), row(9, SHORT, lang="xx"), (None,) * 9, row(10, "...", source=None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
