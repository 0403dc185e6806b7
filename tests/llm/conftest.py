import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from texts or (text, source) pairs; ids from 0, columns that clash with operators' own."""

    def build(texts, first=0, ids=None):
        rows = [(t if isinstance(t, tuple) else (t, "s")) for t in texts]
        numbers = ids if ids is not None else range(first, first + len(rows))
        data = [(i, t, "en", s, None, 1.0, 7, "x") for i, (t, s) in zip(numbers, rows, strict=True)]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node string")

    return build


ODD = [None, "", " ", "\n\t", "a", "é ñ 日本", "\x00\x1f", "x" * 5000, "word " * 3000, "a b"]


@pytest.fixture(scope="session")
def odd():
    """Texts that have broken things before: null, empty, white space, one long word, many words."""
    return ODD
