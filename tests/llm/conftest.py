from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(i, t, *(rest or ("en", "src0")), len(t) if t is not None else None) for i, t, *rest in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Nulls in every column, empty and very long texts, ties, repeated rows and short texts.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta.\nAlpha beta. Gamma delta!"),
    (1, "alpha beta gamma delta epsilon zeta.\nAlpha beta. Gamma delta!"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "word " * 60_000),
    (6, "ALPHA BETA gamma delta epsilon zeta.\nAlpha beta. Gamma delta!"),
    (None, "alpha beta gamma delta epsilon zeta.\nAlpha beta. Gamma delta!"),
    (None, None),
    (7, "12345 !!! ???"),
    (8, "x"),
    (9, "\0 odd \x1c bytes \x85 and 日本語 🎉", None, None),
]


#: Long runs without white space, as in encoded data and rules of tables.
RUNS = [(1, "QUJD" * 250_000), (2, "#=" * 250_000), (3, "a@" * 250_000), (4, "!" * 500_000 + " end"), (5, "+1" * 250_000)]


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def none(docs):
    return docs([])
