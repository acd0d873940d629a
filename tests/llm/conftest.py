from __future__ import annotations

import random

import pytest
from tests_llm_helpers import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"



@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, equal ids with different texts."""
    rng = random.Random(5)
    long_text = words(rng, 60_000)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, "  \n\t ", "en", "s", 5),
        (4, "one", "en", "s", 3),
        (5, "Ünïcödé 😀 wörds and a few more of them here", "de", None, 10),
        (6, long_text, "en", "s", len(long_text)),
        (7, "the same text twice over in the table", "en", "s", 1),
        (7, "the same text twice over in the table", "en", "s", 1),
        (8, "equal id other text", "en", "s", 1),
        (8, "equal id another text", "en", "s", 1),
        (None, "no id at all on this row", "en", "s", 1),
        (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge_docs):
    """The same rows with more columns, of names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("score", "spans", "blob", "row", "key", "fingerprint", "x", "__x", "__row", "piece", "length", "words", "stays", "id")
    return edge_docs.withColumns({n: F.lit("extra") for n in names})


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
