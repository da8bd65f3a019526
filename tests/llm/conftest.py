"""Tables for the training-data operators."""

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text[, lang, source]) rows."""

    def make(rows):
        full = []
        for doc_id, text, *rest in rows:
            lang, source = (rest + [None, None])[:2]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, ties, repeated rows, a very long text, words of any script."""
    return [
        (1, None, None, None),
        (2, "", "en", ""),
        (3, " \t\n\x0b\x0c\r ", "en", "a"),
        (4, "one two three four five six", "en", "a"),
        (4, "one two three four five six", "en", "a"),
        (5, "one two three four five six", None, "b"),
        (None, "no id here", "de", "b"),
        (6, "Ünï cödé 字字 \U0001f389 x <|endoftext|> \x00\x85  ", "fr", "ä"),
        (7, "long text of words " * 20_000, "en", "a"),
        (8, "x" * 200_000, "en", None),
    ]
