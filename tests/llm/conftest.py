from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = "Word and word. " * 4000


@pytest.fixture
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those
    that operators use themselves."""
    rows = [
        (1, "one two three four five six seven", "en", "a", 3),
        (1, "one two three four five six seven", "en", "a", 3),
        (2, None, None, None, None),
        (3, "", "en", "", 0),
        (None, "one two three four five six seven", "en", "b", 1),
        (None, None, None, None, None),
        (4, " \t\n\n ", "en", "c", 5),
        (5, LONG, "en", "d", len(LONG)),
        (6, "word", "en", "e", 4),
        (7, "héllo 漢字 😀 <|endoftext|> it's\x00", "xx", "f", 9),
    ]
    df = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    )
    clashing = ["c0", "c1", "h1", "pos", "spans", "score", "token", "window", "said"]
    clashing += ["set_id", "size", "root", "text2", "fp", "n_words", "kept", "item_id"]
    return df.select("*", *[F.lit("x").alias(c) for c in clashing])


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.limit(0)
