from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and very long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977} and some more text, {i}" for i in range(6000))
    rows = [(1, "The cat sat on the mat and the dog lay by the door.", "en", "a", 51), (2, None, None, None, None),
            (3, "", "en", "a", 0), (4, " \t\n ", "en", None, 4), (None, "a text without an id", "en", "b", 20),
            (5, long, "en", "b", len(long)), (6, long, None, "b", None), (7, "12 34 !! ?", "en", "a", 10),
            (8, "x", "fr", "a", 1), (8, "x", "fr", "a", 1), (8, "another text of the same id", "fr", "a", 27),
            (9, "naïve Straße, 日本語 テキスト wide\x0bspace \x1c odd", "de", "c", 40), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    # Names that operators use inside.
    from pyspark.sql import functions as F
    return df.withColumns({"words": F.lit(1), "spans": F.lit("s"), "score": F.lit("x"), "features": F.lit(2), "fingerprint": F.lit("f"),
                           "start": F.lit(1), "n": F.lit(1), "class": F.lit("c"), "item_id": F.lit(0), "license": F.lit("l"),
                           **{f"_{n}": F.lit(f"own {n}") for n in ("kinds", "leaked", "read", "path", "id", "text", "kept", "kept_id", "kept_text",
                                                                   "row", "base", "gain", "word", "times", "key", "found", "tested", "hash")}})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
