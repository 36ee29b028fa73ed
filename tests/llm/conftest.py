import os

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null and empty texts, a very long one, repeated rows, null ids and clashing extra columns."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
    copied = "The same passage stands here and there, again and again, with some more words to fill it. " * 12
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, None), (4, long, "en", "b", len(long)),
        (5, copied, "en", "b", len(copied)), (5, copied, "en", "b", len(copied)), (6, copied + " tail", "de", "b", 1),
        (None, "a text without an id", "en", "c", 20), (None, None, None, None, None), (7, "Zwölf Boxkämpfer 🥊 jagen Viktor", "de", "c", 31),
        (8, "password=hunter2secret user=bob https://db.example.net/x", "en", "c", 55), (9, "a", "en", "c", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    # extra columns named like results, in another case too
    for name in ("fp", "Spans", "n_words", "kept", "severity", "score", "n_bytes", "start", "host", "key", "_judged"):
        df = df.selectExpr("*", f"'extra' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(os.path.join(sf, "documents.parquet")).collect()}
