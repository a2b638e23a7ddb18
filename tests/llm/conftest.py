import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, blank and long texts, ties and repeated rows, clashing extra columns."""
    from pyspark.sql import functions as F

    long_text = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 2000
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "xx", "a", 0), (3, " \n\t ", None, None, 4),
            (4, long_text, "en", "b", len(long_text)), (5, long_text, "en", "b", len(long_text)),
            (6, "one", "en", "c", 3), (6, "one", "en", "c", 3), (7, "One two THREE four", "fr", "a", 18),
            (8, "one two three four", "fr", None, 18), (9, "mail x@y.org now \U0001d11eé " * 30, "de", "a", 5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    extra = ("n_words", "kept", "size", "target", "part", "length", "row", "spans", "place", "token", "cid", "label", "rid")
    return frame.select("*", *[F.lit("x").alias(c) for c in extra])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
