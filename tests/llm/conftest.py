import os

import pytest

os.environ.setdefault("TZ", "UTC")


def documents(spark, texts, extra=""):
    """A documents table with ids 0.. and a clashing extra column."""
    rows = [(k, x, "en", "s", None if x is None else len(x), True) for k, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean")


@pytest.fixture(scope="session")
def docs(spark):
    return lambda texts: documents(spark, texts)
